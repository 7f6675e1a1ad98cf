"""Champion selection: quality of the chosen model, hit rates, elimination rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def champions(scores: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Marks the model with the least `by` in each group (ties: least model name)."""
    best = scores.groupBy(*keys).agg(F.min(F.struct(by, "model")).alias("b"))
    return scores.join(best, list(keys)).withColumn("is_champion", F.col("model") == F.col("b.model")).drop("b")


def halving_rounds(scores: DataFrame, keys: Sequence[str], by: str, keep: Sequence[int] = (2, 1, 1)) -> DataFrame:
    """Round in which successive halving drops a model: 0 for the champion, else the first
    round that keeps fewer models than its rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by), "model"))
    out = F.lit(0)
    for r in range(len(keep), 0, -1):
        out = F.when(F.col("rank") > keep[r - 1], F.lit(r)).otherwise(out)
    return scores.withColumn("rank", rank).withColumn("round_eliminated", out.cast("int"))


def selection_quality(marked: DataFrame, keys: Sequence[str], loss: str) -> DataFrame:
    """The champion against the other models of its group, on another loss: mean advantage,
    advantage over the best other (regret if negative), hit. Rows with a null or NaN loss go
    first; groups without a champion or with one model are left out; two champions are an
    error."""
    ok = marked.filter(F.col(loss).isNotNull() & ~F.isnan(loss))
    champ = F.coalesce("is_champion", F.lit(False))
    g = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(champ).alias("c"), F.max(F.when(champ, F.col(loss))).alias("mine"),
        F.avg(F.when(~champ, F.col(loss))).alias("mean_other"), F.min(F.when(~champ, F.col(loss))).alias("best_other"),
    )
    one = F.when(F.col("c") > 1, F.raise_error(F.lit("several champions")).cast("double")).otherwise(F.col("mine"))
    g = g.filter("n > 1 AND c > 0").withColumn("mine", one)
    return g.select(
        *keys, "n", (F.col("mean_other") - F.col("mine")).alias("mean_advantage"), (F.col("best_other") - F.col("mine")).alias("best_advantage"),
        (F.col("mine") <= F.col("best_other")).alias("hit"),
    )


def quality_by(quality: DataFrame, keys: Sequence[str]) -> DataFrame:
    return quality.groupBy(*keys).agg(
        F.avg("mean_advantage").alias("mean_advantage"), F.avg("best_advantage").alias("best_advantage"), F.avg(F.col("hit").cast("double")).alias("hit_rate")
    )


def rate_statistics(rates: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, standard deviation and median by key, the best mean first."""
    return rates.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.median(value).alias("median")).orderBy(F.desc("mean"), key)


def cohens_d(df: DataFrame, key: str, group: str, value: str, first: str, second: str) -> DataFrame:
    """Standardised difference of two groups with the pooled standard deviation; NaN with
    fewer than two values on a side or without any spread."""
    a, b = (F.when(F.col(group) == g, F.col(value)) for g in (first, second))
    g = df.groupBy(key).agg(*[f(x).alias(n + s) for x, s in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    usable = (F.col("na") > 1) & (F.col("nb") > 1)
    g = g.withColumn("sd", F.when(usable, pooled))
    return g.select(key, F.when(F.col("sd") > 1e-12, (F.col("ma") - F.col("mb")) / F.col("sd")).otherwise(F.lit(float("nan"))).alias("cohens_d"))
