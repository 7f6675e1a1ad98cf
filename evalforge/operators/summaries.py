"""Grouped summaries of long score tables: means, gaps, spreads, counts, quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalforge.functions.columns import finite, finite_mean, strict_mean

HIGHER_BETTER = {"R2": True, "RMSE": False, "MAE": False, "Bias": False}


def unpivoted(long: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(ids, metric, score): one row a metric."""
    return long.unpivot(list(ids), list(metrics), "metric", "score")


def merge_runs(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means over repeated runs; null as soon as one run is null."""
    return long.groupBy(*keys).agg(*[strict_mean(m).alias(m) for m in metrics])


def mean_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(strict_mean("score").alias("score"))


def higher_is_better(metric: str | None = None):
    """1 if more of the metric is better, else 0; an unknown metric is an error."""
    known = F.create_map(*[x for k, v in HIGHER_BETTER.items() for x in (F.lit(k), F.lit(v))])
    c = F.col("metric") if metric is None else F.lit(metric)
    return F.when(F.array_contains(F.map_keys(known), c), known[c]).otherwise(F.raise_error(F.concat(F.lit("unknown metric "), c)).cast("boolean"))


def benchmark_summary(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """External and internal mean of each group and the gap by the library's orientation,
    external less internal where more is better and the reverse elsewhere; null if a side
    is missing."""
    g = scores.groupBy(*keys, "metric").agg(
        F.avg(F.when(F.col("set") == "ips", F.col("score"))).alias("benchmark"), F.avg(F.when(F.col("set") == "test", F.col("score"))).alias("internal")
    )
    d = F.col("benchmark") - F.col("internal")
    return g.withColumn("gap_library", F.when(higher_is_better(), d).otherwise(-d))


def manuscript_gap(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same with the sign that makes an optimistic internal estimate positive."""
    return benchmark_summary(scores, keys).withColumn("gap_manuscript", -F.col("gap_library")).drop("gap_library")


def collapsed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Means of finite values, NaN where there are none."""
    return df.groupBy(*keys).agg(finite_mean(value).alias(value))


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """Least and largest finite value and their distance; 0 where there are none."""
    v = F.when(finite(F.col(value)), F.col(value))
    out = df.groupBy(key).agg(F.coalesce(F.min(v), F.lit(0.0)).alias("low"), F.coalesce(F.max(v), F.lit(0.0)).alias("high"))
    return out.withColumn("range", F.col("high") - F.col("low"))


def plain_spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """The same without a finite filter or a default."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def finite_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.median(F.when(finite(F.col(v)), F.col(v))).alias(v) for v in values])


def threshold_counts(df: DataFrame, key: str, value: str, threshold: float, higher_better: bool = True) -> DataFrame:
    """How many gaps pass the threshold in size, on the optimistic and on the pessimistic
    side, by the masks for raw external less internal differences."""
    d = F.col(value)
    ok = ~F.isnan(d)
    low, high = F.count_if(ok & (d < -threshold)), F.count_if(ok & (d > threshold))
    return df.groupBy(key).agg(
        F.count_if(ok & (F.abs(d) > threshold)).alias("abs_ct"), (low if higher_better else high).alias("opt_ct"), (high if higher_better else low).alias("pess_ct"),
        F.countDistinct("dataset").alias("n_datasets"),
    )


def threshold_sweep(df: DataFrame, key: str, value: str, thresholds: Sequence[float], divisor: int) -> DataFrame:
    """Share of data sets whose gap exceeds each of the thresholds."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    d = F.col(value)
    hit = F.count_if(~F.isnan(d) & (F.abs(d) > F.col("threshold")))
    return df.select(key, value, each).groupBy(key, "threshold").agg((hit / F.lit(divisor)).alias("share"))


def quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 3)
    return df.groupBy(*keys).agg(q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def pivoted(df: DataFrame, rows: str, columns: str, names: Sequence[str], value: str) -> DataFrame:
    """Long to wide with the column names given, so that Spark need not look for them. One
    value a cell is asked for: several are an error."""
    one = F.when(F.count(value) <= 1, F.max(value)).otherwise(F.raise_error(F.lit("several values for one cell")).cast("double"))
    return df.groupBy(rows).pivot(columns, list(names)).agg(one)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles, one row a column."""
    long = df.unpivot([], list(columns), "column", "v").filter(F.col("v").isNotNull())
    q = [F.percentile("v", F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    return long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), *q, F.max("v").alias("high"))


def job_summary(jobs: DataFrame, rule: str, seconds: str, memory: str) -> DataFrame:
    """n, mean, 95th percentile and maximum of run time and memory, the heaviest first."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, name in ((seconds, "s"), (memory, "rss")):
        aggs += [F.round(F.avg(c), 2).alias(f"{name}_mean"), F.round(F.percentile(c, F.lit(0.95)), 2).alias(f"{name}_p95"), F.round(F.max(c), 2).alias(f"{name}_max")]
    return jobs.groupBy(rule).agg(*aggs).orderBy(F.desc("rss_p95"), F.desc("s_p95"))
