"""Ranks, rank tests and multi-criteria rankings of methods over data sets. Rows are
(block, group, value): a block is a data set, a group a method. Ranks are windows inside a
block; what reaches the driver are a few sums per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalforge.functions import special
from evalforge.functions.columns import correlation, tied_rank


def ordinal_ranks(df: DataFrame, keys: Sequence[str], group: str, value: str, higher_better: bool) -> DataFrame:
    """Places 1 to n inside the keys' groups, ties by name."""
    order = F.col(value).desc() if higher_better else F.col(value).asc()
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, group)))


def complete_blocks(df: DataFrame, block: str, group: str, value: str) -> DataFrame:
    """Blocks that have a non-null value for every group."""
    ok = df.filter(F.col(value).isNotNull())
    n = ok.select(group).distinct().agg(F.count(F.lit(1)).alias("k"))
    full = ok.groupBy(block).agg(F.countDistinct(group).alias("c")).join(F.broadcast(n), F.col("c") == F.col("k"), "left_semi")
    return ok.join(full.select(block), block, "left_semi")


def check_complete(df: DataFrame, block: str, group: str) -> DataFrame:
    """df, or an error at run time if a group is missing from a block."""
    n = df.select(block).distinct().agg(F.count(F.lit(1)).alias("n"))
    per = df.groupBy(group).agg(F.countDistinct(block).alias("c")).join(F.broadcast(n))
    per = per.withColumn("ok", F.when(F.col("c") == F.col("n"), True).otherwise(F.raise_error(F.concat(F.lit("incomplete: "), group)).cast("boolean")))
    return df.join(per.filter("ok").select(group), group, "left_semi")


def average_ranks(df: DataFrame, block: str, group: str, value: str, *by: str) -> DataFrame:
    """Mean tied rank of every group over the complete blocks, and the number of blocks."""
    r = df.withColumn("rank", tied_rank(value, [*by, block]))
    return r.groupBy(*by, group).agg(F.avg("rank").alias("avg_rank"), F.sum("rank").alias("rank_sum"), F.count(F.lit(1)).alias("n_blocks"))


def friedman(df: DataFrame, block: str, group: str, value: str) -> DataFrame:
    """One row: blocks n, groups k, statistic Q with the correction for ties, its p value,
    and Iman and Davenport's F with its p value."""
    full = complete_blocks(df, block, group, value)
    ties = full.groupBy(block, value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = average_ranks(full, block, group, value).agg(
        F.count(F.lit(1)).alias("k"), F.max("n_blocks").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("s")
    )
    r = sums.crossJoin(ties).first()
    k, n = int(r["k"] or 0), int(r["n"] or 0)
    if k < 2 or n < 1:
        raise ValueError("at least two groups and one complete block are needed")
    c = max(1 - r["ties"] / (n * k * (k * k - 1)), 1e-10)
    q = (12 * r["s"] / (n * k * (k + 1)) - 3 * n * (k + 1)) / c
    below = n * (k - 1) - q
    f = (n - 1) * q / below if below > 0 else math.nan
    fp = special.f_sf(f, k - 1, (k - 1) * (n - 1)) if below > 0 and n > 1 else math.nan
    return df.sparkSession.createDataFrame([(n, k, float(q), special.chi2_sf(q, k - 1), float(f), fp)], "n long, k int, q double, p double, iman_f double, iman_p double")


def critical_difference(k: int, n: int, alpha: float = 0.05) -> float:
    return special.range_quantile(1 - alpha, k) / math.sqrt(2) * math.sqrt(k * (k + 1) / (6 * n))


def nemenyi(df: DataFrame, block: str, group: str, value: str, alpha: float = 0.05, higher_better: bool = False, absolute: bool = False) -> DataFrame:
    """One row per pair of groups: average ranks over the complete blocks, their difference,
    the critical difference, whether it is passed, and the p value of the studentised range.
    `absolute` ranks magnitudes, `higher_better` gives rank 1 to the largest value. With fewer
    than two groups or complete blocks ranks and tests are NaN and nothing is significant."""
    v = F.abs(F.col(value)) if absolute else F.col(value)
    d = df.withColumn("__v", -v if higher_better else v)
    ranks = average_ranks(complete_blocks(d, block, group, "__v"), block, group, "__v")
    head = ranks.agg(F.count(F.lit(1)).alias("k"), F.max("n_blocks").alias("n")).first()
    k, n = int(head["k"] or 0), int(head["n"] or 0)
    if k < 2 or n < 2:
        names = df.select(F.col(group)).distinct()
        ranks, cd, se = names.withColumn("avg_rank", F.lit(math.nan)), math.nan, math.nan
    else:
        cd, se = critical_difference(k, n, alpha), math.sqrt(k * (k + 1) / (6 * n))
    a, b = (ranks.select(F.col(group).alias(group + s), F.col("avg_rank").alias("rank" + s)) for s in ("1", "2"))
    pairs = a.join(b, F.col(group + "1") < F.col(group + "2"))
    gap = F.abs(F.col("rank1") - F.col("rank2"))
    pairs = pairs.withColumns({"difference": gap, "critical": F.lit(cd), "significant": ~F.isnan(gap) & (gap > F.lit(cd)) if cd == cd else F.lit(False)})

    def tails(batches):
        for p in batches:  # a row for each pair of groups
            q = p["difference"] / se * math.sqrt(2)
            yield p.assign(p_value=[1.0 if not math.isfinite(x) else 1 - special.range_cdf(x, k) for x in q])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    out = pairs.mapInPandas(tails, f"{fields}, p_value double")
    return out.withColumns({c: F.coalesce(c, F.lit(math.nan)) for c in ("rank1", "rank2", "difference", "critical")})  # pandas has no NaN beside null


def nemenyi_after_iman(df: DataFrame, block: str, group: str, value: str, alpha: float = 0.05, run_anyway: bool = False) -> tuple[float, float, DataFrame | None]:
    """Iman and Davenport's F and p, and the pairs of `nemenyi` if p is below alpha."""
    r = friedman(df, block, group, value).first()
    run = run_anyway or r["iman_p"] < alpha
    return r["iman_f"], r["iman_p"], nemenyi(df, block, group, value, alpha) if run else None


def bar_rows(spans: Sequence[tuple[float, float]], base: float = 1.0, step: float = 0.25) -> list[tuple[float, float, float]]:
    """(low, high, height) of bars in the order given: each at the least height, base + i step,
    where it touches none of those placed before."""
    placed: list[tuple[float, float, float]] = []
    for low, high in spans:
        y = base
        while any(max(p[0], low) <= min(p[1], high) + 1e-12 and abs(p[2] - y) < 1e-9 for p in placed):
            y += step
        placed.append((low, high, y))
    return placed


def homogeneous_spans(ranks: DataFrame, group: str, width: float, tolerance: float = 1e-9) -> DataFrame:
    """Maximal runs of groups, in order of average rank, no wider than the critical
    difference: first and last group of each."""
    order = Window.orderBy("avg_rank", group)
    r = ranks.select(group, "avg_rank").withColumn("i", F.row_number().over(order))
    a, b = (r.select(F.col(group).alias("first" if s == "1" else "last"), F.col("avg_rank").alias("r" + s), F.col("i").alias("i" + s)) for s in "12")
    reach = a.join(b, (F.col("i2") > F.col("i1")) & (F.col("r2") - F.col("r1") <= width + tolerance))
    last = reach.groupBy("first", "i1").agg(F.max(F.struct("i2", "last")).alias("m")).select("first", "i1", F.col("m.last").alias("last"), F.col("m.i2").alias("i2"))
    before = F.max("i2").over(Window.orderBy("i1").rowsBetween(Window.unboundedPreceding, -1))
    return last.withColumn("before", before).filter("before IS NULL OR i2 > before").select("first", "last")


def rank_correlation(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Spearman's correlation of two columns by keys."""
    r = df.withColumns({"__a": tied_rank(a, keys), "__b": tied_rank(b, keys)})
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("__a"), F.col("__b")).alias("rho"))


def _weighted(criteria: dict[str, tuple[float, bool]], by: Window) -> tuple[dict[str, Column], dict[str, bool]]:
    total = sum(w for w, _ in criteria.values())
    if not criteria or total <= 0 or any(w < 0 for w, _ in criteria.values()):
        raise ValueError("criteria need weights that are not negative and not all zero")
    cols = {}
    for c, (w, _) in criteria.items():
        norm = F.sqrt(F.sum(F.col(c) * F.col(c)).over(by))
        cols[f"__{c}"] = F.coalesce(F.try_divide(F.col(c), norm), F.lit(0.0)) * (w / total)
    return cols, {f"__{c}": benefit for c, (_, benefit) in criteria.items()}


def topsis(df: DataFrame, keys: Sequence[str], criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """Closeness to the ideal by keys: criteria maps a column to (weight, is a benefit)."""
    by = Window.partitionBy(*keys)
    cols, benefit = _weighted(criteria, by)
    d = df.withColumns(cols)
    best, worst = F.lit(0.0), F.lit(0.0)
    for c, good in benefit.items():
        high, low = F.max(c).over(by), F.min(c).over(by)
        best += F.pow(F.col(c) - (high if good else low), 2)
        worst += F.pow(F.col(c) - (low if good else high), 2)
    d = d.withColumns({"__best": F.sqrt(best), "__worst": F.sqrt(worst)})
    d = d.withColumn("score", F.coalesce(F.try_divide(F.col("__worst"), F.col("__best") + F.col("__worst")), F.lit(0.5))).drop(*cols, "__best", "__worst")
    return d.withColumn("rank", tied_rank(F.round("score", 12), keys, descending=True))


def moora(df: DataFrame, keys: Sequence[str], criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """Ratio system: weighted normalised benefits less costs."""
    cols, benefit = _weighted(criteria, Window.partitionBy(*keys))
    d = df.withColumns(cols)
    score = F.lit(0.0)
    for c, good in benefit.items():
        score = score + (F.col(c) if good else -F.col(c))
    return d.withColumn("score", score).drop(*cols).withColumn("rank", tied_rank(F.round("score", 12), keys, descending=True))


def tukey_hsd(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Tukey's intervals of all pairs of groups. p_value keeps the statistic scaled by the
    square root of two, p_corrected leaves it as the interval has it."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    rows = [r for r in g.collect() if r["n"]]  # one row per group
    k, total = len(rows), sum(r["n"] for r in rows)
    if k < 2 or total <= k:
        raise ValueError("at least two groups and one repeated value are needed")
    mse = sum((r["n"] - 1) * (r["v"] or 0.0) for r in rows) / (total - k)
    crit = special.range_quantile(1 - alpha, k, total - k)
    out = []
    rows.sort(key=lambda r: r[group])
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            se = math.sqrt(mse / 2 * (1 / a["n"] + 1 / b["n"]))
            d = b["m"] - a["m"]
            q = abs(d) / se if se else math.inf
            out.append((a[group], b[group], float(d), float(d - crit * se), float(d + crit * se), 1 - special.range_cdf(q * math.sqrt(2), k, total - k), 1 - special.range_cdf(q, k, total - k)))
    return df.sparkSession.createDataFrame(out, "group1 string, group2 string, difference double, low double, high double, p_value double, p_corrected double")


def tukey_by(df: DataFrame, by: Sequence[str], group: str, value: str, alpha: float = 0.05, intervals: bool = True) -> DataFrame:
    """Tukey's comparisons of all pairs of groups, for each of the keys `by` (such as a metric): (by, group1, group2, difference,
    statistic, low, high, p_corrected). Values that are null or no number are left out, and so are keys with fewer
    than two groups or no repeated value. Without `intervals` the last three are left out. One pass of sums; pairs are of
    groups, not of rows."""
    v = F.when(~F.isnan(value), F.col(value))
    g = df.groupBy(*by, group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("v")).filter("n > 0")
    w = Window.partitionBy(*by)
    g = g.withColumns({"k": F.count(F.lit(1)).over(w), "free": F.sum("n").over(w) - F.count(F.lit(1)).over(w), "within": F.sum((F.col("n") - 1) * F.col("v")).over(w)})
    g = g.filter("k > 1 AND free > 0").withColumn("mse", F.col("within") / F.col("free"))
    a = g.select(*by, F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("m").alias("m1"), "k", "free", "mse")
    b = g.select(*by, F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    p = a.join(b, list(by)).filter("group1 < group2")
    p = p.withColumns({"difference": F.col("m2") - F.col("m1"), "se": F.sqrt(F.col("mse") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))})
    p = p.withColumn("statistic", F.when(F.col("se") > 0, F.abs("difference") / F.col("se")).otherwise(F.lit(math.inf)))
    if not intervals:
        return p.select(*by, "group1", "group2", "difference", "statistic")
    p = p.select(*by, "group1", "group2", "difference", "statistic", "se", "k", "free")

    def tails(batches):
        critical: dict[tuple, float] = {}
        for x in batches:
            for k, free in set(zip(x["k"], x["free"], strict=True)) - critical.keys():
                critical[k, free] = special.range_quantile(1 - alpha, int(k), float(free))
            reach = np.array([critical[c] for c in zip(x["k"], x["free"], strict=True)]) * x["se"]
            tail = [0.0 if math.isinf(q) else 1 - special.range_cdf(q, int(k), float(f)) for q, k, f in zip(x["statistic"], x["k"], x["free"], strict=True)]
            yield x.drop(columns=["se", "k", "free"]).assign(low=x["difference"] - reach, high=x["difference"] + reach, p_corrected=tail)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema if f.name not in ("se", "k", "free"))
    return p.mapInPandas(tails, f"{fields}, low double, high double, p_corrected double")


def metric_ranks(averages: DataFrame, group: str = "splitter") -> DataFrame:
    """(target, metric, group, avg_rank, n_blocks) of rows (dataset, group, metric, ips, diff, higher_better): the average rank of
    each group over the data sets that have all groups, by the external figure (target benchmark) and by the
    magnitude of the gap (target gap)."""
    fine = lambda c: F.when(~F.isnan(c), c)
    rows = lambda target, v: averages.select(F.lit(target).alias("target"), "metric", "dataset", group, fine(v).alias("v"))
    u = rows("benchmark", F.when(F.col("higher_better"), -F.col("ips")).otherwise(F.col("ips"))).unionByName(rows("gap", F.abs("diff"))).filter("v IS NOT NULL")
    groups = u.groupBy("target", "metric").agg(F.countDistinct(group).alias("k"))
    full = u.groupBy("target", "metric", "dataset").agg(F.countDistinct(group).alias("c")).join(groups, ["target", "metric"]).filter("c = k")
    return average_ranks(u.join(full.select("target", "metric", "dataset"), ["target", "metric", "dataset"], "left_semi"), "dataset", group, "v", "target", "metric").drop("rank_sum")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance from sums of squares of one pass per group."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    s = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"),
    )
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return s.select("k", "n", "between", "within", f.alias("f"))


def pairs_to_matrix(pairs: DataFrame, a: str, b: str, value: str, mode: str = "antisymmetric", diagonal: float = 0.0, order: Sequence[str] = ()) -> DataFrame:
    """Every cell (i, j, row, column, value) of the square of names: names of `order` first,
    others by name. A pair's value stands at (b, a); its mirror has it negated, the same, or is
    NaN (copy), as is any cell without a pair."""
    if mode not in ("antisymmetric", "symmetric", "copy"):
        raise ValueError(f"unknown mode {mode!r}; known: antisymmetric, copy, symmetric")
    one = pairs.select(F.col(b).alias("row"), F.col(a).alias("column"), F.col(value).cast("double").alias("value"))
    names = one.select("row").union(one.select("column")).distinct()
    if order:
        names = names.union(df_of(pairs, [(x,) for x in order], "row string")).distinct()
    given = F.array(*[F.lit(x) for x in order]).cast("array<string>")
    place = F.array_position(given, F.col("row"))
    names = names.select("row", F.row_number().over(Window.orderBy(F.when(place == 0, 1).otherwise(0), place, "row")).alias("i"))  # a row for each name
    cells = one
    if mode != "copy":
        cells = one.union(one.select(F.col("column").alias("row"), F.col("row").alias("column"), (-F.col("value") if mode == "antisymmetric" else F.col("value")).alias("value")))
    grid = names.crossJoin(F.broadcast(names.select(F.col("row").alias("column"), F.col("i").alias("j"))))  # the matrix asked for
    out = grid.join(cells, ["row", "column"], "left")
    v = F.when(F.col("i") == F.col("j"), F.lit(float(diagonal))).otherwise(F.coalesce("value", F.lit(math.nan)))
    return out.select("i", "j", "row", "column", v.alias("value"))


def df_of(like: DataFrame, rows: list, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


VIEWS = ("performance", "credibility", "combined")


def criteria_of_view(averages: DataFrame, view: str, group: str = "splitter") -> DataFrame:
    """(dataset, group, criterion, metric, v, benefit) of the rows (dataset, group, metric, ips,
    diff, higher_better): the external figure of each metric, its absolute gap as a cost, or both."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}; known: {', '.join(VIEWS)}")
    rows = lambda name, v, benefit: averages.select("dataset", group, F.concat(F.lit(name + ":"), "metric").alias("criterion"), "metric", v.alias("v"), benefit.alias("benefit"))
    parts = []
    if view != "credibility":
        parts.append(rows("ips", F.col("ips"), F.col("higher_better")))
    if view != "performance":
        parts.append(rows("diff", F.abs(F.col("diff")), F.lit(False)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ranking_views(averages: DataFrame, view: str, weights: dict[str, float] | None = None, group: str = "splitter") -> DataFrame:
    """(group, view, method, mean_rank, mean_score, n_datasets): TOPSIS and the ratio system
    (MOORA) inside each data set over the view's criteria, averaged over data sets. Groups that
    lack a criterion (null or NaN) in a data set, and data sets with fewer than two groups, are
    left out. Weights are of metrics, equal by default."""
    c = criteria_of_view(averages, view, group)
    w = F.lit(1.0)
    if weights is not None:
        w = F.element_at(F.create_map(*[F.lit(x) for m, v in weights.items() for x in (m, float(v))]), F.col("metric"))
    n_criteria = averages.select("metric").distinct().count() * (2 if view == "combined" else 1)  # a dozen metrics
    c = c.withColumn("w", w).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    c = c.withColumn("have", F.count(F.lit(1)).over(Window.partitionBy("dataset", group))).filter(F.col("have") == n_criteria)
    by, at = Window.partitionBy("dataset"), Window.partitionBy("dataset", "criterion")
    c = c.withColumns({"rows": F.count(F.lit(1)).over(at), "norm": F.sqrt(F.sum(F.col("v") * F.col("v")).over(at)), "total": F.sum("w").over(Window.partitionBy("dataset", group))})
    c = c.filter("rows > 1").withColumn("z", F.coalesce(F.try_divide(F.col("v"), F.col("norm")), F.lit(0.0)) * F.col("w") / F.col("total"))
    high, low = F.max("z").over(at), F.min("z").over(at)
    c = c.withColumns({"best": F.when(F.col("benefit"), high).otherwise(low), "worst": F.when(F.col("benefit"), low).otherwise(high)})
    s = c.groupBy("dataset", group).agg(
        F.sqrt(F.sum(F.pow(F.col("z") - F.col("best"), 2))).alias("up"), F.sqrt(F.sum(F.pow(F.col("z") - F.col("worst"), 2))).alias("down"),
        F.sum(F.when(F.col("benefit"), F.col("z")).otherwise(-F.col("z"))).alias("MOORA"),
    )
    s = s.withColumn("TOPSIS", F.coalesce(F.try_divide(F.col("down"), F.col("up") + F.col("down")), F.lit(0.5)))
    s = s.unpivot(["dataset", group], ["TOPSIS", "MOORA"], "method", "score")
    s = s.withColumn("rank", tied_rank(F.round("score", 9), ["dataset", "method"], descending=True))
    out = s.groupBy(group, "method").agg(F.avg("rank").alias("mean_rank"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_datasets"))
    return out.select(group, F.lit(view).alias("view"), "method", "mean_rank", "mean_score", "n_datasets")


def compare_rankings(a: DataFrame, b: DataFrame, group: str = "splitter", rank: str = "mean_rank", top: int = 3, bottom: int = 2) -> DataFrame:
    """One row: Spearman's rho of two rankings of the same groups, and whether their first
    `top` and last `bottom` groups are the same sets. Ties go by name."""
    both = a.select(group, F.col(rank).alias("a")).join(b.select(group, F.col(rank).alias("b")), group)
    rho = both.withColumns({"ra": tied_rank("a", []), "rb": tied_rank("b", [])}).agg(correlation(F.col("ra"), F.col("rb")).alias("rho"))  # one row a group
    ends = lambda c, k, down: F.array_sort(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col(c) if down else F.col(c)).alias("v"), group))), 1, k), lambda s: s[group]))
    sets = both.agg((ends("a", top, False) == ends("b", top, False)).alias("top_same"), (ends("a", bottom, True) == ends("b", bottom, True)).alias("bottom_same"))
    return rho.crossJoin(sets)  # one row each


def long_pairs_to_matrix(pairs: DataFrame, a: str, b: str, value: str, antisymmetric: bool) -> DataFrame:
    """(row, column, value) with both triangles and the diagonal."""
    one = pairs.select(F.col(a).alias("row"), F.col(b).alias("column"), F.col(value).alias("value"))
    other = one.select(F.col("column").alias("row"), F.col("row").alias("column"), (-F.col("value") if antisymmetric else F.col("value")).alias("value"))
    names = one.select("row").union(one.select("column")).distinct()
    return one.union(other).union(names.select("row", F.col("row").alias("column"), F.lit(0.0 if antisymmetric else 1.0).alias("value")))
