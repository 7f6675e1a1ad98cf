"""Column builders: all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

NAN = float("nan")


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def strict_mean(c: str) -> Column:
    """The mean; null as soon as one value is null."""
    return F.when(F.count_if(F.col(c).isNull()) > 0, F.lit(None)).otherwise(F.avg(c))


def finite_mean(c: str) -> Column:
    """The mean of finite values; NaN if there are none."""
    return F.coalesce(F.avg(F.when(finite(F.col(c)), F.col(c))), F.lit(NAN))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; NaN if one side is constant, null for no rows."""
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(F.count(a) == 0, F.lit(None)).when(flat, F.lit(NAN)).otherwise(
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    )


def tied_rank(value: Column | str, keys: Sequence[str], descending: bool = False) -> Column:
    """Average ranks of ties inside the keys' groups: halfway between the least rank of a tie
    and the number of rows up to its end. One window, so one shuffle and one sort."""
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys).orderBy(value.desc() if descending else value.asc())
    return (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / F.lit(2.0)


def gap(internal: Column, external: Column, higher_better: bool) -> Column:
    """Positive where the internal figure looks better than the external one."""
    return internal - external if higher_better else external - internal


def seeded(seed: str, *keys: str) -> Column:
    """A reproducible random order: the MD5 of a seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def _total(x: Column, y: Column, f) -> Column:
    return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda acc, v: acc + v)


def dot(x: Column, y: Column) -> Column:
    return _total(x, y, lambda a, b: a * b)


def squared_euclidean(x: Column, y: Column) -> Column:
    return _total(x, y, lambda a, b: (a - b) * (a - b))


def distance(metric: str, x: Column, y: Column) -> Column:
    """Standard distances of two vectors; Jaccard is 1 - sum of minima / sum of maxima."""
    if metric == "euclidean":
        return F.sqrt(squared_euclidean(x, y))
    if metric == "sqeuclidean":
        return squared_euclidean(x, y)
    if metric == "cityblock":
        return _total(x, y, lambda a, b: F.abs(a - b))
    if metric == "chebyshev":
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, v: F.greatest(acc, v))
    if metric == "cosine":
        return 1 - F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    if metric == "jaccard":
        return 1 - F.coalesce(F.try_divide(_total(x, y, F.least), _total(x, y, F.greatest)), F.lit(1.0))
    raise ValueError(f"unknown distance {metric!r}; known: {', '.join(METRICS)}")


METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine", "jaccard")


def tanimoto(a: Column, b: Column) -> Column:
    """Similarity of two sets of positions; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
