"""Error, correlation, rank and early-enrichment metrics of long prediction tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalforge.functions.columns import NAN, correlation, tied_rank
from evalforge.sources.scratch import materialise

Y, P = F.col, "y_pred"


def error_aggregates(where=None, suffix: str = "") -> list:
    """rmse, r2, mae and bias as aggregates of one pass, of the rows that meet `where`."""
    t, p = F.col("y_true"), F.col("y_pred")
    if where is not None:
        t, p = F.when(where, t), F.when(where, p)
    e = p - t
    total = F.var_pop(t) * F.count(t)
    r2 = F.when(F.min(t) == F.max(t), F.lit(NAN)).otherwise(1 - F.try_divide(F.sum(e * e), total))
    return [
        F.sqrt(F.avg(e * e)).alias("rmse" + suffix), r2.alias("r2" + suffix), F.avg(F.abs(e)).alias("mae" + suffix), F.avg(e).alias("bias" + suffix),
    ]


def layer1_summary(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error metrics of the test and ips sets side by side, with their gaps; groups that
    lack one of the sets are left out. One shuffle, combined on the map side."""
    test, ips = F.col("set") == "test", F.col("set") == "ips"
    both = pred.groupBy(*keys).agg(
        *error_aggregates(test, "_test"), *error_aggregates(ips, "_ips"), F.count_if(test).alias("nt"), F.count_if(ips).alias("ni")
    )
    both = both.filter("nt > 0 AND ni > 0").drop("nt", "ni")
    return both.withColumns(
        {
            "rmse_gap": F.col("rmse_ips") - F.col("rmse_test"),
            "r2_gap": F.col("r2_test") - F.col("r2_ips"),
            "abs_rmse_gap": F.abs(F.col("rmse_ips") - F.col("rmse_test")),
            "bias_gap": F.col("bias_ips") - F.col("bias_test"),
        }
    )


def layer1_long(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a set instead of paired columns."""
    return summary.select(*keys, F.expr(
        "stack(2, 'test', r2_test, rmse_test, mae_test, bias_test, 'ips', r2_ips, rmse_ips, mae_ips, bias_ips) AS (`set`, R2, RMSE, MAE, Bias)"
    ))


def fold_metrics(pred: DataFrame, keys: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """n, rmse, mae, medae, r2, Pearson and Spearman by keys; all NaN but n below 2 rows. What needs an order comes
    from `ordered_metrics`, the rest from one aggregate."""
    rows, plain = _plain_metrics(pred, keys, ())
    return _known(_matched(plain, ordered_metrics(rows, plain, keys, ("mae", "medae", "spearman"), group_rows=group_rows), keys), keys)


_PLAIN = ("rmse", "mae", "medae", "r2", "pearson", "spearman")


def _plain_metrics(pred: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The columns asked for, and n, rmse, r2 and Pearson by keys, both written once."""
    rows = materialise(pred.select(*dict.fromkeys([*keys, "y_true", "y_pred", *ties])))
    rmse, r2, *_ = error_aggregates()
    return rows, materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rmse, r2, correlation(F.col("y_true"), F.col("y_pred")).alias("pearson")))


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by keys, nulls being values; the columns of left come first, then the others of right."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def _known(df: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, "n", *[F.when(F.col("n") < 2, F.lit(NAN)).otherwise(F.col(c)).alias(c) for c in (*_PLAIN, *more)])


def performance_metrics(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longer list of a performance report. Targets at zero are left out of MAPE."""
    t, p = F.col("y_true"), F.col("y_pred")
    e = p - t
    rmse, r2, mae, _ = error_aggregates()
    return pred.groupBy(*keys).agg(
        r2, rmse, mae, F.median(F.abs(e)).alias("medae"), F.avg(F.abs(F.try_divide(e, F.when(F.abs(t) > 1e-12, t)))).alias("mape"),
        F.max(F.abs(e)).alias("max_error"),
        F.when(F.min(t) == F.max(t), F.lit(NAN)).otherwise(1 - F.try_divide(F.var_samp(e), F.var_samp(t))).alias("explained_variance"),
    )


def top_k_enrichment(pred: DataFrame, keys: Sequence[str], shares: Sequence[float], ties: Sequence[str]) -> DataFrame:
    """Share of the truly best among the predicted best, over what chance would give, for
    several top shares at once."""
    by = Window.partitionBy(*keys)
    tie = [F.col(c) for c in ties]
    r = pred.withColumns({
        "n": F.count(F.lit(1)).over(by),
        "rt": F.row_number().over(by.orderBy(F.col("y_true").desc(), *tie)),
        "rp": F.row_number().over(by.orderBy(F.col("y_pred").desc(), *tie)),
    })
    aggs = []
    for k in shares:
        top = F.greatest(F.lit(1), F.bround(F.col("n") * k).cast("int"))
        hits = F.count_if((F.col("rt") <= top) & (F.col("rp") <= top))
        n_top, n = F.max(top), F.max("n")
        aggs.append(((hits / n_top) / (n_top / n)).alias(_share(k)))
    return r.groupBy(*keys).agg(*aggs)


def _share(k: float) -> str:
    return f"ef{round(100 * k)}"


#: BEDROC's weight of early places, and the share of rows that are active.
ALPHA, ACTIVE = 20.0, 0.2


def bedroc(pred: DataFrame, keys: Sequence[str], ties: Sequence[str], alpha: float = ALPHA, active: float = ACTIVE) -> DataFrame:
    """Boltzmann-enhanced discrimination of ROC; the active rows are the truly best share;
    NaN if that is every row."""
    return _bedroc_sums(pred, keys, ties, alpha, active).withColumn("bedroc", _bedroc_of(alpha)).select(*keys, "n", "bedroc")


def _bedroc_sums(pred: DataFrame, keys: Sequence[str], ties: Sequence[str], alpha: float, active: float) -> DataFrame:
    """Rows, active rows and the sum of the active rows' weights, by keys."""
    by = Window.partitionBy(*keys)
    tie = [F.col(c) for c in ties]
    r = pred.withColumns({
        "n": F.count(F.lit(1)).over(by),
        "rt": F.row_number().over(by.orderBy(F.col("y_true").desc(), *tie)),
        "rp": F.row_number().over(by.orderBy(F.col("y_pred").desc(), *tie)),
    }).withColumn("na", F.greatest(F.lit(1), F.bround(F.col("n") * active)))
    return r.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("na").alias("na"),
        F.sum(F.when(F.col("rt") <= F.col("na"), F.exp(-alpha * F.col("rp") / F.col("n"))).otherwise(0.0)).alias("s"),
    )


def _bedroc_of(alpha: float) -> Column:
    """From the columns of _bedroc_sums."""
    ra = F.col("na") / F.col("n")
    rie = F.col("s") / F.col("na") / ((1 / F.col("n")) * (1 - math.exp(-alpha)) / (F.exp(alpha / F.col("n")) - 1))
    scale = F.try_divide(ra * math.sinh(alpha / 2), math.cosh(alpha / 2) - F.cosh(alpha / 2 - alpha * ra))
    return F.coalesce(rie * scale + F.try_divide(F.lit(1.0), 1 - F.exp(alpha * (1 - ra))), F.lit(NAN))


def _inversions(values: np.ndarray) -> int:
    """Pairs out of order."""
    r = np.unique(values, return_inverse=True)[1]
    return int(_inversions_by(r, np.zeros(len(r), np.int64), 1)[0])


def _inversions_by(r: np.ndarray, seg: np.ndarray, segs: int) -> np.ndarray:
    """Pairs out of order in each segment of rows; r are ranks from 0, all those of a segment beyond those of the one before.
    Rows are parted by one bit of r after another: of rows whose higher bits agree, a 1 before a 0 is out of order."""
    total, n = np.zeros(segs), len(r)
    at = np.arange(n)
    for bit in range(int(r.max()).bit_length() - 1 if n else -1, -1, -1):
        up = r >> (bit + 1)
        starts = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        sizes = np.diff(np.append(starts, n))
        first = np.repeat(starts, sizes)
        one = (r >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        zeros_before = zeros[:-1] - zeros[first]
        ones_before = at - first - zeros_before
        total += np.bincount(seg[~one], ones_before[~one], segs)
        to = first + np.where(one, np.repeat(zeros[starts + sizes] - zeros[starts], sizes) + ones_before, zeros_before)
        moved = np.empty_like(r), np.empty_like(seg)
        moved[0][to], moved[1][to] = r, seg
        r, seg = moved
    return total


#: Rows of a group whose orders one task makes; those of larger groups are made by windows, whose sorts go to disk.
GROUP_ROWS = 1_000_000
#: Rows of a task on average, and rows of small groups that are taken at once.
_TASK_ROWS, _AT_ONCE = 250_000, 100_000


def _column(c: pa.ChunkedArray) -> list[np.ndarray]:
    """Values and, where some are null, which are not: keys of an order with nulls first, the last key first."""
    some = c.is_valid().to_numpy()
    if some.all():
        v = c.to_numpy()
        return [v if v.dtype.kind != "O" else np.unique(v, return_inverse=True)[1]]
    v = c.drop_null().to_numpy()
    codes = np.zeros(len(c), np.int64)
    codes[some] = np.unique(v, return_inverse=True)[1]
    return [codes, some]


def _order(*keys: np.ndarray) -> np.ndarray:
    """Rows in the order of the keys, the first of them first."""
    keys = [k for k in keys if len(k) and (k.dtype.kind == "f" or (k != k[0]).any())]
    return np.lexsort(keys[::-1]) if keys else None


def _dense(keys: list[np.ndarray], seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks from 0 of rows by segment and keys (the last key first), and rows of each rank."""
    order = _order(seg, *keys[::-1])
    order = np.arange(len(seg)) if order is None else order
    new = np.zeros(len(seg), bool)
    new[:1] = True
    for k in (seg, *keys):
        v = k[order]
        differ = v[1:] != v[:-1]
        if v.dtype.kind == "f":
            differ &= ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
        new[1:] |= differ
    rank = np.empty(len(seg), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, np.bincount(rank)


def _segments(t: pa.Table, keys: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """The rows, those of a group side by side, and the number of each row's group."""
    code, size = np.zeros(t.num_rows, np.int64), 1
    for k in keys:
        c = t.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        if size * (int(c.max()) + 1) >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
        code, size = code * (c.max() + 1) + c, size * (int(c.max()) + 1)
    new = np.concatenate([[True], code[1:] != code[:-1]])
    if new.sum() > len(np.unique(code[new])):  # groups of one hash
        order = np.argsort(code, kind="stable")
        t, code = t.take(order), code[order]
        new = np.concatenate([[True], code[1:] != code[:-1]])
    return t, np.cumsum(new) - 1


def _ordered(t: pa.Table, keys: Sequence[str], ties: Sequence[str], names: Sequence[str], shares: Sequence[float]) -> pa.RecordBatch:
    """keys and names of the groups of a table, all at once."""
    t, seg = _segments(t, keys)
    starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    n = np.diff(np.append(starts, len(seg)))
    segs, out = len(n), {}
    y = {c: t.column(c) for c in ("y_true", "y_pred")}
    (ct, nt), (cp, np_) = (_dense(_column(c), seg) for c in y.values())
    if "medae" in names:
        e = [v.to_numpy() for v in y.values()]
        e = np.abs(e[1] - e[0]).astype(float)
        some = (y["y_true"].is_valid().to_numpy() & y["y_pred"].is_valid().to_numpy()).astype(bool)
        # Sums of decimal fractions meet halves of the last place: rows are added by prediction, so that they agree between runs.
        by = np.argsort(cp * len(nt) + ct, kind="stable")
        by = by[some[by]]
        m = np.bincount(seg[by], minlength=segs)
        mean = np.bincount(seg[by], e[by], segs) / np.maximum(m, 1)
        out["mae"] = pa.array(mean, pa.float64(), mask=m == 0, from_pandas=False)
        e, s = e[some], seg[some]
        e = e[np.lexsort((e, s)) if segs > 1 else np.argsort(e)]
        ends = np.cumsum(m)
        has = np.flatnonzero(m)
        low, high = (e[(ends - m + k)[has]] for k in ((m - 1) // 2, m // 2))
        medae = np.full(segs, None, object)
        medae[has] = 0.5 * low + 0.5 * high
        out["medae"] = pa.array(medae, pa.float64(), from_pandas=False)
    if "spearman" in names:
        a, b = (np.cumsum(m)[c] - (m[c] - 1) / 2 - starts[seg] - (n[seg] + 1) / 2 for c, m in ((ct, nt), (cp, np_)))
        sab, saa, sbb = (np.bincount(seg, v, segs) for v in (a * b, a * a, b * b))
        with np.errstate(all="ignore"):
            out["spearman"] = pa.array(np.where((saa > 0) & (sbb > 0), sab / (np.sqrt(saa) * np.sqrt(sbb)), NAN))
    if "kendall" in names:
        # Nulls count as not a number.
        x, p = (c if c.null_count == 0 else pa.chunked_array([c.combine_chunks().cast(pa.float64()).fill_null(NAN)]) for c in y.values())
        (kt, mt), (kp, mp) = (r if c is o else _dense(_column(c), seg) for c, o, r in zip((x, p), y.values(), ((ct, nt), (cp, np_)), strict=True))
        order = np.argsort(kt * len(mp) + kp, kind="stable")
        swaps = _inversions_by(kp[order], seg[order], segs)
        tied = lambda at, m: np.bincount(seg[at], m * (m - 1.0) / 2, segs)
        pair = kt[order] * len(mp) + kp[order]
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        one = lambda k: np.unique(k, return_index=True)[1]
        tx, ty, txy = tied(one(kt), mt), tied(one(kp), mp), tied(order[heads], np.diff(np.append(heads, len(pair))))
        out["kendall"] = pa.array([_tau(int(k), *v) if k > 1 else NAN for k, *v in zip(n, tx, ty, txy, swaps, strict=True)], pa.float64())
    if "s" in names:
        # The place of each row by the ties, and by a value from the largest one with the ties.
        by = [k for c in ties for k in _column(t.column(c))[::-1]]
        order = _order(*by)
        place = np.arange(len(seg))
        if order is not None:
            place = np.empty(len(seg), np.int64)
            place[order] = np.arange(len(seg))
        rank = []
        for c in (ct, cp):
            low, high = np.minimum.reduceat(c, starts), np.maximum.reduceat(c, starts)
            order = np.argsort(((low + high)[seg] - c) * len(seg) + place)
            r = np.empty(len(seg), np.int64)
            r[order] = np.arange(len(seg))
            rank.append(r - starts[seg] + 1)
        rt, rp = rank
        for k in shares:
            top = np.maximum(1, np.rint(n * k).astype(np.int64))
            hits = np.bincount(seg[(rt <= top[seg]) & (rp <= top[seg])], minlength=segs)
            out[_share(k)] = pa.array((hits / top) / (top / n))
        na = np.maximum(1.0, np.rint(n * ACTIVE))
        out["na"] = pa.array(na)
        out["s"] = pa.array(np.bincount(seg, np.where(rt <= na[seg], np.exp(-ALPHA * rp / n[seg]), 0.0), segs))
    heads = t.select(list(keys)).take(starts)
    return pa.RecordBatch.from_arrays([*[heads.column(k).combine_chunks() for k in keys], *[out[c] for c in names]], [*keys, *names])


def ordered_metrics(
    rows: DataFrame, sizes: DataFrame, keys: Sequence[str], names: Sequence[str], ties: Sequence[str] = (), shares: Sequence[float] = (), group_rows: int | None = None
) -> DataFrame:
    """keys and those of `names` that need an order of each group's rows: mae with medae, spearman, kendall; with s and na of
    _bedroc_sums also the enrichment of the top shares. sizes: (keys, n) of all groups.

    Rows are shuffled once, by the hash of the keys, and a task takes whole groups at a time, many small ones
    together. Groups beyond GROUP_ROWS rows are never in one piece: windows and ranges order them."""
    limit = GROUP_ROWS if group_rows is None else group_rows
    names = [*names, *map(_share, shares)]
    sized = sizes.agg(F.sum("n"), F.max("n")).first()
    big = sizes.filter(F.col("n") > limit).select(*keys)
    whole = rows if (sized[1] or 0) <= limit else _matched(rows, F.broadcast(big), keys, "left_anti")  # a row for `limit` rows of the input
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    exact = {c: F.col(c).cast("double") for c in ("y_true", "y_pred") if kinds[c].startswith("decimal")}
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(sized[0] or 0) // _TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            h = b.column("__hash").to_numpy()
            if held and sum(x.num_rows for x in held) >= _AT_ONCE and h[-1] != (last := held[-1].column("__hash")[-1].as_py()):
                cut = int(np.searchsorted(h, last, "right"))
                yield _ordered(pa.Table.from_batches([*held, b.slice(0, cut)]), keys, ties, names, shares)
                held, b = [], b.slice(cut)
            if b.num_rows:
                held.append(b)
        if held:
            yield _ordered(pa.Table.from_batches(held), keys, ties, names, shares)

    dealt = whole.withColumns(exact).withColumn("__hash", F.xxhash64(*keys)).repartition(parts, "__hash").sortWithinPartitions("__hash")
    out = dealt.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{c} double" for c in names]]))
    if whole is rows:
        return out
    r = materialise(_matched(rows, F.broadcast(big), keys, "left_semi"))
    parts = [kendall(r, keys).drop("n")] if "kendall" in names else []
    if "medae" in names or "spearman" in names:
        by = Window.partitionBy(*keys)
        e = F.abs(F.col("y_pred") - F.col("y_true"))
        w = r.select(*keys, tied_rank("y_true", keys).alias("rt"), tied_rank("y_pred", keys).alias("rp"), e.alias("e"))
        w = w.withColumns({"place": F.row_number().over(by.orderBy(F.asc_nulls_last("e"))), "m": F.count("e").over(by)})
        # The middle one of an odd number of rows, or the two of an even one.
        middle = F.when((2 * F.col("place") >= F.col("m")) & (2 * F.col("place") <= F.col("m") + 2), F.col("e"))
        parts.append(w.groupBy(*keys).agg(F.avg("e").alias("mae"), F.avg(middle).alias("medae"), correlation(F.col("rt"), F.col("rp")).alias("spearman")))
    if "s" in names:
        parts += [top_k_enrichment(r, keys, shares, ties), _bedroc_sums(r, keys, ties, ALPHA, ACTIVE).drop("n")]
    return out.union(reduce(lambda a, b: _matched(a, b, keys), parts).select(*keys, *[F.col(c).cast("double") for c in names]))


#: Rows of a group that one task counts.
RANGE_ROWS = 200_000
#: Ranges of a group at most.
MAX_RANGES = 1000


def _pairs(counts: np.ndarray) -> float:
    return float((counts * (counts - 1) // 2).sum())


def _tau(n: int, tx: float, ty: float, txy: float, swaps: float) -> float:
    """Tau-b from the pairs that are tied in either value and in both, and those out of order."""
    all_ = n * (n - 1) / 2
    below = math.sqrt((all_ - tx) * (all_ - ty))
    return (all_ - tx - ty + txy - 2 * swaps) / below if below else NAN


def kendall(pred: DataFrame, keys: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Kendall's tau-b by keys, of groups of any size: those of at most range_rows rows are counted in
    a task each, larger ones in ranges of both values."""
    base = pred.select(*keys, F.col("y_true").alias("x"), F.col("y_pred").alias("y"))
    big = materialise(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > range_rows))

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1] for c in "xy")
        n, out = len(x), NAN
        if n > 1:
            tx, ty = (_pairs(np.unique(v, return_counts=True)[1]) for v in (x, y))
            txy = _pairs(np.unique(x * n + y, return_counts=True)[1])
            out = _tau(n, tx, ty, txy, _inversions(y[np.lexsort((y, x))]))
        return pdf.iloc[:1][list(keys)].assign(n=n, kendall=out)

    kinds = ", ".join(f"`{k}` {pred.schema[k].dataType.simpleString()}" for k in keys)
    if big.isEmpty():
        out = base.groupBy(*keys).applyInPandas(tau, f"{kinds}, n long, kendall double")
    else:
        named = big.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__big"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        small = base.join(named, same, "left_anti").groupBy(*keys).applyInPandas(tau, f"{kinds}, n long, kendall double")
        out = small.union(_kendall_of_ranges(base.join(named, same, "left_semi"), big, keys, range_rows))
    return out.withColumn("kendall", F.coalesce("kendall", F.lit(NAN)))


def _kendall_of_ranges(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], range_rows: int) -> DataFrame:
    """(keys, n, kendall) of large groups. Both values are cut at quantiles; a value at a cut is a range of its
    own, in which nothing is out of order. Pairs out of order are those of one range of x, those of
    one range of y but two of x, and those of two ranges of either, which follow from the ranges' counts."""
    ranges = min(MAX_RANGES, -(-sizes.agg(F.max("n")).first()[0] // range_rows))
    cuts = [i / ranges for i in range(1, ranges)]
    edges = rows.groupBy(*keys).agg(*[F.array_distinct(F.percentile_approx(c, cuts, 20 * ranges)).alias(f"__{c}") for c in "xy"])
    named = materialise(edges.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f"__{c}").alias(f"__edges_{c}") for c in "xy"]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    place = lambda c: (2 * F.size(F.filter(f"__edges_{c}", lambda e: e < F.col(c))) + F.array_contains(f"__edges_{c}", F.col(c)).cast("int")).cast("int")
    dealt = materialise(rows.join(named, same).select(*keys, "x", "y", place("x").alias("bx"), place("y").alias("by")))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def swaps(x: np.ndarray, y: np.ndarray) -> int:
        return _inversions(y[np.lexsort((y, x))])

    def of_x(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][list(keys)].assign(swaps=float(swaps(pdf["x"].to_numpy(), pdf["y"].to_numpy())))

    def of_y(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = sum(swaps(p["x"].to_numpy(), p["y"].to_numpy()) for _, p in pdf.groupby("bx"))
        return pdf.iloc[:1][list(keys)].assign(swaps=float(swaps(pdf["x"].to_numpy(), pdf["y"].to_numpy()) - inside))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((pdf["bx"].max() + 2, pdf["by"].max() + 2))
        c[pdf["bx"], pdf["by"]] = pdf["n"]
        # after[i, j]: rows in ranges of x beyond i and of y before j.
        after = c[::-1].cumsum(0)[::-1]
        after = np.vstack([after[1:], np.zeros(c.shape[1])])
        after = np.column_stack([np.zeros(len(c)), after.cumsum(1)[:, :-1]])
        return pdf.iloc[:1][list(keys)].assign(swaps=float((c * after).sum()))

    spec = f"{kinds}, swaps double"
    cells = dealt.groupBy(*keys, "bx", "by").agg(F.count(F.lit(1)).alias("n"))  # 4 * MAX_RANGES ^ 2 a group at most
    found = dealt.filter("bx % 2 = 0").groupBy(*keys, "bx").applyInPandas(of_x, spec)
    found = found.union(dealt.filter("by % 2 = 0").groupBy(*keys, "by").applyInPandas(of_y, spec)).union(cells.groupBy(*keys).applyInPandas(between, spec))
    parts = [found.groupBy(*keys).agg(F.sum("swaps").alias("swaps"))]
    for name, by in (("tx", ["x"]), ("ty", ["y"]), ("txy", ["x", "y"])):
        c = dealt.groupBy(*keys, *by).agg(F.count(F.lit(1)).cast("double").alias("c"))
        parts.append(c.groupBy(*keys).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(name)))
    out = sizes
    for p in parts:
        p = p.select(*[F.col(k).alias(f"__{k}") for k in keys], p.columns[-1])
        out = out.join(p, same).drop(*[f"__{k}" for k in keys])
    all_ = F.col("n").cast("double") * (F.col("n") - 1) / 2
    below = F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty")))
    return out.select(*keys, "n", F.when(below > 0, (all_ - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("swaps")) / below).alias("kendall"))


def fold_report(pred: DataFrame, keys: Sequence[str], ties: Sequence[str], shares: Sequence[float] = (0.05, 0.1, 0.2), group_rows: int | None = None) -> DataFrame:
    """All metrics of a fold as one row by keys: those of fold_metrics, Kendall's tau-b, the
    enrichment of the top shares and BEDROC; all NaN but n below 2 rows. Groups with a null key are left out."""
    rows, plain = _plain_metrics(pred.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])), keys, ties)
    more = ordered_metrics(rows, plain, keys, ("mae", "medae", "spearman", "kendall", "s", "na"), ties, shares, group_rows)
    out = _matched(plain, more, keys).withColumn("bedroc", _bedroc_of(ALPHA))
    return _known(out, keys, ["kendall", *map(_share, shares), "bedroc"])
