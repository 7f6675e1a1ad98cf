"""Distances between two sets of rows, distribution shift and applicability domains.

Nearest-neighbour work is a stated set of queries against all rows: the queries are sent to
the tasks, in as many parts as their number asks for, and meet the rows in blocks of a
batch; each task hands on k rows a query. Moments (means, scatter) are grouped sums of the array places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalforge.operators.splits import range_rank
from evalforge.operators.task_sums import task_sums
from evalforge.sources.scratch import materialise

#: Most query rows that are sent to the tasks at once.
MAX_QUERIES = 200_000
_BLOCK = 256
#: Cells of the cubes that distances without a matrix product are made of.
_CUBE = 4_000_000


def block_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric in ("euclidean", "sqeuclidean"):
        d = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)
        i, j = np.nonzero(d < 1e-9)
        step = max(1, _CUBE // max(1, q.shape[1]))
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            d[a, b] = ((q[a] - x[b]) ** 2).sum(1)
        return np.sqrt(d) if metric == "euclidean" else d
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return 1 - np.divide(q @ x.T, n, out=np.zeros_like(n), where=n > 0)
    if metric in ("cityblock", "jaccard"):
        step = max(1, _CUBE // max(1, len(q) * q.shape[1]))
        return np.concatenate([_cube_distances(metric, q, x[i : i + step]) for i in range(0, len(x), step)], axis=1)
    raise ValueError(f"unknown distance {metric!r}")


def _cube_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "cityblock":
        return np.abs(q[:, None, :] - x[None, :, :]).sum(2)
    low, high = np.minimum(q[:, None, :], x[None, :, :]).sum(2), np.maximum(q[:, None, :], x[None, :, :]).sum(2)
    return 1 - np.divide(low, high, out=np.ones_like(low), where=high > 0)


def k_nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "euclidean", key: str = "vec_id", vector: str = "x") -> DataFrame:
    """(query, key, d): the k nearest rows of each query, other than itself, ties by key."""
    n = queries.count()
    if n > MAX_QUERIES:
        # Each part is answered and written before the next is sent.
        parts = -(-n * 5 // (MAX_QUERIES * 4))
        part = F.pmod(F.xxhash64(key), F.lit(parts))
        done = [materialise(_k_nearest(queries.filter(part == i), rows, k, metric, key, vector)) for i in range(parts)]
        return reduce(DataFrame.union, done)
    return _k_nearest(queries, rows, k, metric, key, vector)


def _k_nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str, key: str, vector: str) -> DataFrame:
    got = queries.select(key, vector).toPandas().sort_values(key)
    n = len(got)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((got[key].to_numpy(), np.array(got[vector].tolist(), float).reshape(n, -1 if n else 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        best: list[pd.DataFrame] = []
        for b in batches:
            if not len(b) or not len(ids):
                continue
            x, keys = np.array(b[vector].tolist(), float), b[key].to_numpy()
            for i in range(0, len(ids), _BLOCK):
                d = block_distances(metric, q[i : i + _BLOCK], x)
                d[ids[i : i + _BLOCK, None] == keys[None, :]] = np.inf
                if d.shape[1] > k:  # all that are not farther than the k-th, for ties go by key
                    r, take = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
                else:
                    r, take = (v.ravel() for v in np.indices(d.shape))
                near = pd.DataFrame({"query": ids[i : i + _BLOCK][r], key: keys[take], "d": d[r, take]})
                best.append(near.sort_values(["query", "d", key]).groupby("query").head(k))
            best = [pd.concat(best).sort_values(["query", "d", key]).groupby("query").head(k)]
        for out in best:
            yield out[np.isfinite(out["d"])]

    kind = rows.schema[key].dataType.simpleString()
    near = rows.select(key, vector).mapInPandas(run, f"query {kind}, {key} {kind}, d double")
    top = near.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", key))), 1, k).alias("top"))
    return top.select("query", F.inline("top")).select("query", key, "d")


def nn_distance(queries: DataFrame, rows: DataFrame, metric: str = "euclidean", key: str = "vec_id", vector: str = "x") -> DataFrame:
    """(query, d): the distance of each query to its nearest row; none for no queries."""
    return k_nearest(queries, rows, 1, metric, key, vector).select("query", "d")


def moments(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """n, mean, variance, least and largest value by keys and array place."""
    places = df.select(*keys, F.posexplode(vector).alias("pos", "v"))
    return places.groupBy(*keys, "pos").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def mean_vector(df: DataFrame, vector: str) -> np.ndarray:
    """The mean by array place: a table as long as one vector."""
    return np.array([r["mean"] for r in moments(df, vector).orderBy("pos").collect()])


def scatter(df: DataFrame, vector: str, center: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of outer products of centred rows and their number: each task sums its own."""
    p = len(center)

    def made(b: pd.DataFrame) -> np.ndarray:
        x = np.array(b[vector].tolist(), float) - center
        return np.append((x.T @ x).ravel(), len(b))

    s = task_sums(df.select(vector), made, p * p + 1)
    return s[:-1].reshape(p, p), int(s[-1])


def pooled_covariance(a: DataFrame, b: DataFrame, vector: str) -> np.ndarray:
    total, weight = 0.0, 0
    for df in (a, b):
        s, n = scatter(df, vector, mean_vector(df, vector))
        if n > 1:
            total, weight = total + s, weight + n - 1
    if not weight:
        raise ValueError("no set has two rows")
    return total / weight


def mahalanobis_split_distance(a: DataFrame, b: DataFrame, vector: str = "x") -> float:
    """Half the sum of both sets' mean squared whitened distances to the other set's mean."""
    cov = pooled_covariance(a, b, vector)
    p = len(cov)
    try:
        low = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        low = np.linalg.cholesky(cov + np.eye(p) * 1e-6 * np.trace(cov) / p)
    inverse = np.linalg.inv(low)
    out = 0.0
    for own, other in ((a, b), (b, a)):
        s, n = scatter(own, vector, mean_vector(other, vector))
        out += np.trace(inverse @ s @ inverse.T) / n / 2
    return float(out)


def mmd_linear(df: DataFrame, side: str, vector: str = "x") -> DataFrame:
    """Squared maximum mean discrepancy of two sides (a boolean column) under the linear
    kernel: the squared distance of the mean vectors."""
    m = moments(df.withColumn("__s", F.col(side).cast("int")), vector, "__s")
    d = m.groupBy("pos").agg((F.max(F.when(F.col("__s") == 1, F.col("mean"))) - F.max(F.when(F.col("__s") == 0, F.col("mean")))).alias("d"))
    return d.agg(F.sum(F.col("d") * F.col("d")).alias("mmd"))


def mean_kernel(queries: DataFrame, rows: DataFrame, kernel: str = "sqexp", vector: str = "x") -> float:
    """Mean kernel value between a stated set of queries and all rows, in blocks; queries are
    sent in as many parts as their number asks for."""
    n = queries.count()
    parts = max(1, -(-n // MAX_QUERIES))
    part = F.pmod(F.xxhash64(vector), F.lit(parts))
    sums = [_kernel_sums(queries.filter(part == i) if parts > 1 else queries, rows, kernel, vector) for i in range(parts)]
    if not n or not sums[0][1]:
        raise ValueError("an empty set has no mean kernel")
    return sum(s for s, _ in sums) / (sums[0][1] * n)


def _kernel_values(kernel: str, q: np.ndarray, x: np.ndarray, degree: int = 2, offset: float = 0.0) -> np.ndarray:
    if kernel == "sqexp":
        return np.exp(-block_distances("sqeuclidean", q, x) / 2)
    if kernel == "linear":
        return q @ x.T
    if kernel == "polynomial":
        return (q @ x.T + offset) ** degree
    raise ValueError(f"unknown kernel {kernel!r}; known: linear, polynomial, sqexp")


def _kernel_sums(queries: DataFrame, rows: DataFrame, kernel: str, vector: str) -> tuple[float, int]:
    q = np.array(queries.select(vector).toPandas()[vector].tolist(), float)
    sent = rows.sparkSession.sparkContext.broadcast(q)
    _kernel_values(kernel, np.zeros((1, 1)), np.zeros((1, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for b in batches:
            if len(b):
                x = np.array(b[vector].tolist(), float)
                total += sum(float(_kernel_values(kernel, sent.value[i : i + _BLOCK], x).sum()) for i in range(0, len(sent.value), _BLOCK))
                n += len(x)
        yield pd.DataFrame({"s": [total], "n": [n]})

    r = rows.select(vector).mapInPandas(run, "s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return float(r["s"] or 0.0), int(r["n"] or 0)


def mmd(a: DataFrame, b: DataFrame, kernel: str = "sqexp", vector: str = "x") -> float:
    """Biased squared maximum mean discrepancy of two stated sets, by the linear, the
    squared-exponential or the polynomial (x.y)^2 kernel."""
    return mean_kernel(a, a, kernel, vector) + mean_kernel(b, b, kernel, vector) - 2 * mean_kernel(a, b, kernel, vector)


def bounding_box_scores(train: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """Share of a row's features outside the training range; in domain if there is none."""
    box = F.broadcast(moments(train, vector).select("pos", "low", "high"))  # as long as one vector
    places = rows.select(key, F.posexplode(vector).alias("pos", "v")).join(box, "pos")
    out = (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))
    return places.groupBy(key).agg(F.avg(out.cast("double")).alias("score")).withColumn("in_domain", F.col("score") == 0)


def knn_domain(train: DataFrame, rows: DataFrame, k: int = 5, z: float = 1.5, metric: str = "cosine", key: str = "vec_id", vector: str = "x") -> DataFrame:
    """Mean distance to the k nearest training rows, against mean + z standard deviations of
    the leave-one-out scores of all training rows. Of n training rows, k is at most n - 1 for
    these and n for others; a row that is itself a training row does not meet itself."""
    train = materialise(train.select(key, vector))
    n = train.count()
    own = k_nearest(train, train, max(1, min(k, n - 1)), metric, key, vector).groupBy("query").agg(F.avg("d").alias("d"))
    limit = own.agg((F.avg("d") + z * F.coalesce(F.stddev_samp("d"), F.lit(float("nan")))).alias("limit"))
    score = k_nearest(rows, train, max(1, min(k, n)), metric, key, vector).groupBy("query").agg(F.avg("d").alias("score"))
    inside = (F.col("score") <= F.col("limit")) & ~F.isnan("limit")
    return score.crossJoin(F.broadcast(limit)).select(F.col("query").alias(key), "score", inside.alias("in_domain"))  # one limit


def tanimoto_domain(train_bits: DataFrame, bits: DataFrame, key: str, bit: str = "bit", z: float = 1.5) -> DataFrame:
    """(key, score, in_domain): the largest Tanimoto similarity of each set of bits to another
    training set, against mean - z standard deviations of the training sets' own, kept between
    0 and 1. Sets are (key, bit) rows."""
    own = nn_tanimoto(train_bits, train_bits, key, bit)
    limit = own.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("similarity") - z * F.stddev_samp("similarity"))).alias("limit"))
    score = nn_tanimoto(bits, train_bits, key, bit)
    return score.crossJoin(F.broadcast(limit)).select(F.col("query").alias(key), F.col("similarity").alias("score"), (F.col("similarity") >= F.col("limit")).alias("in_domain"))  # one limit


def leverage_domain(train: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """Hat values with an intercept, against 3 (p + 1) / n. The p x p inverse is made of the
    tasks' summed products and sent to the tasks."""
    one = train.select(F.concat(F.array(F.lit(1.0)), vector).alias(vector))
    p = one.select(F.size(vector)).first()[0]
    gram, n = scatter(one, vector, np.zeros(p))
    inverse = np.linalg.pinv(gram)
    sent = rows.sparkSession.sparkContext.broadcast(inverse)

    def hats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b[vector].tolist(), float).reshape(len(b), -1)
            x = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, p))
            yield pd.DataFrame({key: b[key], "score": ((x @ sent.value) * x).sum(1)})

    score = rows.select(key, vector).mapInPandas(hats, f"{key} {rows.schema[key].dataType.simpleString()}, score double")
    return score.withColumn("in_domain", F.col("score") <= 3 * p / n)


def knn_regression(train: DataFrame, rows: DataFrame, target: str, k: int, weighted: bool = True, metric: str = "euclidean", key: str = "vec_id", vector: str = "x") -> DataFrame:
    """Predictions from the k nearest training rows, uniform or by inverse distance; rows
    that match exactly give the mean of their matches."""
    near = k_nearest(rows, train, k, metric, key, vector).join(train.select(key, F.col(target).cast("double").alias("t")), key)
    zero = F.col("d") <= 1e-12
    exact = F.avg(F.when(zero, F.col("t")))
    w = F.when(~zero, 1 / F.col("d")) if weighted else F.lit(1.0)
    return near.groupBy("query").agg(F.coalesce(exact, F.sum(w * F.col("t")) / F.sum(w)).alias("prediction")).withColumnRenamed("query", key)


def directed_hausdorff(queries: DataFrame, rows: DataFrame, metric: str = "euclidean", key: str = "vec_id", vector: str = "x") -> DataFrame:
    """The largest distance of a query to its nearest row; one row, null for no queries."""
    return nn_distance(queries, rows, metric, key, vector).agg(F.max("d").alias("hausdorff"))


def hausdorff(a: DataFrame, b: DataFrame, metric: str = "euclidean", key: str = "vec_id", vector: str = "x") -> DataFrame:
    """The larger of both directed distances; both sets are queries of the other."""
    return directed_hausdorff(a, b, metric, key, vector).union(directed_hausdorff(b, a, metric, key, vector)).agg(F.max("hausdorff").alias("hausdorff"))


def covariance_table(cov: np.ndarray, spark) -> DataFrame:
    """(i, j, v) of a matrix as long as a vector is wide."""
    p = len(cov)
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(p) for j in range(p)], "i int, j int, v double")


def split_metrics(df: DataFrame, side: str, vector: str = "x") -> DataFrame:
    """Sizes, width, mean of all values and share of values above zero of both sides, and the
    gap of these shares; one pass."""
    v = df.select(F.col(side).alias("s"), vector, F.size(vector).alias("p")).withColumn("t", F.aggregate(vector, F.lit(0.0), lambda a, x: a + x))
    v = v.withColumn("on", F.size(F.filter(vector, lambda x: x > 0)))
    side_of = lambda c, yes: F.when(F.col("s") if yes else ~F.col("s"), c)
    aggs = []
    for name, yes in (("train", True), ("test", False)):
        cells = F.sum(side_of(F.col("p"), yes))
        aggs += [F.count(side_of(F.lit(1), yes)).alias(f"n_{name}"), (F.sum(side_of(F.col("t"), yes)) / cells).alias(f"mean_{name}"), (F.sum(side_of(F.col("on"), yes)) / cells).alias(f"share_{name}")]
    return v.agg(F.max("p").alias("n_features"), *aggs).withColumn("sparsity_gap", F.abs(F.col("share_train") - F.col("share_test")))


def bit_split_metrics(bits: DataFrame, side: str, key: str, bit: str = "bit") -> DataFrame:
    """One row of a split of sets of bits: sizes of both sides, mean and standard deviation of
    the test sets' largest similarity to a training set, the Jensen-Shannon divergence of bit
    frequencies, and the share of the test sets' bits that a training set has too."""
    bits = materialise(bits.select(key, side, bit))
    train, test = bits.filter(side), bits.filter(~F.col(side))
    near = nn_tanimoto(test.select(key, bit), train.select(key, bit), key, bit)
    near = near.agg(F.avg("similarity").alias("nn_mean"), F.stddev_samp("similarity").alias("nn_std"))
    sizes = bits.select(key, side).distinct().agg(F.count_if(side).alias("n_train"), F.count_if(~F.col(side)).alias("n_test"))
    f = bits.groupBy(bit).agg(F.count_if(side).alias("a"), F.count_if(~F.col(side)).alias("b")).crossJoin(F.broadcast(sizes))  # one row of sizes
    p, q = F.col("a") / F.col("n_train"), F.col("b") / F.col("n_test")
    term = lambda x: F.when(x > 0, 0.5 * x * F.ln(x / ((p + q) / 2))).otherwise(0.0)
    f = f.agg(
        F.max("n_train").alias("n_train"), F.max("n_test").alias("n_test"), F.sum(term(p) + term(q)).alias("js"),
        (F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.count_if(F.col("b") > 0)).alias("coverage"),
    )
    return f.crossJoin(F.broadcast(near))  # one row each


#: Similarities that are asked for one after the other; what is below the last is searched by each query's own bound.
TANIMOTO_ROUNDS = (0.7, 0.4, 0.2)
#: Rows that every query is compared with first, for a bound.
TANIMOTO_SAMPLE = 128


def bit_sets(bits: DataFrame, ranks: DataFrame, key: str, bit: str) -> DataFrame:
    """(key, n, r): sets as arrays of their bits' ranks, rarest first."""
    b = bits.select(key, bit).distinct().join(ranks, bit)
    return b.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list("rank")).alias("r"))


def tanimoto_candidates(queries: DataFrame, sets: DataFrame, least: Column, floor: float) -> DataFrame:
    """(query, k) that may reach the similarity `least` of a query's row (n, r, best), which is at least floor: a pair that
    shares two bits or more, and as many as the similarity asks for, shares one of the first bits of both in order of
    rarity, and neither set is much larger than the other. The commonest bits come last and are not looked up."""
    need = lambda t, n: F.greatest(F.lit(2), F.ceil(t * n - 1e-9)).cast("int")
    first = lambda n, must: F.slice("r", F.lit(1), F.greatest(F.lit(0), n - must + 1))
    q = queries.select("query", F.col("n").alias("nq"), least.alias("least"), F.explode(first(F.col("n"), need(least, F.col("n")))).alias("bit"))
    s = sets.select("k", "n", F.explode(first(F.col("n"), need(F.lit(floor), F.col("n")))).alias("bit"))
    fits = (F.col("n") >= F.col("least") * F.col("nq") - 1e-9) & (F.col("nq") >= F.col("least") * F.col("n") - 1e-9)
    return q.join(s, "bit").filter(fits & (F.col("k") != F.col("query"))).select("query", "k").distinct()


#: Bits of queries that are sent to the tasks at once, and the most turns of that; more queries are searched through the index.
TANIMOTO_BITS, TANIMOTO_TURNS = 4_000_000, 64


def nn_tanimoto(query_bits: DataFrame, bits: DataFrame, key: str, bit: str = "bit") -> DataFrame:
    """(query, similarity): the largest Tanimoto similarity of each query's set of bits to another row's; 0 if
    none shares a bit. Sets are (key, bit) rows.

    Queries are sent to the tasks as lists of the queries that hold a bit, TANIMOTO_BITS at a time. A task counts what
    each of its rows shares with all of them and hands on one number a query, so no pair is ever written. Where that
    would take more than TANIMOTO_TURNS passes, sets are searched through an index of their rarest bits.
    """
    asked = materialise(query_bits.groupBy(F.col(key).alias("query")).agg(F.collect_set(bit).alias("b")))
    turns = -(-(asked.agg(F.sum(F.size("b"))).first()[0] or 0) // TANIMOTO_BITS)
    if turns > TANIMOTO_TURNS:
        return _nn_by_index(query_bits, bits, key, bit)
    sets = materialise(bits.groupBy(F.col(key).alias("k")).agg(F.collect_set(bit).alias("b")))
    part = F.pmod(F.xxhash64("query"), F.lit(max(1, turns)))
    met = reduce(DataFrame.union, [materialise(_nn_counted(asked.filter(part == i), sets)) for i in range(max(1, turns))])
    return asked.join(met, "query", "left").select("query", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def _nn_counted(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(query, similarity) of the queries (query, b) that share a bit with another row of sets (k, b)."""
    got = asked.toArrow()  # TANIMOTO_BITS bits or so
    sizes = pc.list_value_length(got.column("b")).to_numpy().astype(np.int64)
    held = pd.Index(pc.list_flatten(got.column("b")).to_pandas())
    universe = held.unique()
    place = universe.get_indexer(held)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(universe) + 1))
    sent = asked.sparkSession.sparkContext.broadcast((got.column("query").to_pandas(), sizes, universe, np.repeat(np.arange(len(sizes)), sizes)[order], starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n, bits, holders, starts = sent.value
        names, best = pd.Index(queries), np.zeros(len(n))
        for b in batches:
            own = names.get_indexer(b.column("k").to_pandas())
            size = pc.list_value_length(b.column("b")).to_numpy(zero_copy_only=False)
            at = bits.get_indexer(b.column("b").flatten().to_pandas())
            ends = np.cumsum(size)
            for i in range(b.num_rows):
                mine = at[ends[i] - size[i] : ends[i]]
                lists = [holders[starts[j] : starts[j + 1]] for j in mine[mine >= 0].tolist()]
                if lists:
                    both = np.bincount(np.concatenate(lists), minlength=len(n))
                    if own[i] >= 0:
                        both[own[i]] = 0
                    np.maximum(best, both / (n + size[i] - both), out=best)
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(queries.iloc[some], type=kind), pa.array(best[some])], ["query", "similarity"])

    kind = got.schema.field("query").type
    spec = f"query {asked.schema['query'].dataType.simpleString()}, similarity double"
    return sets.mapInArrow(run, spec).groupBy("query").agg(F.max("similarity").alias("similarity"))


def _nn_by_index(query_bits: DataFrame, bits: DataFrame, key: str, bit: str) -> DataFrame:
    """The result of nn_tanimoto for very many queries.

    A pair that shares one bit has a similarity that follows from the sizes, so the smallest other sets of each bit
    give a bound that is right for such pairs; a few rows that all queries are compared with give another. Pairs that share
    more are searched by falling similarity through an index of each set's rarest bits, verified
    exactly, and a query that has found one is not asked again.
    """
    own = materialise(bits.select(key, bit).distinct())
    asked = materialise(query_bits.select(key, bit).distinct())
    counts = own.groupBy(bit).agg(F.count(F.lit(1)).alias("c"))
    ranks = materialise(range_rank(counts, F.asc("c"), F.asc(bit)).select(bit, F.col("rank").cast("long").alias("rank")))
    sets = materialise(bit_sets(own, ranks, key, bit).withColumnRenamed(key, "k"))
    extra = asked.join(ranks, bit, "left_anti").groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("more"))
    held = bit_sets(asked, ranks, key, bit)
    q = asked.select(key).distinct().join(held, key, "left").join(extra, key, "left")
    # Bits that no row has count for the size only.
    q = materialise(q.select(F.col(key).alias("query"), (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("r", F.array().cast("array<long>")).alias("r")))
    # The two smallest sets of each bit: one of them is not the query's own.
    least = sets.select(F.explode("r").alias("rank"), F.struct("n", "k").alias("s"))
    least = least.withColumn("i", F.row_number().over(Window.partitionBy("rank").orderBy("s"))).filter("i <= 2").groupBy("rank").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    one = q.select("query", "n", F.explode("r").alias("rank")).join(least, "rank")
    other = F.filter("ss", lambda s: s["k"] != F.col("query"))
    one = one.withColumn("o", other).filter(F.size("o") > 0).groupBy("query").agg(F.max(1 / (F.col("n") + F.col("o")[0]["n"] - 1)).alias("bound"))
    some = sets.orderBy(F.xxhash64("k"), "k").limit(TANIMOTO_SAMPLE).select(F.col("k").alias("sk"), F.col("r").alias("sr"))
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    tanimoto = lambda both, a, b: both / (a + b - both)
    # TANIMOTO_SAMPLE rows at most are sent to the queries.
    drawn = q.join(F.broadcast(some.agg(F.collect_list(F.struct("sk", "sr")).alias("ss"))))
    sims = F.transform(F.filter("ss", lambda s: s["sk"] != F.col("query")), lambda s: tanimoto(shared(F.col("r"), s["sr"]), F.col("n"), F.size(s["sr"])))
    drawn = drawn.select("query", F.coalesce(F.array_max(sims), F.lit(0.0)).alias("seen"))
    q = materialise(q.join(one, "query", "left").join(drawn, "query", "left").select("query", "n", "r", F.greatest(F.coalesce("bound", F.lit(0.0)), F.coalesce("seen", F.lit(0.0))).alias("best")))
    # What lies at or above `searched` is known; below it a query asks for more than its best.
    searched = 2.0
    for t in (*TANIMOTO_ROUNDS, 0.0):
        open_, searched = q.filter(F.col("best") < searched), t
        if open_.isEmpty():
            continue
        floor = t or (open_.agg(F.min("best")).first()[0] or 0.0)
        pairs = tanimoto_candidates(open_, sets, F.greatest(F.lit(t), "best"), floor)
        met = pairs.join(open_.select("query", F.col("n").alias("nq"), F.col("r").alias("rq")), "query").join(sets, "k")
        met = met.select("query", tanimoto(shared("rq", "r"), F.col("nq"), F.col("n")).alias("s")).groupBy("query").agg(F.max("s").alias("s"))
        q = materialise(q.join(met, "query", "left").select("query", "n", "r", F.greatest("best", F.coalesce("s", F.lit(0.0))).alias("best")))
    return q.select("query", F.col("best").alias("similarity"))
