"""Exact top-k search of integer vectors by a Voronoi k-nearest-neighbour join.

The largest inner products are the smallest distances once every candidate c has one more
coordinate, sqrt(M^2 - |c|^2) with M the largest norm, and every query a 0 there. Pivots are drawn
from the candidates; queries and candidates belong to the cell of their nearest pivot. A cell's
summary holds its queries' largest distance U to the pivot and its k + 1 candidates nearest to it. From
these a bound theta on the k-th distance of all its queries follows by the triangle inequality
(k + 1, for a query is no neighbour of itself). A candidate at distance d of pivot j can only
matter to queries of cell i if |p_i p_j| - U - theta <= d <= |p_i p_j| + U + theta; cells of queries are
put into groups, and a candidate is sent to the groups that it can matter to. Each group is then solved
by matrix products.

Scale: pivots and summaries have a fixed bound (PIVOTS cells, so PIVOTS squared routes). A group has
GROUP_QUERIES queries; a cell that has more is split by hash, and the candidates of a group are
cut into strips by hash, so that equal vectors, or one crowded cell, are many tasks. A task
streams candidates past at most its group's queries and keeps k of each. Where the data have no
structure (many independent coordinates) no bound excludes anything and the work is that of all
pairs of a query and a candidate, as it must be for an exact answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small

K = 5
#: Cells at most; there are sqrt(candidates) of them before that.
PIVOTS = 512
#: And their components in all.
PIVOT_COMPONENTS = 1 << 22
GROUP_QUERIES = 1024
STRIP_ROWS = 50_000
#: Candidates that a product takes at once.
CHUNK = 2048
#: Distances are doubles: bounds are widened by this share.
SLACK = 1e-7
#: Products up to this are exact in doubles, and leave room for a candidate's place in 64 bits.
EXACT = 1 << 50
NONE = np.iinfo(np.int64).min


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null if the vector or a component is null, not a number or
    infinite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * factor)))


def by_length(vectors: pd.Series | list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = np.fromiter((len(v) for v in vectors), np.int64, len(vectors))
    rows = [np.flatnonzero(sizes == n) for n in np.unique(sizes)]
    vectors = list(vectors)
    return [(r, np.array([vectors[i] for i in r], np.int64).reshape(len(r), -1)) for r in rows]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; components that the shorter side lacks are 0."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * n
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, NONE + 1, -NONE - 1).astype(np.int64)


def top(scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row by score, then id (unknown ones last), then key; NONE scores are absent."""
    order = np.lexsort((keys, ids, unknown, ~scores), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, ids, unknown, keys))


class Best:
    """The k best candidates of a block of queries while candidates stream by."""

    def __init__(self, keys: np.ndarray, vectors: list, k: int):
        self.keys, self.parts, self.k = keys, by_length(vectors), k
        self.state = [np.full((len(keys), k), NONE), *(np.zeros((len(keys), k), t) for t in (np.int64, bool, np.int64))]

    def add(self, keys: np.ndarray, ids: np.ndarray, unknown: np.ndarray, vectors: list) -> None:
        for rows, c in by_length(vectors):
            # In the order of ties, so that a place in it can stand behind the score in one number.
            rows_sorted = np.lexsort((keys[rows], ids[rows], unknown[rows]))
            own, c = rows[rows_sorted], c[rows_sorted]
            for mine, q in self.parts:
                s = products(q, c)
                s[self.keys[mine][:, None] == keys[own][None, :]] = NONE
                if len(own) > self.k:
                    most = int(max(abs(int(s.max())), abs(int(np.where(s == NONE, 0, s).min()))))
                    if most < 1 << 50:
                        ranked = np.where(s == NONE, NONE, s * CHUNK + np.arange(len(own) - 1, -1, -1))
                        keep = np.argpartition(~ranked, self.k - 1, axis=1)[:, : self.k]
                    else:
                        keep = np.argsort(~s, axis=1, kind="stable")[:, : self.k]
                else:
                    keep = np.broadcast_to(np.arange(len(own)), s.shape)
                new = (np.take_along_axis(s, keep, 1), *(x[own][keep] for x in (ids, unknown, keys)))
                both = [np.concatenate([old[mine], n], axis=1) for old, n in zip(self.state, new, strict=True)]
                for old, n in zip(self.state, top(*both, self.k), strict=True):
                    old[mine] = n


def _summaries(assigned: DataFrame, k: int) -> tuple[pd.DataFrame, dict[int, list[float]]]:
    """Of each cell: rows, queries, the largest distance of a query and of a candidate; and its k + 1
    candidates nearest to the pivot. At most PIVOTS * (k + 2) rows."""
    cells = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("long")).alias("queries"), F.max(F.when(F.col("query"), F.col("q_dist"))).alias("reach"), F.max("dist").alias("radius")).toPandas()
    near = assigned.select("cell", "dist").withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).filter(F.col("i") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for c, d in near.select("cell", "dist").collect():
        nearest.setdefault(c, []).append(d)
    return cells, nearest


def routes(cells: pd.DataFrame, nearest: dict[int, list[float]], between: np.ndarray, k: int, group_queries: int) -> pd.DataFrame:
    """(cell, to, low, high, blocks): candidates of cell at a distance from low to high of its pivot go to the query
    cells' group `to`, which is solved in so many blocks of queries; and the group of each query cell."""
    asked = cells[cells["queries"] > 0].set_index("cell")
    data = cells.set_index("cell")["radius"]
    groups, size = {}, {}
    # Neighbouring cells share a group as long as they fit.
    left, g = set(asked.index), -1
    while left:
        g, at = g + 1, max(left, key=lambda c: (asked["queries"][c], -c))
        groups[g], size[g] = [], 0
        for c in sorted(left, key=lambda c: (between[at, c], c)):
            if not groups[g] or size[g] + asked["queries"][c] <= group_queries:
                groups[g].append(c)
                size[g] += int(asked["queries"][c])
            else:
                break
        left -= set(groups[g])
    points = np.array([(c, d) for c, ds in nearest.items() for d in ds])
    out = []
    for g, members in groups.items():
        low, high = np.full(len(between), np.inf), np.full(len(between), -np.inf)
        for i in members:
            reach = asked["reach"][i]
            far = np.sort(reach + between[i, points[:, 0].astype(int)] + points[:, 1])
            theta = far[k] if len(far) > k else np.inf
            slack = SLACK * (1 + reach + between[i].max() + (theta if np.isfinite(theta) else 0))
            low, high = np.minimum(low, between[i] - reach - theta - slack), np.maximum(high, between[i] + reach + theta + slack)
        for j, radius in data.items():
            if radius >= low[j]:
                out.append((int(j), g, low[j], high[j], math.ceil(size[g] / group_queries)))
    of = {c: g for g, members in groups.items() for c in members}
    return pd.DataFrame(out, columns=["cell", "to", "low", "high", "blocks"]), pd.DataFrame({"cell": list(of), "to": list(of.values())})


def nearest(
    rows: DataFrame, is_query: Column, id_col: str, vector: Column, k: int = K, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, strip_rows: int = STRIP_ROWS
) -> DataFrame:
    """(query_id, rank, id_col, score): the k candidates of largest inner product of each row where is_query holds,
    among all other rows; vector is an array of longs, null for rows that take no part.

    Ties go to the smaller id, null ids last and in any fixed order. A row whose is_query is null asks nothing. Rows that
    repeat an id are rows like any other: each may ask, and each finds the others. Components that one of
    two vectors lacks count 0. Scores beyond 64 bits are cut off there. Fewer than k candidates
    are all returned; empty tables give no rows; other columns are ignored. Vectors of any length are read whole.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    # Ids travel with a mark for null: pandas would make doubles of them.
    known = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    v = rows.select(known.alias("id"), F.col(id_col).isNull().alias("unknown"), vector.alias("z"), F.coalesce(is_query, F.lit(False)).alias("query")).filter("z IS NOT NULL")
    square = F.aggregate("z", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = scratch.save(v.withColumns({"key": F.monotonically_increasing_id(), "square": square}), "vectors")
    n, most, longest = v.agg(F.count("*"), F.max("square"), F.max(F.size("z"))).first()
    m = max(1, min(pivots, math.isqrt(n), PIVOT_COMPONENTS // max(1, longest or 1)))
    drawn = v.select("z", "square").orderBy(F.xxhash64("key"), "key").limit(m).collect()
    middle = [(rows, z.astype(float)) for rows, z in by_length([r["z"] for r in drawn])]
    lifted = lambda square: np.sqrt(np.maximum(most - square, 0.0))
    pivot_square = np.array([r["square"] for r in drawn], float)
    pivot_lift = lifted(pivot_square) if n else pivot_square

    def inner(z: np.ndarray) -> np.ndarray:
        out = np.zeros((len(z), len(drawn)))
        for at, p in middle:
            w = min(z.shape[1], p.shape[1])
            out[:, at] = z[:, :w] @ p[:, :w].T
        return out

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), CHUNK):
                p = part.iloc[lo : lo + CHUNK]
                sq = p["square"].to_numpy(float)
                dots = np.zeros((len(p), len(drawn)))
                for at, z in by_length(p["z"]):
                    dots[at] = inner(z.astype(float))
                as_row = np.sqrt(np.maximum(sq[:, None] + pivot_square - 2 * dots + (lifted(sq)[:, None] - pivot_lift) ** 2, 0))
                cell = as_row.argmin(axis=1)
                here = np.arange(len(p))
                # A query lies elsewhere than its own row as a candidate: its last coordinate is 0.
                as_query = np.sqrt(np.maximum(sq + pivot_square[cell] - 2 * dots[here, cell] + pivot_lift[cell] ** 2, 0))
                yield p.drop(columns="square").assign(cell=cell, dist=as_row[here, cell], q_dist=as_query)

    assigned = scratch.save(v.mapInPandas(assign, "id long, unknown boolean, z array<long>, query boolean, key long, cell int, dist double, q_dist double"), "cells")
    cells, near = _summaries(assigned, k)
    dots = np.zeros((len(drawn), len(drawn)))
    for at, p in middle:
        dots[at] = inner(p)
    between = np.sqrt(np.maximum(pivot_square[:, None] + pivot_square - 2 * dots + (pivot_lift[:, None] - pivot_lift) ** 2, 0))
    ways, groups = routes(cells, near, between, k, group_queries)
    if not len(ways):
        ways, groups = pd.DataFrame([(-1, -1, 0.0, 0.0, 1)], columns=ways.columns), pd.DataFrame([(-1, -1)], columns=groups.columns)
    # Routes end at PIVOTS squared rows and query cells at PIVOTS, so their broadcasts have a bound.
    ways = scratch.save(spark.createDataFrame(ways, "cell int, to int, low double, high double, blocks int"), "routes")
    groups = scratch.save(spark.createDataFrame(groups, "cell int, to int"), "groups")
    sent = assigned.join(small(ways), "cell").filter("dist BETWEEN low AND high")
    strips = sent.groupBy("to").agg(F.ceil(F.count("*") / strip_rows).cast("int").alias("strips"), F.max("blocks").alias("blocks"))
    strips = scratch.save(strips, "strips")
    of = lambda name, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    asked = assigned.filter("query").join(small(groups), "cell").join(small(strips), "to").select("to", of("blocks", "block").alias("block"), every("strips").alias("strip"), F.lit(0).alias("kind"), "key", "id", "unknown", "z")
    given = sent.drop("blocks").join(small(strips), "to").select("to", every("blocks").alias("block"), of("strips", "strip").alias("strip"), F.lit(1).alias("kind"), "key", "id", "unknown", "z")
    task = ["to", "block", "strip"]
    work = asked.unionByName(given).repartition(*task).sortWithinPartitions(*task, "kind")

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, best = None, [], None

        def found() -> Iterator[pd.DataFrame]:
            if best is not None:
                s, i, u, c = best.state
                q = np.repeat(np.arange(len(best.keys)), k)
                real = s.ravel() != NONE
                yield pd.DataFrame({"q_key": best.keys[q], "score": s.ravel(), "c_key": c.ravel(), "id": i.ravel(), "unknown": u.ravel()})[real]

        for part in parts:
            for name, p in part.groupby([*task, "kind"], sort=False):
                if name[:3] != now:
                    yield from found()
                    now, held, best = name[:3], [], None
                if name[3] == 0:
                    held.append(p)
                    continue
                if held:
                    asking = pd.concat(held)
                    best, held = Best(asking["key"].to_numpy(), list(asking["z"]), k), []
                for lo in range(0, len(p) if best is not None else 0, CHUNK):
                    c = p.iloc[lo : lo + CHUNK]
                    best.add(c["key"].to_numpy(), c["id"].to_numpy(), c["unknown"].to_numpy(), list(c["z"]))
        yield from found()

    found = work.mapInPandas(solve, "q_key long, score long, c_key long, id long, unknown boolean")
    order = Window.partitionBy("q_key").orderBy(F.col("score").desc(), "unknown", "id", "c_key")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    real = F.when(~F.col("unknown"), F.col("id"))
    names = assigned.filter("query").select(F.col("key").alias("q_key"), real.alias("query_id"))
    return found.join(names, "q_key").select("query_id", F.col("rank").cast("int").alias("rank"), real.alias(id_col), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS z FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""
