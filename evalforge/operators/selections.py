"""Greedy selections over whole tables: farthest pairs, farthest-first orders, OptiSim and dissimilarity
selection.

Every pick depends on all before it, so the rule itself is sequential; what is distributed is the state, each
row's distance to its nearest pick, beside the rows, which are written once. Distances only fall. So the driver takes the rows that lead
(BATCH_VALUES numbers of vectors at most), and carries the rule on among them alone for as long as the
leader cannot be beaten by a row left behind, whose distance at the time of the batch is a bound on what it has now.
All these picks are then brought to the whole table in one pass, as a matrix product in each task. The result
is that of the plain rule over all rows; the work is rows times picks, which it cannot be below, but the number of
passes is that of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalforge.operators.distances import block_distances
from evalforge.operators.stored import DISTANCE_VALUES, ROWS_AT_ONCE, Halves, Stored, met, points, read, row_distances, store
from evalforge.sources.scratch import materialise

#: Numbers of the vectors that the driver holds at a time.
BATCH_VALUES = 1 << 20
BATCH_ROWS = 4096
#: Rows on either side of a block of pairs.
PAIR_BLOCK = 8192
PIVOTS = 16
#: Distances that a task makes at once.
STEP_VALUES = 1 << 21
#: Distances are told apart to so many places, as sums of products in other orders differ in the last ones.
PLACES = 9


@dataclass
class Geometry:
    """Distances of rows with a vector x and a number y: of x by a metric that keeps the triangle inequality, after
    a linear map if there is one, divided by x_scale; plus that of y divided by y_scale where it counts."""

    metric: str = "euclidean"
    linear: np.ndarray | None = None
    x_scale: float = 1.0
    y_scale: float | None = None

    def mapped(self, x) -> np.ndarray:
        x = np.array(list(x), float)
        return x if self.linear is None or not len(x) else x @ self.linear

    def between(self, xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray) -> np.ndarray:
        d = block_distances(self.metric, xa, xb) / self.x_scale
        if self.y_scale is not None:
            d = d + np.abs(ya[:, None] - yb[None, :]) / self.y_scale
        return np.round(d, PLACES)


def _rows(df: DataFrame, key: str, vector: str, target: str | None) -> Stored:
    return store(df, key, vector, y=F.col(target).cast("double") if target else F.lit(0.0))


def _batch_rows(first: pd.DataFrame) -> int:
    wide = max(1, len(first["x"].iloc[0]) if len(first) else 1)
    return int(min(BATCH_ROWS, max(16, BATCH_VALUES // wide)))


def farthest_pair(df: DataFrame, geometry: Geometry, key: str = "vec_id", vector: str = "x", target: str | None = None) -> tuple | None:
    """(a, b, distance) of the two rows farthest apart, a < b, the least a and then b of equals; null for fewer than
    two rows.

    Distances from a few pivots bound each row's largest distance (its own to a pivot and the pivot's
    largest), and the farthest row of each pivot, taken as a pivot too, gives a pair that must be beaten. Rows and
    pairs of files whose bound is below that are left out; the rest are compared by tasks that read files from the shared folder.
    """
    held = _rows(df, key, vector, target)
    rows, kind = held.rows, held.kind
    seeds = rows.orderBy(F.xxhash64("k"), "k").limit(PIVOTS).toPandas()
    if len(seeds) < 2:
        return None

    def measured(pivots: pd.DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((geometry, geometry.mapped(pivots["x"]), pivots["y"].to_numpy(float)))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, px, py = sent.value
            for p in parts:
                if len(p):
                    yield p.assign(d=list(g.between(g.mapped(p["x"]), p["y"].to_numpy(float), px, py)))

        return rows.mapInPandas(run, f"k {kind}, x array<double>, y double, d array<double>")

    def reach(state: DataFrame, n: int) -> tuple[np.ndarray, list]:
        """The largest distance from each pivot and a row that has it."""
        r = state.agg(*[F.max(F.struct(F.col("d")[i].alias("d"), "k", "x", "y")).alias(f"m{i}") for i in range(n)]).first()
        return np.array([v["d"] for v in r]), [(v["k"], v["x"], v["y"]) for v in r]

    _, far = reach(measured(seeds), len(seeds))
    pivots = pd.concat([seeds, pd.DataFrame(far, columns=["k", "x", "y"]).drop_duplicates("k")], ignore_index=True)
    state = measured(pivots)
    most, _ = reach(state, len(pivots))
    least = float(most.max())
    bound = F.array_min(F.zip_with("d", F.array(*map(F.lit, most.tolist())), lambda d, m: d + m))
    left = state.filter(bound >= least - 1e-6)
    # Rows near one pivot lie together, so that whole pairs of files can be left out.
    near = F.array_position(F.slice("d", 1, len(seeds)), F.array_min(F.slice("d", 1, len(seeds))))
    left = left.select("k", "x", "y", near.alias("p"))
    left = materialise(left.repartitionByRange(max(1, -(-held.n // PAIR_BLOCK)), "p", F.xxhash64("k")).select("k", "x", "y"))
    held = Stored(left, sorted(left.inputFiles()), held.n)
    files, spread = held.files, (geometry.mapped(pivots["x"]), pivots["y"].to_numpy(float))

    def one(g: int) -> Iterator[pd.DataFrame]:
        def loaded(i: int) -> tuple:
            t = read(files[i], "k", "x", "y")
            x, y = geometry.mapped(points(t["x"])), t["y"].to_numpy()
            d = geometry.between(x, y, *spread)
            return t["k"].to_pandas().to_numpy(), x, y, d.max(0, initial=0.0)

        best, own = (least, None, None), loaded(g)
        for o in met(g, len(files)):
            other = own if o == g else loaded(o)
            if len(own[0]) and len(other[0]) and not (own[3] + other[3]).min() < best[0] - 1e-6:
                best = _farthest(geometry, own[:3], other[:3], best)
        if best[1] is not None:
            yield pd.DataFrame({"a": [best[1]], "b": [best[2]], "d": [best[0]]})

    best = held.each(one, f"a {kind}, b {kind}, d double").orderBy(F.desc("d"), "a", "b").first()
    return (best["a"], best["b"], best["d"]) if best else None


def _farthest(geometry: Geometry, one: tuple, two: tuple, best: tuple) -> tuple:
    """(distance, a, b): the best, or the first pair of rows (k, x, y) of two files that is farther apart, or as far and before it."""
    (ka, xa, ya), (kb, xb, yb) = one, two
    plain = geometry.metric == "euclidean" and geometry.y_scale is None
    halves = Halves(xa, xb, best[0] * geometry.x_scale) if plain else None
    step = max(1, DISTANCE_VALUES // max(1, xa.shape[1]))
    for i in range(0, len(xa), ROWS_AT_ONCE):
        if plain:
            # What is surely nearer than the best, rounded as it is, is left out.
            limit = max(0.0, best[0] * geometry.x_scale - 10.0**-PLACES * geometry.x_scale) ** 2 / 2
            at, to = np.divmod(np.flatnonzero(~(halves.of(i, i + ROWS_AT_ONCE) > halves.doubt - limit)), len(xb))
        else:
            d = geometry.between(xa[i : i + ROWS_AT_ONCE], ya[i : i + ROWS_AT_ONCE], xb, yb)
            at, to = np.nonzero(d >= best[0])
            d = d[at, to]
        at = at + i
        for j in range(0, len(at), step):
            a, b = at[j : j + step], to[j : j + step]
            v = np.round(row_distances("euclidean", xa[a], xb[b]) / geometry.x_scale, PLACES) if plain else d[j : j + step]
            ok = (v >= best[0]) & (ka[a] != kb[b])
            if ok.any():
                v, a, b = v[ok], ka[a[ok]], kb[b[ok]]
                a, b = (f(a[v == v.max()], b[v == v.max()]) for f in (np.minimum, np.maximum))
                first = (float(v.max()), a.min(), b[a == a.min()].min())
                if best[1] is None or first[0] > best[0] or first[1:] < best[1:]:
                    best = first
    return best


class _Picks:
    """Picks in order, written batch by batch."""

    def __init__(self, rows: DataFrame):
        self.spark, self.schema, self.parts, self.n = rows.sparkSession, f"k {rows.schema['k'].dataType.simpleString()}, place long", [], 0

    def add(self, keys: list) -> None:
        if keys:
            self.parts.append(materialise(self.spark.createDataFrame([(k, self.n + i) for i, k in enumerate(keys, 1)], self.schema)))
            self.n += len(keys)

    def table(self, key: str) -> DataFrame:
        out = reduce(DataFrame.union, self.parts) if self.parts else self.spark.createDataFrame([], self.schema)
        return out.select(F.col("k").alias(key), "place")


class _State:
    """Rows that are left, as (g, k, at, near) for each file of the table: keys, places in the file and distances to the nearest pick."""

    def __init__(self, held: Stored, table: DataFrame | None = None):
        self.held, files = held, held.files
        self.spec = f"g long, k array<{held.kind}>, at array<int>, near array<double>"

        def start(g: int) -> Iterator[pd.DataFrame]:
            k = read(files[g], "k")["k"].to_pylist()
            yield pd.DataFrame({"g": [g], "k": [k], "at": [np.arange(len(k), dtype=np.int32)], "near": [np.full(len(k), np.inf)]})

        self.table = materialise(held.each(start, self.spec)) if table is None else table

    @property
    def flat(self) -> DataFrame:
        """(id, k, near) of the rows; ids tell file and place."""
        rows = self.table.select("g", F.explode(F.arrays_zip("k", "at", "near")).alias("r"))
        return rows.select((F.shiftleft("g", 32) + F.col("r.at")).alias("id"), "r.k", "r.near")

    def whole(self, ids: pd.Series) -> pd.DataFrame:
        """(k, x, y, near) of some rows, in the order of the ids."""
        files, wanted = self.held.files, np.sort(ids.to_numpy(np.int64))
        sent = self.held.spark.sparkContext.broadcast(wanted)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for g, at, near in zip(p["g"], p["at"], p["near"], strict=True):
                    mine = np.flatnonzero(np.isin((g << 32) + at.astype(np.int64), sent.value))
                    if len(mine):
                        t = read(files[g], "k", "x", "y").take(at[mine])
                        yield t.to_pandas().assign(near=near[mine], id=(g << 32) + at[mine].astype(np.int64))

        got = self.table.mapInPandas(run, f"k {self.held.kind}, x array<double>, y double, near double, id long").toPandas()
        return got.set_index("id").loc[ids.tolist()].reset_index(drop=True)

    def after(self, picked: pd.DataFrame, geometry: Geometry, cutoff: float | None) -> _State:
        """The state after picks: these are gone, and so are rows nearer to one than the cutoff. Only arrays are written."""
        files = self.held.files
        sent = self.held.spark.sparkContext.broadcast((geometry, list(picked["k"]), geometry.mapped(picked["x"]), picked["y"].to_numpy(float)))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            geometry, keys, px, py = sent.value
            for p in parts:
                for g, k, at, near in zip(p["g"], p["k"], p["at"], p["near"], strict=True):
                    left = np.flatnonzero(~pd.Index(k).isin(keys))
                    if not len(left):
                        continue
                    t = read(files[g], "x", "y")
                    x, y = geometry.mapped(points(t["x"]))[at[left]], t["y"].to_numpy()[at[left]]
                    step = max(1, STEP_VALUES // max(1, len(px)))
                    d = [geometry.between(x[i : i + step], y[i : i + step], px, py).min(axis=1) for i in range(0, len(x), step)]
                    d = np.minimum(near[left], np.concatenate(d))
                    keep = np.ones(len(d), bool) if cutoff is None else d >= cutoff
                    yield pd.DataFrame({"g": [g], "k": [k[left][keep]], "at": [at[left][keep]], "near": [d[keep]]})

        return _State(self.held, materialise(self.table.mapInPandas(run, self.spec)))


def _select(state: _State, start: pd.DataFrame, m: int, geometry: Geometry, batch: Callable, cutoff: float | None, key: str) -> DataFrame:
    """Picks of m rows, those of `start` first. batch(state, wanted, number of picks) -> (rows, places of picks)."""
    picks = _Picks(state.held.rows)
    start = start.iloc[:m]
    picks.add(start["k"].tolist())
    state = state.after(start, geometry, cutoff) if len(start) else state
    while picks.n < m:
        rows, chosen = batch(state, m - picks.n, picks.n)
        if not len(chosen):
            break
        picks.add(rows["k"].iloc[chosen].tolist())
        if picks.n < m:
            state = state.after(rows.iloc[chosen], geometry, cutoff)
    return picks.table(key)


def _inner(rows: pd.DataFrame, geometry: Geometry) -> Callable[[int], np.ndarray]:
    """Distances of a row of the batch to all rows of it."""
    x, y = geometry.mapped(rows["x"]), rows["y"].to_numpy(float)
    return lambda i: geometry.between(x[i : i + 1], y[i : i + 1], x, y)[0]


def _leading(state: DataFrame, n: int, whole: Callable | None = None) -> pd.DataFrame:
    """The first n rows by falling near, then key. Every task offers n rows to the driver, so these are without their vectors;
    only the rows that lead of all are sent whole, by their ids where `whole` finds rows by these."""
    first = state.drop("x", "y").orderBy(F.desc("near"), "k").limit(n).toPandas()
    if whole is not None:
        return whole(first["id"])
    if not len(first):
        return state.limit(0).toPandas()
    near, k = F.lit(float(first["near"].iloc[-1])), F.lit(first["k"].tolist()[-1])
    rows = state.filter((F.col("near") > near) | (F.col("near") == near) & (F.col("k") <= k)).toPandas()
    return rows.sort_values(["near", "k"], ascending=[False, True]).iloc[:n].reset_index(drop=True)


def _farthest_batch(geometry: Geometry, size: int, cutoff: float | None = None) -> Callable:
    def batch(state: _State, wanted: int, _: int) -> tuple[pd.DataFrame, list[int]]:
        rows = _leading(state.flat, size + 1, state.whole)
        out = (rows["near"].iloc[-1], rows["k"].iloc[-1]) if len(rows) > size else None
        rows = rows.iloc[:size].reset_index(drop=True)
        near, keys, far, chosen = rows["near"].to_numpy().copy(), rows["k"].to_numpy(), _inner(rows, geometry), []
        by_key = np.argsort(keys, kind="stable")
        while len(chosen) < min(wanted, len(rows)):
            i = int(by_key[near[by_key].argmax()])
            # The first row left behind has no more than this, and no lesser key at the same.
            if out is not None and (near[i] < out[0] or near[i] == out[0] and keys[i] > out[1]):
                break
            if near[i] < (cutoff or 0):
                break
            chosen.append(i)
            near = np.where(near < 0, near, np.minimum(near, far(i)))
            near[i] = -1.0
        return rows, chosen

    return batch


def farthest_first(
    df: DataFrame, m: int, geometry: Geometry, start: list, key: str = "vec_id", vector: str = "x", target: str | None = None, cutoff: float | None = None, batch_rows: int | None = None
) -> DataFrame:
    """(key, place): the rows with the keys of start, then always the row farthest from all picks, ties by key, until
    there are m or the farthest is nearer than the cutoff."""
    held = _rows(df, key, vector, target)
    first = (held.rows.filter(F.col("k").isin(start)) if start else held.rows.limit(0)).toPandas()
    first = first.set_index("k").loc[start].reset_index() if start else first
    size = batch_rows or _batch_rows(first)
    return _select(_State(held), first, m, geometry, _farthest_batch(geometry, size, cutoff), cutoff, key)


def kennard_stone(df: DataFrame, m: int, geometry: Geometry, key: str = "vec_id", vector: str = "x", target: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """(key, place): the farthest pair, then always the row farthest from all picks."""
    pair = farthest_pair(df, geometry, key, vector, target)
    start = list(pair[:2]) if pair else [r[0] for r in df.select(key).limit(1).collect()]
    return farthest_first(df, m, geometry, start[: max(0, m)], key, vector, target, None, batch_rows)


def draw(seed: str, *parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 for a seed and columns: the first digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def optisim(
    df: DataFrame, m: int, geometry: Geometry, candidates: int, cutoff: float, seed: str = "42", key: str = "vec_id", vector: str = "x", target: str | None = None, steps: int = 128
) -> DataFrame:
    """(key, place): OptiSim. The first pick is the row of least draw(seed, key, 0). Step t draws the `candidates` rows with
    the least draw(seed, key, t) of those at least the cutoff from all picks, and takes the one
    farthest from these (ties: the earlier drawn); the others stay for later steps. 0 candidates are all rows (ties by key): maximum
    dissimilarity. It ends at m picks or when no row is left.

    A batch of `steps` draws is made in one pass, which keeps for each step a few more rows than it needs, for
    those that picks of the batch put out; a step that runs out of them ends the batch.
    """
    state = _State(_rows(df, key, vector, target))
    by_draw = lambda now, n: now.whole(now.flat.withColumn("h", draw(seed, F.col("k"), F.lit(0))).orderBy("h", "k").limit(n).toPandas()["id"])
    first = by_draw(state, min(1, m))
    if candidates == 0:
        return _select(state, first, m, geometry, _farthest_batch(geometry, _batch_rows(first), cutoff), cutoff, key)
    if candidates == 1:
        # The rows in order of one draw each, as good as a new draw for every step: each is taken unless a pick is near.
        def in_turn(now: _State, wanted: int, _: int) -> tuple[pd.DataFrame, list[int]]:
            rows = by_draw(now, _batch_rows(first))
            far, near, chosen = _inner(rows, geometry) if len(rows) else None, np.full(len(rows), np.inf), []
            for i in range(len(rows)):
                if len(chosen) < wanted and near[i] >= cutoff:
                    chosen.append(i)
                    near = np.minimum(near, far(i))
            return rows, chosen

        return _select(state, first, m, geometry, in_turn, cutoff, key)
    spare = candidates + max(8, candidates // 2)
    size = max(1, min(steps, _batch_rows(first) * 4 // spare))

    def drawn(now: _State, wanted: int, done: int) -> tuple[pd.DataFrame, list[int]]:
        step = F.explode(F.sequence(F.lit(done), F.lit(done + min(size, wanted) - 1))).alias("t")
        lots = now.flat.select("id", "k", step).withColumn("h", draw(seed, F.col("k"), F.col("t")))
        # Each task keeps what it may need of a step before anything moves; what is left has steps * spare rows.
        order = Window.partitionBy("t").orderBy("h", "k")
        table = lots.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= spare).select("t", "h", "k", "id").toPandas()
        rows = now.whole(table["id"].drop_duplicates())
        place = {k: i for i, k in enumerate(rows["k"])}
        near, far, chosen = rows["near"].to_numpy().copy(), _inner(rows, geometry) if len(rows) else None, []
        for _, lot in table.sort_values(["t", "h", "k"]).groupby("t"):
            ok = [i for i in (place[k] for k in lot["k"]) if near[i] >= cutoff][:candidates]
            if len(ok) < candidates and len(lot) >= spare or not ok:
                break
            i = max(ok, key=lambda i: near[i])
            chosen.append(i)
            near = np.minimum(near, far(i))
            near[i] = -np.inf
        return rows, chosen

    return _select(state, first, m, geometry, drawn, cutoff, key)
