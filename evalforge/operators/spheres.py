"""Sphere clusters of vectors without a list of pairs: rows' neighbours are counted in blocks, the rows that lead are sent to the
driver with their lists, and it goes on by the rule for as long as no row left behind can lead."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalforge.operators.stored import Stored, counts, near, points, read, store
from evalforge.sources.scratch import materialise

#: Most leading rows of a batch, and neighbours in their lists, that the driver holds.
LEADERS, LISTED = 8192, 4_000_000
#: Leading rows whose neighbours among all of these the driver finds at once, and files that a task holds at once.
TILE, FILES_AT_ONCE = 256, 8


class _State:
    """Rows of a table, and for each of its files a row (g, k, n, own): keys, numbers of free neighbours (-1 for rows
    that are taken) and centroids, which are the rows' own keys until they are taken."""

    def __init__(self, held: Stored, threshold: float, metric: str):
        self.held, self.threshold, self.metric = held, threshold, metric
        files, kind = held.files, held.kind
        self.spec = f"g long, k array<{kind}>, n array<long>, own array<{kind}>"

        def start(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for g, n in zip(p["g"], p["n"], strict=True):
                    k = read(files[g], "k")["k"].to_pylist()
                    yield pd.DataFrame({"g": [g], "k": [k], "n": [n], "own": [k]})

        tasks = max(1, min(len(files), 2 * held.spark.sparkContext.defaultParallelism))
        self.table = materialise(counts(held, threshold, metric).repartition(tasks).mapInPandas(start, self.spec))

    def leaders(self, most: int) -> pd.DataFrame:
        """(id, k, n) of the free rows with most free neighbours, ties by key; ids tell file and place."""
        flat = self.table.select("g", F.posexplode(F.arrays_zip("k", "n")).alias("at", "r"))
        free = flat.filter("r.n > 0").select((F.shiftleft("g", 32) + F.col("at")).alias("id"), "r.k", "r.n")
        return free.orderBy(F.desc("n"), "k").limit(most).toArrow().to_pandas()

    def vectors(self, keys: list) -> np.ndarray:
        """Vectors of rows, in the order of the keys."""
        asked = self.held.spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {self.held.kind}, i long")
        got = self.held.rows.join(F.broadcast(asked), "k").select("i", "x").toArrow()  # LEADERS rows at most
        return points(got["x"])[np.argsort(got["i"].to_numpy())]

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, id): the free rows near row i of x."""
        files, threshold, metric = self.held.files, self.threshold, self.metric
        sent = self.held.spark.sparkContext.broadcast(x)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for g, n in zip(p["g"], p["n"], strict=True):
                    free = np.flatnonzero(n > 0)
                    if len(free):
                        for at, to in near(metric, threshold, points(read(files[g], "x")["x"])[free], sent.value):
                            yield pd.DataFrame({"i": to.astype(np.int32), "id": (g << 32) + free[at]})

        got = self.table.mapInPandas(run, "i int, id long").toArrow()  # LISTED pairs or so
        sent.unpersist()
        return got["i"].to_numpy(), got["id"].to_numpy()

    def take(self, ids: np.ndarray, centroids: list) -> None:
        """Rows go to their centroids and no longer count as neighbours of others."""
        files, threshold, metric = self.held.files, self.threshold, self.metric
        order = np.argsort(ids)
        g, at = ids[order] >> 32, ids[order] & 0xFFFFFFFF
        starts = np.searchsorted(g, np.arange(len(files) + 1))
        sent = self.held.spark.sparkContext.broadcast((at, starts, [centroids[i] for i in order]))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for i in range(0, len(p), FILES_AT_ONCE):
                    yield changed(p.iloc[i : i + FILES_AT_ONCE])

        def changed(p: pd.DataFrame) -> pd.DataFrame:
            at, starts, to = sent.value
            held, counted, own = [], [n.copy() for n in p["n"]], [o.copy() for o in p["own"]]
            for g, n, o in zip(p["g"], counted, own, strict=True):
                mine = slice(starts[g], starts[g + 1])
                n[at[mine]] = -1
                for a, c in zip(at[mine], to[mine], strict=True):
                    o[a] = c
                left = np.flatnonzero(n > 0)
                if len(left):
                    held.append((n, left, points(read(files[g], "x")["x"])[left]))
            for f in range(len(files)) if held else ():
                mine = at[starts[f] : starts[f + 1]]
                if len(mine):
                    y = points(read(files[f], "x")["x"])[mine]
                    for n, left, x in held:
                        for there, _ in near(metric, threshold, x, y):
                            n[left] -= np.bincount(there, minlength=len(left))
            return p.assign(n=counted, own=own)

        self.table = materialise(self.table.mapInPandas(run, self.spec))
        sent.unpersist()

    def gather(self, x: np.ndarray, keys: list) -> None:
        """Free rows go to the first of the centroids that they are near, if to any."""
        files, threshold, metric = self.held.files, self.threshold, self.metric
        sent = self.held.spark.sparkContext.broadcast((x, keys))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                (x, keys), counted, own = sent.value, [n.copy() for n in p["n"]], [o.copy() for o in p["own"]]
                for g, n, o in zip(p["g"], counted, own, strict=True):
                    free = np.flatnonzero(n > 0)
                    if not len(free):
                        continue
                    first = np.full(len(free), len(x))
                    for at, to in near(metric, threshold, points(read(files[g], "x")["x"])[free], x):
                        np.minimum.at(first, at, to)
                    for a, c in zip(free[first < len(x)], first[first < len(x)], strict=True):
                        n[a], o[a] = -1, keys[c]
                yield p.assign(n=counted, own=own)

        self.table = materialise(self.table.mapInPandas(run, self.spec))
        sent.unpersist()

    def clusters(self) -> DataFrame:
        """(k, centroid) of all rows."""
        return self.table.select(F.explode(F.arrays_zip("k", "own")).alias("r")).select("r.k", F.col("r.own").alias("centroid"))


def _take_in_turn(rows: pd.DataFrame, after: tuple | None, lists: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], np.ndarray, list]:
    """(picks, ids of taken rows, their centroids' places) by the rule of falling counts among leading rows (id, k, n), with
    (i, id) lists of their free neighbours, as long as the leader comes before `after`, the first row left behind: its count can only
    fall. An entry of the heap has a count that was right once, so the first that still is right is the row to take."""
    ids, place = np.unique(np.concatenate([rows["id"].to_numpy(), lists[1]]), return_inverse=True)
    place = place.astype(np.int32)
    me, who, whom = place[: len(rows)], lists[0], place[len(rows) :]
    other = me[who] != whom
    who, whom = who[other], whom[other]
    by_who, by_whom = np.argsort(who, kind="stable"), np.argsort(whom, kind="stable")
    held, holders = whom[by_who], who[by_whom]
    held_at, holders_at = (np.searchsorted(v, np.arange(n + 1)) for v, n in ((who[by_who], len(rows)), (whom[by_whom], len(ids))))
    count, free, keys = np.diff(held_at), np.ones(len(ids), bool), rows["k"].tolist()
    heap = [(-int(c), k, i) for i, (c, k) in enumerate(zip(count, keys, strict=True)) if c]
    heapify(heap)
    picks, taken, owner = [], [], []
    while heap:
        c, k, i = heappop(heap)
        if not free[me[i]] or not count[i]:
            continue
        if count[i] != -c:
            heappush(heap, (-int(count[i]), k, i))
            continue
        if after is not None and (c, k) > after:
            break
        mine = held[held_at[i] : held_at[i + 1]]
        mine = np.append(mine[free[mine]], me[i])
        free[mine] = False
        at, many = holders_at[mine], holders_at[mine + 1] - holders_at[mine]
        lost = holders[np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())]
        np.subtract.at(count, lost, 1)
        picks.append(i)
        taken.append(ids[mine])
        owner.append(np.full(len(mine), i))
    return picks, np.concatenate(taken), [keys[i] for i in np.concatenate(owner)]


def falling(df: DataFrame, threshold: float, key: str = "vec_id", vector: str = "x", metric: str = "euclidean") -> DataFrame:
    """(k, centroid): always the free row with most free neighbours (ties: least key) and these neighbours with it.

    A batch is the rows that lead now, with lists of their free neighbours; counts of rows left behind can only fall, so the rule
    goes on among the batch alone until its leader might come after the first of those. Then all that was taken
    is taken off the others' counts in one pass. Work is that of comparing all rows twice and the leading rows of each batch once.
    """
    state = _State(store(df, key, vector), threshold, metric)
    while len(rows := state.leaders(LEADERS + 1)):
        # The first row has its list however long it is.
        most = min(LEADERS, max(1, int(np.searchsorted(rows["n"].cumsum(), LISTED, side="right"))))
        after = (-int(rows["n"].iloc[most]), rows["k"].tolist()[most]) if len(rows) > most else None
        rows = rows.iloc[:most]
        _, ids, centroids = _take_in_turn(rows, after, state.lists(state.vectors(rows["k"].tolist())))
        state.take(ids, centroids)
    return state.clusters()


def fixed(df: DataFrame, threshold: float, key: str = "vec_id", vector: str = "x", metric: str = "euclidean") -> DataFrame:
    """(k, centroid): rows in order of their numbers of neighbours (ties: least key) are centroids unless near one before, all
    others belong to the first centroid near them.

    A batch is the next rows in that order that are free; the driver finds the centroids among them, and one pass gives these the free rows near them.
    """
    state = _State(store(df, key, vector), threshold, metric)
    while len(rows := state.leaders(LEADERS)):
        x = state.vectors(rows["k"].tolist())
        open_, chosen = np.ones(len(x), bool), []
        for i in range(0, len(x), TILE):
            tile = i + np.flatnonzero(open_[i : i + TILE])
            pairs = [(tile[at], to) for at, to in near(metric, threshold, x[tile], x)]
            at, to = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
            starts = np.searchsorted(at, np.append(tile, len(x)))
            for j, c in enumerate(tile):
                if open_[c]:
                    chosen.append(c)
                    open_[to[starts[j] : starts[j + 1]]] = False
        state.gather(x[chosen], rows["k"].iloc[chosen].tolist())
    return state.clusters()
