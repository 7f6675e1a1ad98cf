"""Passes over pairs of rows that shuffle no vectors: rows lie once in the shared folder, tasks read the files they need from
there, and what a pass changes is kept beside them as arrays, a row of a small table for each file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.operators.distances import block_distances
from evalforge.sources.scratch import materialise

#: Most rows of a file, about, and the fewest where more files let more tasks work.
FILE_ROWS, LEAST_ROWS = 8192, 1000
#: Rows that meet those of a file at once, and numbers of vectors that exact distances are made of at once.
ROWS_AT_ONCE, DISTANCE_VALUES = 256, 1 << 20


def row_distances(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of two arrays of one length, without the rounding of products."""
    if metric == "euclidean":
        return np.sqrt(((x - y) ** 2).sum(1))
    if metric == "cityblock":
        return np.abs(x - y).sum(1)
    high = np.maximum(x, y).sum(1)
    return 1 - np.divide(np.minimum(x, y).sum(1), high, out=np.ones_like(high), where=high > 0)


class Halves:
    """Products that are minus half the squared distances of rows x and y, with a bound of their error: in single
    precision where that tells distances about `reach` apart from others, else in double precision."""

    def __init__(self, x: np.ndarray, y: np.ndarray, reach: float):
        with np.errstate(all="ignore"):
            a, b = (x * x).sum(1) / 2, (y * y).sum(1) / 2
            norms = np.concatenate([a, b])
            largest = float(2 * norms[np.isfinite(norms)].max(initial=0.0))
            single = (x.shape[1] + 16) * 2.0**-22 * largest
            fits = single < 0.01 * reach * reach / 2 and largest < 1e30
            kind = np.float32 if fits else np.float64
            self.doubt = single + 1e-30 if fits else (x.shape[1] + 16) * 2.0**-50 * largest + 1e-300
            self.p = np.column_stack([x, -a, np.ones(len(x))]).astype(kind)
            self.q = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), -b]).astype(kind).T)

    def of(self, i: int, j: int) -> np.ndarray:
        with np.errstate(all="ignore"):
            return self.p[i:j] @ self.q


def near(metric: str, threshold: float, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and in y of the rows at most the threshold apart, ROWS_AT_ONCE of x at a time. Products decide
    what is sure, exact distances the rest."""
    if not len(x) or not len(y):
        return
    step, limit = max(1, DISTANCE_VALUES // max(1, x.shape[1])), threshold * threshold / 2
    halves = Halves(x, y, threshold) if metric == "euclidean" else None
    for i in range(0, len(x), ROWS_AT_ONCE):
        if halves is None:
            at, to = np.nonzero(block_distances(metric, x[i : i + ROWS_AT_ONCE], y) <= threshold + 1e-7)
            keep = np.zeros(len(at), bool)
        else:
            s = halves.of(i, i + ROWS_AT_ONCE)
            at, to = np.divmod(np.flatnonzero(~(s < -limit - halves.doubt)), len(y))
            keep = s[at, to] >= halves.doubt - limit
        at += i
        open_ = np.flatnonzero(~keep)
        for j in range(0, len(open_), step):
            o = open_[j : j + step]
            with np.errstate(all="ignore"):
                keep[o] = row_distances(metric, x[at[o]], y[to[o]]) <= threshold
        yield at[keep], to[keep]


def points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    lengths = pc.list_value_length(column).unique().to_pylist()
    if len(lengths) > 1 or lengths == [None]:
        raise ValueError("vectors must have one length")
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1 if len(column) else 0)


def read(name: str, *columns: str) -> pa.Table:
    """A file in the shared folder."""
    fs, path = pa.fs.FileSystem.from_uri(name)
    with fs.open_input_file(path) as f:
        return pq.ParquetFile(f).read(columns=list(columns))


def met(g: int, many: int) -> list[int]:
    """The files that file g of many meets, itself first, so that any two meet once and all meet as many."""
    others = [(g + i) % many for i in range(1, (many + 1) // 2)]
    return [g, *others] + ([g + many // 2] if many % 2 == 0 and g < many // 2 else [])


@dataclass
class Stored:
    """Rows (k, x and what else is asked for) in files of the shared folder; a file is called by its number."""

    rows: DataFrame
    files: list[str]
    n: int

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def kind(self) -> str:
        return self.rows.schema["k"].dataType.simpleString()

    def each(self, run: Callable[[int], Iterator[pd.DataFrame]], spec: str) -> DataFrame:
        """What run makes of the number of each file, a task for each."""

        def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for g in p["id"]:
                    yield from run(int(g))

        return self.spark.range(0, len(self.files), 1, max(1, len(self.files))).mapInPandas(of, spec)


def store(df: DataFrame, key: str, vector: str, **more) -> Stored:
    """df's rows (k, x, more) written once, in files of at most FILE_ROWS or so."""
    cols = {"k": F.col(key), "x": F.col(vector).cast("array<double>"), **more}
    rows = df.select(*[c.alias(name) for name, c in cols.items()])
    n = df.count()
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    many = max(1, -(-n // FILE_ROWS), min(tasks, n // LEAST_ROWS))
    rows = materialise(rows.repartition(many))
    # A table without rows may have a file all the same.
    return Stored(rows, sorted(rows.inputFiles()) if n else [], n)


def counts(held: Stored, threshold: float, metric: str) -> DataFrame:
    """(g, n): for each file an array of the numbers of other rows at most the threshold from its rows. Any two files meet in
    one task, and what leaves it is a number for each row, not a pair."""
    files = held.files

    def run(g: int) -> Iterator[pd.DataFrame]:
        t = read(files[g], "k", "x")
        k, x = t["k"].to_pandas().to_numpy(), points(t["x"])
        own = np.zeros(len(x), np.int64)
        for o in met(g, len(files)):
            u = t if o == g else read(files[o], "k", "x")
            l, y = u["k"].to_pandas().to_numpy(), points(u["x"])
            theirs = np.zeros(len(y), np.int64)
            for at, to in near(metric, threshold, x, y):
                other = k[at] != l[to]
                own += np.bincount(at[other], minlength=len(own))
                if o != g:
                    theirs += np.bincount(to[other], minlength=len(theirs))
            if theirs.any():
                yield pd.DataFrame({"g": [o], "n": [theirs]})
        yield pd.DataFrame({"g": [g], "n": [own]})

    added = lambda p: pd.DataFrame({"g": p["g"].iloc[:1], "n": [np.sum(np.stack(p["n"].tolist()), axis=0)]})
    return held.each(run, "g long, n array<long>").groupBy("g").applyInPandas(added, "g long, n array<long>")


def numbers(held: Stored, threshold: float, metric: str) -> DataFrame:
    """(k, n) of the rows that have other rows at most the threshold away."""
    files = held.files

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for g, n in zip(p["g"], p["n"], strict=True):
                some = np.flatnonzero(n)
                yield pd.DataFrame({"k": read(files[g], "k")["k"].to_pandas().to_numpy()[some], "n": n[some]})

    return counts(held, threshold, metric).mapInPandas(run, f"k {held.kind}, n long")


def pairs(held: Stored, threshold: float, metric: str) -> DataFrame:
    """(a, b), one way round, of rows of different keys at most the threshold apart."""
    files = held.files

    def run(g: int) -> Iterator[pd.DataFrame]:
        t = read(files[g], "k", "x")
        k, x = t["k"].to_pandas().to_numpy(), points(t["x"])
        for o in met(g, len(files)):
            u = t if o == g else read(files[o], "k", "x")
            l, y = u["k"].to_pandas().to_numpy(), points(u["x"])
            for at, to in near(metric, threshold, x, y):
                one = (k[at] != l[to]) & ((o != g) | (at < to))
                yield pd.DataFrame({"a": k[at[one]], "b": l[to[one]]})

    return held.each(run, f"a {held.kind}, b {held.kind}")


def nearest(queries: DataFrame, held: Stored, metric: str = "euclidean") -> DataFrame:
    """(k, to): for each of the queries (k, x) the key of the nearest row, other than itself, ties by key; none where no distance is
    finite. A task holds its queries and reads all rows a file at a time, so that a name for each query leaves it."""
    files, kind = held.files, held.kind

    def answer(k: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        best, to = np.full(len(x), np.inf), np.empty(len(x), k.dtype)
        for name in files:
            t = read(name, "k", "x")
            l, y = t["k"].to_pandas().to_numpy(), points(t["x"])
            halves = Halves(x, y, 1.0) if metric == "euclidean" else None
            asked = pd.Index(l).isin(k).any()
            for i in range(0, len(x), ROWS_AT_ONCE):
                part = slice(i, i + ROWS_AT_ONCE)
                s = -block_distances(metric, x[part], y) if halves is None else halves.of(i, i + ROWS_AT_ONCE)
                doubt = 1e-7 if halves is None else 2 * halves.doubt
                if asked:
                    s[k[part, None] == l[None, :]] = -np.inf
                with np.errstate(all="ignore"):
                    least = -best[part] if halves is None else -best[part] ** 2 / 2
                    at, o = np.divmod(np.flatnonzero(~(s < (np.fmax(np.fmax.reduce(s, axis=1), least) - doubt)[:, None])), len(y))
                at += i
                other = k[at] != l[o]
                at, o = at[other], o[other]
                for j in range(0, len(at), step := max(1, DISTANCE_VALUES // max(1, x.shape[1]))):
                    a, b = at[j : j + step], o[j : j + step]
                    with np.errstate(all="ignore"):
                        d = row_distances(metric, x[a], y[b])
                    order = np.lexsort((l[b], d, a))
                    a, b, d = a[order], b[order], d[order]
                    lead = np.flatnonzero(np.diff(a, prepend=-1))
                    a, b, d = a[lead], l[b[lead]], d[lead]
                    better = d < best[a]
                    same = np.flatnonzero((d == best[a]) & np.isfinite(d))
                    better[same] = b[same] < to[a[same]]
                    best[a[better]], to[a[better]] = d[better], b[better]
        some = np.isfinite(best)
        return pd.DataFrame({"k": k[some], "to": to[some]})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if b.num_rows:
                out = answer(b.column("k").to_pandas().to_numpy(), points(b.column("x")))
                yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(out[c], type=b.column("k").type) for c in ("k", "to")], ["k", "to"])

    return queries.select("k", "x").mapInArrow(run, f"k {kind}, to {kind}")
