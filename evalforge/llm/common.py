"""Shared pieces of the training-data operators: scratch tables in the cluster's
shared folder, size-checked broadcasts, and the byte-level word rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex for one ASCII white-space character of the contracts, `[\x20\x09-\x0D]`.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is
    unset and everything runs in one local process (tests) is it a new temporary folder."""
    sc = spark.sparkContext
    if found := (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")):
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not (found := getattr(sc, "_evalforge_shared", None)):
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc._evalforge_shared = found
    return found


#: Lists that collect the scratch tables made while temporary_tables is open.
_collecting: list[list[Scratch]] = []


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables that operators write inside are removed at its end: for a result that has been
    written by then."""
    made: list[Scratch] = []
    _collecting.append(made)
    try:
        yield
    finally:
        _collecting.remove(made)
        for s in made:
            s.remove()


class Scratch:
    """Intermediate tables, written once to the shared folder and read back, so that
    lineage is cut, lost executors cost nothing and ids drawn in a task stay fixed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        for made in _collecting:
            made.append(self)

    def remove(self) -> None:
        """All tables of this scratch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables of this scratch that no later step reads."""
        for df in frames:
            path = _hadoop_path(df)
            _file_system(df, path).delete(path, True)


def _hadoop_path(saved: DataFrame):
    return saved.sparkSession._jvm.org.apache.hadoop.fs.Path(saved._scratch_path)


def _file_system(df: DataFrame, path):
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


#: A table is broadcast if its files are not larger than this.
BROADCAST_BYTES = 12 << 20


def small(saved: DataFrame, df: DataFrame | None = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, rows of or like those of the table that Scratch saved, with a broadcast hint if the
    table's files are within the bound; beyond it Spark shuffles both sides."""
    df, path = saved if df is None else df, _hadoop_path(saved)
    return F.broadcast(df) if _file_system(saved, path).getContentSummary(path).getLength() <= max_bytes else df


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of docs whose id is not in `ids` (one column named id_col, non-null); null ids stay."""
    ids = ids if hasattr(ids, "_scratch_path") else Scratch(docs.sparkSession, "ids").save(ids)
    return docs.join(small(ids, max_bytes=max_bytes), id_col, "left_anti").select(*docs.columns)


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    return docs.join(small(ids, max_bytes=max_bytes), id_col, "left_semi").select(*docs.columns)


def row_key(docs: DataFrame, id_col: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs and the name of a column that names its rows: id_col if no id is null or repeats, else `__row` of docs
    saved with a number for each row. Decisions about rows are carried by it."""
    if docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs, id_col
    return scratch.save(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed"), "__row"


def release_memory() -> None:
    """Give memory that a Python worker no longer uses back to the machine: workers live on between tasks, and what
    one stage needed would count beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with its memory released after every batch and at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
        release_memory()

    return whole


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a fixed number of words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))
