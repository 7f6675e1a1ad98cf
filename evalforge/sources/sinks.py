"""Writers: partitioned results, idempotent appends, consolidation with checks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.operators.splits import repeated_folds
from evalforge.sources.loaders import exists


def write_results(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Zstandard Parquet, rows of a partition value kept together before they are written;
    the rebalance splits values that are too large for one file."""
    out = df.hint("rebalance", *by) if by else df
    w = out.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def _same(keys: Sequence[str], prefix: str = "__"):
    """Equality of keys with those of a table whose columns have the prefix; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def without(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of df whose keys, nulls among them, are not in known."""
    return df.join(known.select(*[F.col(k).alias("__" + k) for k in keys]), _same(keys), "left_anti")


def append_new(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys the table does not have yet, one of each: running it twice is harmless."""
    fresh = df.dropDuplicates(list(keys))
    if exists(spark, path):
        fresh = without(fresh, spark.read.parquet(path), keys)
    fresh.write.mode("append").option("compression", "zstd").parquet(path)


def check_counts(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """df, or an error at run time if a group has not the expected number of rows."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    bad = c.filter(F.col("c") != expected)
    if not bad.isEmpty():
        raise ValueError(f"groups with other than {expected} rows, such as {bad.first()}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_folds(folds: DataFrame, path: str, **meta) -> None:
    """A table of folds (rep, fold, key) by repeat, and what is known of it as JSON beside it."""
    spark = folds.sparkSession
    write_results(folds, f"{path}/folds", ["rep"])
    known = {"n_rows": folds.select("rep", "fold").count(), "n_folds": folds.select("rep", "fold").distinct().count(), **meta}
    spark.createDataFrame([(json.dumps(known, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def build_folds(data: DataFrame, path: str, key: str, k: int, repeats: int, seed: str = "42", **meta) -> DataFrame:
    """Draw repeated folds of the data, save them, and read them back."""
    save_folds(repeated_folds(data, key, k, repeats, seed), path, k=k, repeats=repeats, seed=seed, **meta)
    return data.sparkSession.read.parquet(f"{path}/folds")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shard_folders(spark: SparkSession, root: str) -> list[str]:
    """The folders below root that hold Parquet files and, where Spark marks the end of a job, the mark; others are of
    jobs that have not ended."""
    fs, top = _files(spark, root)
    found, open_ = [], [top] if fs.exists(top) else []
    while open_:
        at = open_.pop()
        entries = list(fs.listStatus(at))
        names = [e.getPath().getName() for e in entries]
        open_ += [e.getPath() for e, n in zip(entries, names, strict=True) if e.isDirectory() and n[:1] not in "._"]
        if any(n.endswith(".parquet") for n in names) and "_temporary" not in names:
            found.append(at.toString())
    return sorted(found)


def recover(spark: SparkSession, target: str) -> None:
    """Put back a table whose swap was cut short, and remove what was staged and not swapped in."""
    fs, p = _files(spark, target)
    if p.getParent() is None or not fs.exists(p.getParent()):
        return
    beside = [e.getPath() for e in fs.listStatus(p.getParent()) if e.getPath().getName().startswith(p.getName() + ".")]
    before = sorted((x for x in beside if x.getName().startswith(p.getName() + ".before-")), key=lambda x: x.toString())
    if not fs.exists(p) and before:
        fs.rename(before.pop(), p)
    for x in (*before, *(x for x in beside if x.getName().startswith(p.getName() + ".staging-"))):
        fs.delete(x, True)


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """(path, rows): what a consolidated table was made of."""
    spec = "path string, rows long"
    at = f"{target}/_manifest"
    return spark.read.schema(spec).json(at) if exists(spark, at) else spark.createDataFrame([], spec)


def _swap(spark: SparkSession, staged: str, target: str) -> None:
    """Take the staged table's name for the target's: two renames, and recover() ends what is cut short between them."""
    fs, p = _files(spark, target)
    old = _files(spark, f"{target}.before-{uuid.uuid4().hex[:12]}")[1]
    had = fs.exists(p)
    if had and not fs.rename(p, old) or not fs.rename(_files(spark, staged)[1], p):
        raise OSError(f"{target} could not be replaced")
    if had:
        fs.delete(old, True)


def consolidate(spark: SparkSession, paths: Sequence[str] | str, target: str, keys: Sequence[str], expected: int) -> tuple[list[str], list[str]]:
    """Bring tables into one: those that have every group of the keys in the expected number of rows, and are not in it
    yet. Tables that have not, or lack, are left alone. paths may be a folder, whose tree is walked. Returns both
    lists of paths.

    The new table is written beside the old one with a manifest of the paths it is made of, read back
    and checked against their counts, and then takes the old one's name; until then the old one is as it was. Paths
    of the manifest, and groups that the table has, are not read in again, so reruns add nothing. Rows are never merged: equal
    rows of a group are as many as they were. Nulls in keys are values like others.
    """
    recover(spark, target)
    paths = shard_folders(spark, paths) if isinstance(paths, str) else list(paths)
    known = {r["path"]: r["rows"] for r in manifest(spark, target).collect()}  # a row for each path
    done, left, fresh = [], [], []
    for p in paths:
        if p in known:
            done.append(p)
        elif not exists(spark, p):
            left.append(p)
        else:
            df = spark.read.parquet(p)
            groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
            n, bad = groups.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") != expected)).first()
            (left if bad else done).append(p)
            if not bad:
                fresh.append((p, n, df))
    if not fresh:
        return done, left
    table = spark.read.parquet(target) if exists(spark, target) else None
    whole, counted = table, table.count() if table is not None else 0
    for p, _, df in fresh:
        # Also against the tables of this call: two may hold one group.
        more = df if whole is None else without(df, whole, keys)
        whole = more if whole is None else whole.unionByName(more, allowMissingColumns=True)
    staged = f"{target}.staging-{uuid.uuid4().hex[:12]}"
    whole.write.option("compression", "zstd").parquet(staged)
    made = spark.read.parquet(staged)
    bad = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") != expected)
    total = made.count()
    if not bad.isEmpty() or not counted <= total <= counted + sum(n for _, n, _ in fresh):
        recover(spark, target)
        raise ValueError(f"{target}: {total} rows staged of {counted} and {sum(n for _, n, _ in fresh)} new ones")
    rows = [*known.items(), *((p, n) for p, n, _ in fresh)]
    spark.createDataFrame(rows, "path string, rows long").coalesce(1).write.json(f"{staged}/_manifest")
    _swap(spark, staged, target)
    return done, left
