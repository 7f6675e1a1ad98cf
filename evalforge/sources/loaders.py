"""Readers: wide descriptor files, aligned test files, sharded result tables, time-stamped
assays, split tables, job logs and the experiment configuration."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOLECULE, TARGET = "MOLECULE", "Act"


def exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_csv(spark: SparkSession, path: str) -> str:
    """path.gz if there, else path, else an error."""
    for p in (path + ".gz", path):
        if exists(spark, p):
            return p
    raise FileNotFoundError(path)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True).columns


def descriptors(spark: SparkSession, path: str, like: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """(sample_id, y, features) of a wide descriptor file. With `like`, the feature columns
    of another file: columns that lack here are 0, others are dropped, order is kept.
    The wide row becomes one array at once; thousands of columns go no further. `names` is the
    file's header where it has been read already."""
    path = resolve_csv(spark, path)
    names = list(names) if names is not None else _header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType() if c == MOLECULE else T.DoubleType() if c == TARGET else T.IntegerType()) for c in names])
    wide = spark.read.csv(path, header=True, schema=schema)
    wanted = list(like) if like is not None else feature_names(names)
    features = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)) if c in names else F.lit(0) for c in wanted])
    return wide.select(F.col(MOLECULE).alias("sample_id"), F.col(TARGET).alias("y"), features.cast("array<int>").alias("features"))


def feature_names(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in (MOLECULE, TARGET)]


def train_and_test(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Both files on the training file's features."""
    header = _header(spark, resolve_csv(spark, train))
    return descriptors(spark, train, names=header), descriptors(spark, test, feature_names(header))


def rows_of_split(data: DataFrame, split: DataFrame, part: str, key: str = "sample_id", **fold) -> DataFrame:
    """Rows that a long split table (key, part, ...) puts into the part."""
    chosen = split.filter(F.col("part") == part)
    for c, v in fold.items():
        chosen = chosen.filter(F.col(c) == v)
    return data.join(chosen.select(key), key, "left_semi")


def outer_subset(data: DataFrame, split: DataFrame, rep: int, fold: int, drawn: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """Train rows of an outer fold: those of a subsample drawn before (key, rep, fold), if there
    is one for the fold, else all."""
    if drawn is not None:
        some = drawn.filter((F.col("rep") == rep) & (F.col("fold") == fold))
        if not some.isEmpty():
            return data.join(some.select(key), key, "left_semi")
    return rows_of_split(data, split, "train", key, rep=rep, fold=fold)


def each_split(outer: DataFrame, inner: DataFrame, key: str = "sample_id") -> DataFrame:
    """(rep, fold, key, part, inner_part): rows of an outer fold with their part in the inner
    split of the same repeat and fold; null outside it."""
    i = inner.select("rep", "fold", key, F.col("part").alias("inner_part"))
    return outer.select("rep", "fold", key, "part").join(i, ["rep", "fold", key], "left")


def champion_meta(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The distinct rows of what is known of champions."""
    return shards(spark, paths, columns).distinct()


def metrics_table(spark: SparkSession, paths: dict[str, str], schema: str, expected: int) -> DataFrame:
    """Metrics files of several algorithms with the column `algorithm`; files that lack are
    skipped. `complete` tells whether a file has the expected number of rows."""
    out = None
    for name, path in paths.items():
        if not exists(spark, path):
            continue
        df = spark.read.csv(path, header=True, schema=schema).withColumn("algorithm", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], schema).withColumns({"algorithm": F.lit(""), "complete": F.lit(False)})
    n = out.groupBy("algorithm").agg(F.count(F.lit(1)).alias("__n"))  # a row for each file
    return out.join(F.broadcast(n), "algorithm").withColumn("complete", F.col("__n") == expected).drop("__n")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, cluster) of a file of cluster assignments; clusters below 1 are an error."""
    df = spark.read.csv(path, header=True, schema="sample_id string, cluster int")
    ok = F.when(F.col("cluster") >= 1, F.col("cluster")).otherwise(F.raise_error(F.lit("clusters are numbered from 1")).cast("int"))
    return df.select("sample_id", ok.alias("cluster"))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error at run time at the first null of a column."""
    return df.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in columns})


def compacted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles of the columns as single precision, where the columns are there."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("float") for c in columns if kinds.get(c) == "double"})


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """df with the prefix before every column but the keys."""
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def experiment_paths(root: str, dataset: str, splitter: str, ratio: float, rep: int, fold: int) -> dict[str, str]:
    """Where the tables of one fold lie: folders of column=value, which Spark reads as columns."""
    at = f"dataset={dataset}/splitter={splitter}/ratio={ratio}/rep={rep}/fold={fold}"
    return {kind: f"{root.rstrip('/')}/{kind}/{at}" for kind in ("splits", "predictions", "domains", "metrics", "champions")}


def load_fold(split: DataFrame, **fold) -> DataFrame:
    """The rows of one fold; an error if there are none."""
    for c, v in fold.items():
        split = split.filter(F.col(c) == v)
    if split.isEmpty():
        raise LookupError(f"no split for {fold}")
    return split


def shards(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The union of those of the tables that exist, by name, lacking columns as null."""
    out = None
    for p in paths:
        if exists(spark, p):
            df = spark.read.parquet(p)
            df = df.select(*[c for c in columns if c in df.columns]) if columns else df
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(", ".join(paths))
    return out


def arrow_files(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Arrow IPC files of a store that pyarrow reaches, one task a file, by record batch."""
    import pyarrow as pa
    from pyarrow import fs

    def read(batches):
        for b in batches:
            for uri in b.column("path").to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    reader = pa.ipc.open_file(f)
                    for i in range(reader.num_record_batches):
                        yield reader.get_batch(i)

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths))).mapInArrow(read, schema)


def assay(df: DataFrame) -> DataFrame:
    """(SMILES, date, target): rows with a structure, the later of both dates, no nulls."""
    need = {"SMILES", "ORDER_DATE", "SHIPMENT_DATE", "target"}
    if lack := need - set(df.columns):
        raise ValueError(f"columns lack: {', '.join(sorted(lack))}")
    return df.filter(F.col("SMILES").isNotNull()).select("SMILES", F.greatest("ORDER_DATE", "SHIPMENT_DATE").alias("date"), "target").dropna()


def experiment_date(code: Column) -> Column:
    """First of the month of an eight-character code that begins with YYMM; else null."""
    c = F.trim(code)
    ok = (F.length(c) == 8) & F.substring(c, 1, 4).rlike("^[0-9]{4}$")
    return F.when(ok, F.make_date(2000 + F.substring(c, 1, 2).cast("int"), F.substring(c, 3, 2).cast("int"), F.lit(1)))


def latest_activity(activity: DataFrame, structures: DataFrame, panel: str) -> DataFrame:
    """The latest activity of each compound and panel, with its structure."""
    key = F.col("NSC").cast("string")
    a = activity.withColumn("NSC", key)
    best = a.groupBy("NSC", panel).agg(F.max_by(F.struct(*[c for c in a.columns if c not in ("NSC", panel)]), F.struct("RELEASE_DATE", "EXPID")).alias("b")).select("NSC", panel, "b.*")
    s = structures.withColumn("NSC", key).groupBy("NSC").agg(F.min("SMILES").alias("SMILES"))
    return best.join(s, "NSC").withColumnRenamed("AVERAGE", "NLOGGI50_N").dropna(subset=["SMILES", "NLOGGI50_N"])


def dataset_names(files: DataFrame, disguised: bool = False) -> DataFrame:
    """Distinct data set names of `file` names that end in _training.csv or _test.csv."""
    tail = "(?:_training|_test)(?:_disguised)?" if disguised else "(?:_training|_test)"
    name = F.regexp_extract("file", rf"^(.*?){tail}\.csv$", 1)
    return files.select(name.alias("dataset")).filter("dataset <> ''").distinct().orderBy("dataset")


def job_logs(spark: SparkSession, paths: Sequence[str] | str, splitters: Sequence[str], models: Sequence[str] = ()) -> DataFrame:
    """Tab-separated job logs with the splitter and model of their file names; of splitters
    that end a name (before its model, if it ends in one) the longest counts. Names without a
    model are of all models (*)."""
    df = spark.read.csv(paths, sep="\t", header=True, inferSchema=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.tsv$", 1)
    longest = lambda of, names: F.coalesce(*[F.when(of.endswith(s), F.lit(s)) for s in sorted(names, key=len, reverse=True)], F.lit(None).cast("string"))
    df = df.withColumn("key", name).withColumn("model", F.coalesce(longest(F.col("key"), models), F.lit("*")))
    rest = F.rtrim(F.when(F.col("model") == "*", F.col("key")).otherwise(F.expr("substring(key, 1, length(key) - length(model))")), F.lit("._-"))
    return df.withColumn("splitter", longest(rest, splitters))


@dataclass(frozen=True)
class ExperimentConfig:
    datasets: tuple[str, ...] = ()
    splitters: tuple[str, ...] = ()
    seed: int = 42
    ratios: tuple[float, ...] = (0.8,)
    repeats: int = 5
    k_folds: int = 5
    n_runs: int = 10
    tpe_budget: int = 50
    lgbm_rounds: int = 500
    lgbm_rate: float = 0.05
    ad_k: int = 5
    ad_z: float = 1.5
    rest: dict = field(default_factory=dict)


def load_config(text: str) -> ExperimentConfig:
    """Configuration from TOML text, flat or in sections; a single `frac` is a ratio list."""
    flat: dict = {}
    for k, v in tomllib.loads(text).items():
        flat |= v if isinstance(v, dict) else {k: v}
    if "frac" in flat:
        flat.setdefault("ratios", [flat.pop("frac")])
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in ExperimentConfig.__dataclass_fields__ and k != "rest"}
    return ExperimentConfig(**known, rest={k: v for k, v in flat.items() if k not in known})
