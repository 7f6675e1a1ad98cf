"""Splits by design: Kennard-Stone and its relatives, OptiSim and dissimilarity selection,
and splits by clusters. The selections are those of `selections`, over the whole table."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalforge.operators import clustering, distances, selections, splits
from evalforge.operators.selections import Geometry

CUTOFF = 0.35
#: Share of the train rows that the Morais variant exchanges.
EXCHANGED = 0.1

#: Name -> (distance of the features, rule, candidates of a step of OptiSim).
METHODS: dict[str, tuple[str, str, int]] = {
    "kennardstone": ("jaccard", "kennard_stone", 0),
    "mdks": ("mahalanobis", "kennard_stone", 0),
    "spxy-jaccard": ("jaccard", "kennard_stone", 0),
    "spxy-euclidean": ("euclidean", "kennard_stone", 0),
    "morais": ("euclidean", "morais", 0),
    "optisim": ("jaccard", "optisim", 50),
    "maximum_dissimilarity": ("jaccard", "optisim", 0),
    "minimum_dissimilarity": ("jaccard", "optisim", 1),
}


def geometry_of(df: DataFrame, method: str, key: str, vector: str, target: str | None, metric: str | None = None) -> Geometry:
    """The distances of a method: whitened ones for mahalanobis; for SPXY those of features and of the target, each over the
    largest in the table."""
    metric = metric or METHODS[method][0]
    g = Geometry("euclidean" if metric == "mahalanobis" else metric)
    rows = df.select(F.col(vector).cast("array<double>").alias("x"))
    if metric == "mahalanobis" and not rows.isEmpty():
        s, n = distances.scatter(rows, "x", distances.mean_vector(rows, "x"))
        cov = s / max(1, n - 1)
        g.linear = np.linalg.pinv(np.linalg.cholesky(cov + np.eye(len(cov)) * 1e-9 * max(1.0, np.trace(cov)))).T
    if method.startswith("spxy"):
        far = selections.farthest_pair(df, g, key, vector)
        low, high = df.agg(F.min(F.col(target).cast("double")), F.max(F.col(target).cast("double"))).first()
        g.x_scale, g.y_scale = (far[2] if far else 0.0) or 1.0, ((high or 0.0) - (low or 0.0)) or 1.0
    return g


def picked(df: DataFrame, method: str, m: int, key: str = "vec_id", vector: str = "x", target: str | None = None, metric: str | None = None, seed: str = "42", cutoff: float = CUTOFF) -> DataFrame:
    """(key): the rows that a method picks, m at most (OptiSim and dissimilarity selection may stop before)."""
    _, rule, candidates = METHODS[method]
    g = geometry_of(df, method, key, vector, target, metric)
    y = target if method.startswith("spxy") else None
    if rule == "optisim":
        return selections.optisim(df, m, g, candidates, cutoff, seed, key, vector).select(key)
    chosen = selections.kennard_stone(df, m, g, key, vector, y).select(key)
    if rule == "kennard_stone":
        return chosen
    # Kennard-Stone, then a share of the rows chosen and as many left out change places, both in a random order.
    n = df.count()
    swaps = min(int(EXCHANGED * m), n - m)
    rest = df.select(key).join(chosen, key, "left_anti")
    stay = splits.shuffled_rank(chosen, key, seed).filter(F.col("rank") > swaps).select(key)
    return stay.union(splits.shuffled_rank(rest, key, seed).filter(F.col("rank") <= swaps).select(key))


def design_split(
    df: DataFrame, method: str, frac: float, key: str = "vec_id", vector: str = "x", target: str | None = None, metric: str | None = None, seed: str = "42"
) -> DataFrame:
    """df with `part`: the rows that the method picks, round(frac * n) of all (OptiSim and dissimilarity selection may
    stop before), are train, all others test."""
    if method not in METHODS:
        raise ValueError(f"unknown design {method!r}; known: {', '.join(sorted(METHODS))}")
    if not 0 < frac < 1:
        raise ValueError("frac must lie between 0 and 1")
    if method.startswith("spxy") and target is None:
        raise ValueError(f"{method} needs a target")
    train = picked(df, method, int(np.floor(frac * df.count() + 0.5)), key, vector, target, metric, seed)
    return df.join(train.withColumn("__t", F.lit("train")), key, "left").withColumn("part", F.coalesce("__t", F.lit("test"))).drop("__t")


def clustered(df: DataFrame, algorithm: str, k: int = 10, key: str = "vec_id", vector: str = "x", seed: int = 42, cutoff: float = CUTOFF) -> DataFrame:
    """df with `cluster`, by the name of the algorithm. The prefix pca stands for a projection to two principal
    components before it; pca alone is followed by k-means."""
    name = algorithm
    if name.startswith("pca"):
        name = name.removeprefix("pca").lstrip("-") or "kmeans"
        v = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
        v = PCA(k=2, inputCol="__v", outputCol="__p").fit(v).transform(v)
        low = clustered(v.select(key, vector_to_array("__p").alias("x")), name, k, key, "x", seed, cutoff).select(key, "cluster")
        return df.join(low, key)
    if name == "kmeans":
        return clustering.kmeans(df, k, seed, vector)
    if name == "kmedoids":
        return clustering.kmedoids(df, k, key, vector)
    if name == "hac":
        return clustering.hac(df, k, key, vector)
    if name in ("butina", "sphere_exclusion"):
        near = clustering.neighbours(df, cutoff, key, vector, "jaccard")
        if name == "butina":
            return df.join(clustering.butina_reordered(df, near, key).select(key, "cluster"), key)
        return df.join(clustering.butina(df, near, key).withColumnRenamed("centroid", "cluster"), key)
    raise ValueError(f"unknown algorithm {algorithm!r}; known: butina, hac, kmeans, kmedoids, pca, sphere_exclusion and pca- before any")


def cluster_splitter(df: DataFrame, mode: str, frac: float, key: str = "vec_id", cluster: str = "cluster", seed: str = "42") -> DataFrame:
    """stratified: the share of each cluster is train; shuffle: whole clusters are."""
    if mode == "stratified":
        return splits.stratified_split(df, key, cluster, frac, seed)
    if mode == "shuffle":
        return splits.cluster_split(df, cluster, frac, seed)
    raise ValueError(f"unknown mode {mode!r}; known: shuffle, stratified")


def _by_clusters(algorithm: str, mode: str, cutoff: float = CUTOFF):
    def split(df, frac, key="vec_id", vector="x", target=None, seed="42", k=10):
        c = clustered(df, algorithm, k, key, vector, abs(hash_of(seed)) % 2**31, cutoff)
        return cluster_splitter(c, mode, frac, key, "cluster", seed).drop("cluster")

    return split


def hash_of(seed: str) -> int:
    return int.from_bytes(seed.encode()[-8:], "big")


def _by_design(method: str):
    return lambda df, frac, key="vec_id", vector="x", target=None, seed="42": design_split(df, method, frac, key, vector, target, seed=seed)


#: Splitters of one interface: (df, frac, key, vector, target, seed) -> df with `part`.
REGISTRY = {
    "random": lambda df, frac, key="vec_id", vector="x", target=None, seed="42": splits.random_split(df, key, frac, seed).drop("rank"),
    **{m: _by_design(m) for m in METHODS},
    **{f"{a}_{m}": _by_clusters(a, m) for a in ("kmeans", "kmedoids", "hac") for m in ("stratified", "shuffle")},
    "butina": _by_clusters("butina", "shuffle", 0.2),
    "pca": _by_clusters("pca", "shuffle"),
}


def make_splitter(name: str):
    if name not in REGISTRY:
        raise ValueError(f"unknown splitter {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
