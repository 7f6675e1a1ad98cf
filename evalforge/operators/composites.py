"""Whole summaries of an experiment, as tables by name: of predictions with domain columns, and
of champions. Every table is planned by itself; predictions are read once a table unless the
caller keeps them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalforge.operators import distances, metrics, selection

FOLD = ("dataset", "splitter", "rep", "fold")


def ad_summary(pred: DataFrame, ties: Sequence[str], distance: str = "nn_dist_to_train") -> dict[str, DataFrame]:
    """Of predictions (dataset, splitter, rep, fold, set, y_true, y_pred, in_domain, ...):
    reports of both sets, the share of the external set inside the domain, metrics of the
    external set by domain and of the internal set inside it, and external distances. The keys
    have no model: several models of a fold are pooled. Rows without a value or prediction are
    left out of reports, those without a domain out of the tables by domain."""
    known = pred.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    ips = pred.filter(F.col("set") == "ips")
    inside = F.coalesce("in_domain", F.lit(False))
    out = {
        "fold_reports": metrics.fold_report(known, [*FOLD, "set"], ties).withColumnRenamed("splitter", "algorithm"),
        "coverage": ips.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_in"), F.avg(inside.cast("int")).alias("coverage")),
        "metrics_by_domain": metrics.fold_metrics(ips.filter("in_domain IS NOT NULL"), [*FOLD, "in_domain"]),
        "metrics_in_domain": metrics.fold_metrics(pred.filter(F.col("set") == "test").filter(inside), FOLD),
    }
    if distance in pred.columns:
        out["distances"] = ips.filter(F.col(distance).isNotNull()).select("dataset", "splitter", distance)
    return out


def normalised(pred: DataFrame, sample: str = "sample_id", keys: Sequence[str] = ()) -> DataFrame:
    """One row a sample and model: as they are if a column says which is the champion (one model a fold was chosen), else
    the means over runs, every model counting as its own champion."""
    by = [*keys, sample, "model"]
    truth, guess = F.min("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred")
    if "is_champion" in pred.columns:
        return pred.groupBy(*by, "is_champion").agg(truth, guess)
    return pred.groupBy(*by).agg(truth, guess).withColumn("is_champion", F.lit(True))


def annotated(pred: DataFrame, train: DataFrame, asked: DataFrame, sample: str = "sample_id", keys: Sequence[str] = (), k: int = 5, z: float = 1.5, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """Predictions, normalised, with ad_score and in_domain (mean cosine distance to the k nearest training rows
    against the training rows' own) and nn_dist_to_train (the least distance to one) of their sample's row of
    `asked`. Predictions of samples without a row keep nulls."""
    domain = distances.knn_domain(train, asked, k, z, "cosine", key, vector).withColumnRenamed("score", "ad_score")
    near = distances.nn_distance(asked, train, "euclidean", key, vector).select(F.col("query").alias(key), F.col("d").alias("nn_dist_to_train"))
    known = domain.join(near, key).withColumnRenamed(key, sample)
    return normalised(pred, sample, keys).join(known, sample, "left")


def champion_summary(pred: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """Of predictions with model and is_champion, and what is known of the models (dataset,
    splitter, rep, fold, model, is_champion, cv_rms): the champions, how much better the champion
    of a fold is inside the domain than the best other (null with one model), averaged by data
    set and splitter; the quality of each fold's choice, and its means."""
    keys = [*FOLD, "model", "is_champion"]
    inside = pred.filter((F.col("set") == "ips") & F.coalesce("in_domain", F.lit(False)))
    rmse = F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2))).alias("rmse")
    quality = lambda rows: selection.selection_quality(rows.groupBy(*keys).agg(rmse), FOLD, "rmse")
    best = meta.groupBy(*FOLD, "model").agg(F.min("cv_rms").alias("cv_rms"))
    folds = pred.filter(F.col("set") == "ips").groupBy(*keys).agg(rmse).join(best, [*FOLD, "model"], "left")
    chosen = selection.selection_quality(folds, FOLD, "rmse")
    champions = meta.filter(F.coalesce("is_champion", F.lit(False))).groupBy(*FOLD).agg(F.min(F.struct("model", "cv_rms")).alias("m"))
    means = selection.quality_by(chosen, ("dataset", "splitter"))
    return {
        "champions": champions.select(*FOLD, "m.model", "m.cv_rms"),
        "ips_advantage": quality(inside).groupBy("dataset", "splitter").agg(F.avg("best_advantage").alias("ips_adv_rmse")),
        "fold_metrics": folds,
        "fold_selection": chosen,
        "selection_by_dataset": means.select("dataset", "splitter", "mean_advantage", "best_advantage"),
        "hit_rates": means.select("dataset", "splitter", "hit_rate"),
    }
