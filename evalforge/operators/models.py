"""Regression and classification with Spark's own learners, and their evaluation."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalforge.operators import svr, tpe
from evalforge.operators.tpe import Dimension
from evalforge.sources.scratch import materialise

#: Learners by name: parameters and seed to an estimator. Support vector regression (svr) is this package's own.
LEARNERS = {
    "gbt": lambda seed, maxIter=20, maxDepth=4, stepSize=0.1: GBTRegressor(maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, seed=seed),
    "forest": lambda seed, numTrees=30, maxDepth=6: RandomForestRegressor(numTrees=numTrees, maxDepth=maxDepth, seed=seed),
    "elasticnet": lambda seed, regParam=0.01, elasticNetParam=0.5: LinearRegression(regParam=regParam, elasticNetParam=elasticNetParam),
}
#: What a search by Parzen estimators draws from.
DIMENSIONS: dict[str, dict[str, Dimension]] = {
    "gbt": {"maxIter": Dimension("integer", 10, 60), "maxDepth": Dimension("integer", 2, 8), "stepSize": Dimension("log", 0.02, 0.3)},
    "forest": {"numTrees": Dimension("integer", 10, 80), "maxDepth": Dimension("integer", 3, 12)},
    "elasticnet": {"regParam": Dimension("log", 1e-4, 10.0), "elasticNetParam": Dimension("uniform", 0.0, 1.0)},
    "svr": {"cost": Dimension("log", 0.01, 100.0), "epsilon": Dimension("log", 0.01, 1.0), "gamma": Dimension("log", 1e-4, 1.0)},
}
#: The grid that searches are compared with, in the order of a fixed shuffle.
SPACES: dict[str, dict[str, Sequence]] = {
    "gbt": {"maxIter": (10, 20, 40), "maxDepth": (3, 4, 6), "stepSize": (0.05, 0.1, 0.2)},
    "forest": {"numTrees": (20, 30, 60), "maxDepth": (4, 6, 10)},
    "elasticnet": {"regParam": (0.001, 0.01, 0.1, 1.0), "elasticNetParam": (0.0, 0.5, 1.0)},
}


def fit_predict(train: DataFrame, rows: DataFrame, learner: str, target: str = "y", vector: str = "x", seed: int = 42, **params) -> DataFrame:
    """rows with y_pred of the learner fitted on train."""
    if learner == "svr":
        return svr.predict(svr.fit(train, target, vector, seed=seed, **params), rows, vector)
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner!r}; known: svr, {', '.join(LEARNERS)}")
    v = lambda df: df.withColumn("__v", array_to_vector(vector))
    model = LEARNERS[learner](seed, **params).setFeaturesCol("__v").setLabelCol(target).setPredictionCol("y_pred").fit(v(train))
    return model.transform(v(rows)).drop("__v")


def cross_validated_rms(df: DataFrame, fold: str, learner: str, target: str = "y", vector: str = "x", seed: int = 42, **params) -> DataFrame:
    """(fold, rms) of a learner over the folds of a column."""
    out = None
    for (f,) in sorted(df.select(fold).distinct().collect()):
        p = fit_predict(df.filter(F.col(fold) != f), df.filter(F.col(fold) == f), learner, target, vector, seed, **params)
        r = p.agg(F.lit(f).alias(fold), F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col(target), 2))).alias("rms"))
        out = r if out is None else out.union(r)
    return out


def mean_rms(df: DataFrame, fold: str, learner: str, target: str, vector: str, seed: int, params: dict) -> float:
    """The loss of a trial: the mean over folds of the error on the fold; infinite without folds."""
    found = cross_validated_rms(df, fold, learner, target, vector, seed, **params)
    value = found.agg(F.avg("rms")).first()[0] if found is not None else None
    return math.inf if value is None else value


def _table(df: DataFrame, fold: str, target: str, vector: str) -> DataFrame:
    """What trials read, written once."""
    return materialise(df.select(F.col(fold), F.col(target).cast("double").alias(target), F.col(vector).cast("array<double>").alias(vector)))


def tpe_search(df: DataFrame, fold: str, learner: str, budget: int = 50, batch: int = 4, target: str = "y", vector: str = "x", seed: int = 42) -> list[tpe.Trial]:
    """Trials of one learner by Parzen estimators, `batch` of them at once."""
    rows = _table(df, fold, target, vector)
    return tpe.search(lambda params: mean_rms(rows, fold, learner, target, vector, seed, params), DIMENSIONS[learner], budget, batch, f"{seed}|{learner}")


def binary_quality(df: DataFrame, truth: str, predicted: str, *keys: str) -> DataFrame:
    """Confusion counts, accuracy and Matthews' correlation by keys."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    g = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return g.withColumns({"accuracy": (tp + tn) / (tp + fp + fn + tn), "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, below), F.lit(0.0))})


def train_runs(train: DataFrame, sets: dict[str, DataFrame], learner: str, runs: int, target: str = "y", vector: str = "x", seed: int = 42, **params) -> DataFrame:
    """Predictions of several seeded runs for each named set, with `set` and `run`. A run is fitted once, for all sets
    together; they need the same columns."""
    rows = None
    for name, part in sets.items():
        part = part.withColumn("set", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    out = None
    for run in range(1, runs + 1):
        p = fit_predict(train, rows, learner, target, vector, seed + run, **params).withColumn("run", F.lit(run))
        out = p if out is None else out.unionByName(p)
    return out


def fit_classes(train: DataFrame, rows: DataFrame, target: str = "y", vector: str = "x", trees: int = 30, depth: int = 6, seed: int = 42) -> DataFrame:
    """rows with the class y_pred (0 or 1) of a random forest fitted on train."""
    v = lambda df: df.withColumn("__v", array_to_vector(vector))
    t = v(train).withColumn("__y", F.col(target).cast("double"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="__v", labelCol="__y", predictionCol="y_pred").fit(t)
    return model.transform(v(rows)).drop("__v", "rawPrediction", "probability").withColumn("y_pred", F.col("y_pred").cast("int"))


def candidates(learner: str, seed: int = 42) -> list[dict]:
    """The parameter sets of a learner, shuffled by a hash of the seed."""
    space = SPACES[learner]
    sets = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return sorted(sets, key=lambda p: hashlib.md5(f"{seed}|{learner}|{sorted(p.items())}".encode()).hexdigest())


def select_champion(
    df: DataFrame, fold: str, learners: Sequence[str], budget: int = 20, target: str = "y", vector: str = "x", seed: int = 42, keep: Sequence[int] = (2, 1, 1), first: int = 5, batch: int = 4
) -> list[dict]:
    """Successive halving over learners. In each round every learner still in goes on with its own search by
    Parzen estimators: `first` trials over two folds in the first round, then half
    of what is left of the budget, then the rest, over all folds. The best `keep` learners of a
    round, by the least RMS they have had, go on. A dictionary per learner: learner, params, cv_rms, trials,
    round_eliminated (0 for the champion) and is_champion. The table is written once; `batch` trials run at
    a time."""
    rows = _table(df, fold, target, vector)
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    second = max(0, budget - first) // 2
    plan = [(first, folds[:2]), (second, folds), (max(0, budget - first - second), folds)]
    found = {m: {"learner": m, "params": None, "cv_rms": math.inf, "trials": 0, "round_eliminated": 0, "is_champion": False} for m in learners}
    trials: dict[str, list[tpe.Trial]] = {m: [] for m in learners}
    active = list(learners)
    for number, ((more, over), kept) in enumerate(zip(plan, keep, strict=True), 1):
        part = rows.filter(F.col(fold).isin(over))
        for m in active:
            trials[m] = tpe.search(lambda params, m=m, part=part: mean_rms(part, fold, m, target, vector, seed, params), DIMENSIONS[m], more, batch, f"{seed}|{m}", trials[m])
            if trials[m]:
                top = tpe.best(trials[m])
                found[m].update(params=top.params, cv_rms=top.loss, trials=len(trials[m]))
        active.sort(key=lambda m: (found[m]["cv_rms"], m))
        for m in active[kept:]:
            found[m]["round_eliminated"] = number
        active = active[:kept]
    found[active[0]]["is_champion"] = True
    return list(found.values())


def refit_seed(base: int, name: str) -> int:
    """The seed of a refit, from the search's seed and the learner's name."""
    return int.from_bytes(hashlib.sha256(f"{base}|{name}".encode()).digest()[:4], "big") % (2**31 - 1)


def refit(chosen: dict, train: DataFrame, rows: DataFrame, target: str = "y", vector: str = "x", base_seed: int = 42) -> DataFrame:
    """rows with y_pred of a learner that select_champion returned, fitted on all of train."""
    return fit_predict(train, rows, chosen["learner"], target, vector, refit_seed(base_seed, chosen["learner"]), **(chosen["params"] or {}))
