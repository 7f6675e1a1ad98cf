"""Queries of prediction tables: metrics, summaries, selection, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.functions.columns import tidy
from evalforge.operators import metrics
from evalforge.plans.bindings import PREDICTIONS, TIES, predictions
from evalforge.plans.registry import query

FOLD = ("dataset", "splitter", "model", "rep", "fold")
GROUP = ("dataset", "splitter", "set")


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Doubles other than the keys rounded to 6 places."""
    return df.select(*[tidy(c).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


_SUMMARY = """
e AS (SELECT dataset, splitter, model, rep, fold, "set", sqrt(avg((y_pred - y_true) ** 2)) AS rmse,
  CASE WHEN min(y_true) = max(y_true) THEN 'NaN'::DOUBLE ELSE 1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*)) END AS r2,
  avg(abs(y_pred - y_true)) AS mae, avg(y_pred - y_true) AS bias FROM pred GROUP BY ALL),
s AS (SELECT t.dataset, t.splitter, t.model, t.rep, t.fold, t.rmse AS rmse_test, t.r2 AS r2_test, t.mae AS mae_test, t.bias AS bias_test,
  i.rmse AS rmse_ips, i.r2 AS r2_ips, i.mae AS mae_ips, i.bias AS bias_ips, i.rmse - t.rmse AS rmse_gap, t.r2 - i.r2 AS r2_gap,
  abs(i.rmse - t.rmse) AS abs_rmse_gap, i.bias - t.bias AS bias_gap
  FROM e t JOIN e i ON t.dataset = i.dataset AND t.splitter = i.splitter AND t.model = i.model AND t.rep = i.rep AND t.fold = i.fold
  WHERE t."set" = 'test' AND i."set" = 'ips')"""
SUMMARY = f"WITH {PREDICTIONS}, {_SUMMARY}"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.layer1_summary(predictions(spark, sf_dir), FOLD)


_NUMBERS = ("rmse_test", "r2_test", "mae_test", "bias_test", "rmse_ips", "r2_ips", "mae_ips", "bias_ips", "rmse_gap", "r2_gap", "abs_rmse_gap", "bias_gap")
_R = lambda c, a=None: f"round({c}, 6) + 0.0 AS {a or c}"


@query(f"{SUMMARY} SELECT dataset, splitter, model, rep, fold, {', '.join(map(_R, _NUMBERS))} FROM s")
def layer1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(spark, sf_dir))


_LONG = """
l AS (SELECT dataset, splitter, model, rep, fold, 'test' AS "set", r2_test AS R2, rmse_test AS RMSE, mae_test AS MAE, bias_test AS Bias FROM s
  UNION ALL SELECT dataset, splitter, model, rep, fold, 'ips', r2_ips, rmse_ips, mae_ips, bias_ips FROM s)"""
LONG = f"{SUMMARY}, {_LONG}"


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.layer1_long(summary(spark, sf_dir), FOLD)


@query(f'{LONG} SELECT dataset, splitter, model, rep, fold, "set", {", ".join(_R(c) for c in ("R2", "RMSE", "MAE", "Bias"))} FROM l')
def layer1_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long(spark, sf_dir))


@query(f"""WITH {PREDICTIONS},
k AS (SELECT *, rank() OVER (PARTITION BY dataset, splitter, "set" ORDER BY y_true) + (count(*) OVER (PARTITION BY dataset, splitter, "set", y_true) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY dataset, splitter, "set" ORDER BY y_pred) + (count(*) OVER (PARTITION BY dataset, splitter, "set", y_pred) - 1) / 2.0 AS rp FROM pred),
m AS (SELECT dataset, splitter, "set", count(*) AS n, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae,
  median(abs(y_pred - y_true)) AS medae, 1 - sum((y_pred - y_true) ** 2) / nullif(var_pop(y_true) * count(*), 0) AS r2,
  corr(y_true, y_pred) AS pearson, corr(rt::DOUBLE, rp::DOUBLE) AS spearman FROM k GROUP BY ALL)
SELECT dataset, splitter, "set", n, {", ".join(f"CASE WHEN n < 2 THEN 'NaN'::DOUBLE ELSE round({c}, 6) + 0.0 END AS {c}" for c in ("rmse", "mae", "medae", "r2", "pearson", "spearman"))} FROM m""")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fold_metrics(predictions(spark, sf_dir), GROUP))


@query(f"""WITH {PREDICTIONS}, k AS (SELECT dataset, splitter, "set", fold, y_true AS x, y_pred AS y, row_number() OVER () AS i FROM pred),
p AS (SELECT a.dataset, a.splitter, a."set", a.fold, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS sx, sum(abs(sign(a.y - b.y))) AS sy
  FROM k a JOIN k b ON a.dataset = b.dataset AND a.splitter = b.splitter AND a."set" = b."set" AND a.fold = b.fold AND a.i < b.i GROUP BY ALL),
n AS (SELECT dataset, splitter, "set", fold, count(*) AS n FROM k GROUP BY ALL)
SELECT n.*, CASE WHEN sx IS NULL OR sx * sy = 0 THEN 'NaN'::DOUBLE ELSE round(s / sqrt(sx::DOUBLE * sy), 6) + 0.0 END AS kendall
FROM n LEFT JOIN p USING (dataset, splitter, "set", fold)""")
def kendall_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kendall(predictions(spark, sf_dir), (*GROUP, "fold")))


@query(f"""WITH {PREDICTIONS}, m AS (SELECT dataset, splitter, rep, fold, run, "set", 1 - sum((y_pred - y_true) ** 2) / nullif(var_pop(y_true) * count(*), 0) AS r2x,
  sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae, median(abs(y_pred - y_true)) AS medae,
  avg(abs((y_pred - y_true) / nullif(y_true, 0))) AS mape, max(abs(y_pred - y_true)) AS max_error,
  min(y_true) = max(y_true) AS flat, 1 - var_samp(y_pred - y_true) / nullif(var_samp(y_true), 0) AS ev FROM pred GROUP BY ALL)
SELECT dataset, splitter, rep, fold, run, "set", CASE WHEN flat THEN 'NaN'::DOUBLE ELSE round(r2x, 6) + 0.0 END AS r2, {", ".join(map(_R, ("rmse", "mae", "medae", "mape", "max_error")))},
  CASE WHEN flat THEN 'NaN'::DOUBLE ELSE round(ev, 6) + 0.0 END AS explained_variance FROM m""")
def performance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.performance_metrics(predictions(spark, sf_dir), ("dataset", "splitter", "rep", "fold", "run", "set")))


_RANKED = f"""WITH {PREDICTIONS},
k AS (SELECT *, count(*) OVER (PARTITION BY dataset, splitter, "set") AS n,
  row_number() OVER (PARTITION BY dataset, splitter, "set" ORDER BY y_true DESC, {", ".join(TIES)}) AS rt,
  row_number() OVER (PARTITION BY dataset, splitter, "set" ORDER BY y_pred DESC, {", ".join(TIES)}) AS rp FROM pred)"""
_EF = lambda k: f"""round((count(*) FILTER (rt <= greatest(1, round_even(n * {k}, 0)) AND rp <= greatest(1, round_even(n * {k}, 0))) / max(greatest(1, round_even(n * {k}, 0))))
  / (max(greatest(1, round_even(n * {k}, 0))) / max(n)), 6) + 0.0 AS ef{round(100 * k)}"""  # noqa: E731


@query(f"""{_RANKED} SELECT dataset, splitter, "set", {_EF(0.05)}, {_EF(0.1)}, {_EF(0.2)} FROM k GROUP BY ALL""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.top_k_enrichment(predictions(spark, sf_dir), GROUP, (0.05, 0.1, 0.2), TIES))


@query(f"""{_RANKED}, a AS (SELECT *, greatest(1, round_even(n * 0.2, 0)) AS na FROM k),
g AS (SELECT dataset, splitter, "set", max(n) AS n, max(na)::DOUBLE AS na, sum(CASE WHEN rt <= na THEN exp(-20.0::DOUBLE * rp / n) ELSE 0 END) AS s FROM a GROUP BY ALL)
SELECT dataset, splitter, "set", n, round(
  (s / na / ((1.0::DOUBLE / n) * (1 - exp(-20.0::DOUBLE)) / (exp(20.0::DOUBLE / n) - 1))) * (na / n) * sinh(10.0::DOUBLE) / (cosh(10.0::DOUBLE) - cosh(10.0::DOUBLE - 20.0::DOUBLE * na / n))
  + 1 / (1 - exp(20.0::DOUBLE * (1 - na / n))), 6) + 0.0 AS bedroc FROM g""")
def bedroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.bedroc(predictions(spark, sf_dir), GROUP, TIES))
