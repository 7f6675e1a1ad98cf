"""Queries that summarise score tables, and champion selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalforge.operators import selection, summaries
from evalforge.plans.bindings import PREDICTIONS, predictions, table
from evalforge.plans.metric_queries import LONG, SUMMARY, _R, long, rounded, summary
from evalforge.plans.registry import query

METRICS = ("R2", "RMSE", "MAE", "Bias")
IDS = ("dataset", "splitter", "set")
_SCORES = f"""{LONG},
u AS (SELECT dataset, splitter, "set", metric, score FROM (SELECT dataset, splitter, "set", R2, RMSE, MAE, Bias FROM l) UNPIVOT (score FOR metric IN (R2, RMSE, MAE, Bias)))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.unpivoted(long(spark, sf_dir), IDS, METRICS)


@query(f"""WITH {PREDICTIONS}, r AS (SELECT dataset, splitter, rep, fold, "set", run, sqrt(avg((y_pred - y_true) ** 2)) AS rmse,
  CASE WHEN count(*) > 1 THEN avg(abs(y_pred - y_true)) END AS mae FROM pred GROUP BY ALL)
SELECT dataset, splitter, rep, fold, "set", {_R("avg(rmse)", "rmse")}, CASE WHEN count(*) = count(mae) THEN round(avg(mae), 6) END AS mae FROM r GROUP BY ALL""")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("y_pred") - F.col("y_true")
    runs = predictions(spark, sf_dir).groupBy(*IDS, "rep", "fold", "run").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.when(F.count(F.lit(1)) > 1, F.avg(F.abs(e))).alias("mae")
    )
    return rounded(summaries.merge_runs(runs, ("dataset", "splitter", "rep", "fold", "set"), ("rmse", "mae")))


@query(f"""{_SCORES} SELECT splitter, dataset, metric, "set", {_R("avg(score)", "score")} FROM u GROUP BY ALL""")
def mean_scores_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.mean_scores(scores(spark, sf_dir), ("splitter", "dataset", "metric", "set")))


_BENCH = f"""{_SCORES},
b AS (SELECT splitter, dataset, metric, avg(score) FILTER ("set" = 'ips') AS benchmark, avg(score) FILTER ("set" = 'test') AS internal FROM u GROUP BY ALL),
g AS (SELECT *, CASE WHEN metric = 'R2' THEN benchmark - internal ELSE internal - benchmark END AS gap_library FROM b)"""


@query(f"{_BENCH} SELECT splitter, dataset, metric, {_R('benchmark')}, {_R('internal')}, {_R('gap_library')} FROM g")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.benchmark_summary(scores(spark, sf_dir), ("splitter", "dataset")))


@query(f"{_BENCH} SELECT splitter, dataset, metric, {_R('benchmark')}, {_R('internal')}, {_R('-gap_library', 'gap_manuscript')} FROM g")
def manuscript_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.manuscript_gap(scores(spark, sf_dir), ("splitter", "dataset")))


@query(f"""{_SCORES} SELECT dataset, splitter, {_R("avg(score)", "score")} FROM u WHERE metric = 'RMSE' AND "set" = 'ips' GROUP BY ALL""")
def perdataset_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).filter((F.col("metric") == "RMSE") & (F.col("set") == "ips"))
    return rounded(summaries.mean_scores(s, ("dataset", "splitter")))


_R2_GAPS = f"{SUMMARY}, d AS (SELECT dataset, splitter, rep, fold, r2_gap FROM s)"


@query(f"""{_R2_GAPS} SELECT dataset, splitter, coalesce(round(avg(r2_gap) FILTER (isfinite(r2_gap)), 6), 'NaN'::DOUBLE) AS r2_gap FROM d GROUP BY ALL""")
def collapsed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.collapsed(summary(spark, sf_dir), ("dataset", "splitter"), "r2_gap"))


@query(f"""{_R2_GAPS} SELECT splitter, {_R("coalesce(min(r2_gap) FILTER (isfinite(r2_gap)), 0)", "low")}, {_R("coalesce(max(r2_gap) FILTER (isfinite(r2_gap)), 0)", "high")},
  {_R("coalesce(max(r2_gap) FILTER (isfinite(r2_gap)), 0) - coalesce(min(r2_gap) FILTER (isfinite(r2_gap)), 0)", '"range"')} FROM d GROUP BY ALL""")
def gap_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.spread(summary(spark, sf_dir), "splitter", "r2_gap"))


@query(f"{SUMMARY} SELECT splitter, {_R('avg(bias_gap)', 'mean')}, {_R('min(bias_gap)', 'low')}, {_R('max(bias_gap)', 'high')} FROM s GROUP BY ALL")
def plain_gap_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.plain_spread(summary(spark, sf_dir), "splitter", "bias_gap"))


@query(f"""{SUMMARY} SELECT splitter, model, {_R("median(rmse_ips) FILTER (isfinite(rmse_ips))", "rmse_ips")}, {_R("median(r2_gap) FILTER (isfinite(r2_gap))", "r2_gap")} FROM s GROUP BY ALL""")
def quadrant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.finite_medians(summary(spark, sf_dir), ("splitter", "model"), ("rmse_ips", "r2_gap")))


_DIFF = f"""{SUMMARY}, d AS (SELECT dataset, splitter, avg(rmse_gap) AS d FROM s GROUP BY ALL)"""


def _mean_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir).groupBy("dataset", "splitter").agg(F.avg("rmse_gap").alias("d"))


@query(f"""{_DIFF} SELECT splitter, count(*) FILTER (abs(d) > 500) AS abs_ct, count(*) FILTER (d > 500) AS opt_ct, count(*) FILTER (d < -500) AS pess_ct,
  count(DISTINCT dataset) AS n_datasets FROM d GROUP BY splitter""")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.threshold_counts(_mean_gaps(spark, sf_dir), "splitter", "d", 500.0, higher_better=False)


@query(f"""{_DIFF} SELECT splitter, t * 200.0::DOUBLE AS threshold, {_R("count(*) FILTER (abs(d) > t * 200.0) / 15.0::DOUBLE", "share")}
FROM d, range(0, 16) AS x(t) GROUP BY ALL""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.threshold_sweep(_mean_gaps(spark, sf_dir), "splitter", "d", [200.0 * t for t in range(16)], 15), "threshold")


@query(f"""{SUMMARY} SELECT splitter, round(quantile_cont(bias_gap, 0.5), 3) AS median, round(quantile_cont(bias_gap, 0.25), 3) AS q25, round(quantile_cont(bias_gap, 0.75), 3) AS q75
FROM s GROUP BY splitter""")
def bias_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.quartiles(summary(spark, sf_dir), ("splitter",), "bias_gap")


_MODELS = ("A", "N", "R")


@query(f"""{SUMMARY} SELECT splitter, {", ".join(f"round(quantile_cont(rmse_gap, 0.5) FILTER (model = '{m}'), 3) AS {m}" for m in _MODELS)} FROM s GROUP BY splitter""")
def gap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = summaries.quartiles(summary(spark, sf_dir), ("splitter", "model"), "rmse_gap")
    return summaries.pivoted(q, "splitter", "model", _MODELS, "median")


@query(f"""{SUMMARY}, p AS (SELECT "column", v FROM (SELECT rmse_test, rmse_ips, mae_test, mae_ips FROM s) UNPIVOT (v FOR "column" IN (rmse_test, rmse_ips, mae_test, mae_ips)))
SELECT "column", count(v) AS n, {_R("avg(v)", "mean")}, {_R("stddev_samp(v)", "sd")}, {_R("min(v)", "low")}, {_R("quantile_cont(v, 0.25)", "q25")}, {_R("median(v)", "median")},
  {_R("quantile_cont(v, 0.75)", "q75")}, {_R("max(v)", "high")} FROM p GROUP BY "column" """)
def described_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.describe(summary(spark, sf_dir), ("rmse_test", "rmse_ips", "mae_test", "mae_ips")))


@query(f"""{SUMMARY} SELECT dataset, splitter, {_R("avg(rmse_test) - avg(rmse_ips)", "delta_rmse")}, {_R("avg(r2_ips) - avg(r2_test)", "delta_r2")} FROM s GROUP BY ALL""")
def cross_experiment_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = summary(spark, sf_dir).groupBy("dataset", "splitter")
    return rounded(g.agg((F.avg("rmse_test") - F.avg("rmse_ips")).alias("delta_rmse"), (F.avg("r2_ips") - F.avg("r2_test")).alias("delta_r2")))


@query(f"""{LONG}, m AS (SELECT dataset, splitter, avg(RMSE) FILTER ("set" = 'ips') AS ips, avg(RMSE) FILTER ("set" = 'test') - avg(RMSE) FILTER ("set" = 'ips') AS diff FROM l GROUP BY ALL)
SELECT dataset, splitter, {_R("ips")}, {_R("diff")} FROM m""")
def performance_and_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips, test = (F.avg(F.when(F.col("set") == s, F.col("RMSE"))) for s in ("ips", "test"))
    return rounded(long(spark, sf_dir).groupBy("dataset", "splitter").agg(ips.alias("ips"), (test - ips).alias("diff")))


@query("""SELECT event_type AS rule, count(*) AS n, round(avg(value), 2) AS s_mean, round(quantile_cont(value, 0.95), 2) AS s_p95, round(max(value), 2) AS s_max,
  round(avg(user_id), 2) AS rss_mean, round(quantile_cont(user_id, 0.95), 2) AS rss_p95, round(max(user_id)::DOUBLE, 2) AS rss_max FROM events GROUP BY 1""")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), "value", F.col("user_id").cast("double").alias("rss"))
    return summaries.job_summary(e, "rule", "value", "rss")


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def worst_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("SELECT concat_ws('_', p_brand, p_type) AS value, count(*) AS n FROM part GROUP BY 1")
def countmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.concat_ws("_", "p_brand", "p_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))


# Champion selection: the model with the least internal error of a fold.
_CHAMPS = f"""{SUMMARY},
c AS (SELECT *, row_number() OVER (PARTITION BY dataset, splitter, rep, fold ORDER BY rmse_test, model) AS rank FROM s)"""
CONTEST = ("dataset", "splitter", "rep", "fold")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.champions(summary(spark, sf_dir), CONTEST, "rmse_test")


@query(f"""{_CHAMPS} SELECT dataset, splitter, rep, fold, model, {_R("rmse_test")}, CASE WHEN rank > 2 THEN 1 WHEN rank > 1 THEN 2 ELSE 0 END::INT AS round_eliminated, rank::INT AS rank FROM c""")
def halving_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.halving_rounds(summary(spark, sf_dir), CONTEST, "rmse_test")
    return rounded(out.select(*CONTEST, "model", "rmse_test", "round_eliminated", "rank"))


_QUALITY = f"""{_CHAMPS},
q AS (SELECT dataset, splitter, rep, fold, count(*) AS n, max(rmse_ips) FILTER (rank = 1) AS mine, avg(rmse_ips) FILTER (rank > 1) AS m, min(rmse_ips) FILTER (rank > 1) AS b
  FROM c GROUP BY ALL HAVING count(*) > 1),
a AS (SELECT dataset, splitter, rep, fold, n, m - mine AS mean_advantage, b - mine AS best_advantage, mine <= b AS hit FROM q)"""


@query(f"{_QUALITY} SELECT dataset, splitter, rep, fold, n, {_R('mean_advantage')}, {_R('best_advantage')}, hit FROM a")
def selection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.selection_quality(marked(spark, sf_dir), CONTEST, "rmse_ips"))


@query(f"""{_QUALITY} SELECT dataset, splitter, {_R("avg(mean_advantage)", "mean_advantage")}, {_R("avg(best_advantage)", "best_advantage")}, {_R("avg(hit::INT)", "hit_rate")} FROM a GROUP BY ALL""")
def selection_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = selection.selection_quality(marked(spark, sf_dir), CONTEST, "rmse_ips")
    return rounded(selection.quality_by(q, ("dataset", "splitter")))


@query(f"""{_QUALITY}, h AS (SELECT dataset, splitter, avg(hit::INT) AS hit_rate FROM a GROUP BY ALL)
SELECT splitter, {_R("avg(hit_rate)", "mean")}, {_R("stddev_samp(hit_rate)", "sd")}, {_R("median(hit_rate)", "median")} FROM h GROUP BY splitter""")
def hit_rate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = selection.selection_quality(marked(spark, sf_dir), CONTEST, "rmse_ips")
    return rounded(selection.rate_statistics(selection.quality_by(q, ("dataset", "splitter")), "splitter", "hit_rate"))


@query(f"{_QUALITY}, f AS (SELECT dataset, splitter, avg(best_advantage) AS ips_advantage FROM a GROUP BY ALL) SELECT dataset, splitter, {_R('ips_advantage')} FROM f")
def ips_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = selection.selection_quality(marked(spark, sf_dir), CONTEST, "rmse_ips")
    return rounded(q.groupBy("dataset", "splitter").agg(F.avg("best_advantage").alias("ips_advantage")))


@query(f"""{_CHAMPS}, f AS (SELECT splitter, model, count(*) AS n FROM c WHERE rank = 1 GROUP BY ALL)
SELECT splitter, model, n, {_R("n / sum(n) OVER (PARTITION BY splitter)", "share")} FROM f""")
def champion_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = marked(spark, sf_dir).filter("is_champion").groupBy("splitter", "model").agg(F.count(F.lit(1)).alias("n"))
    return rounded(f.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("splitter"))))


_OF = lambda f, m: f"{f} FILTER (model = '{m}')"


@query(f"""{SUMMARY}, m AS (SELECT splitter, {", ".join(f"{_OF(f, m)} AS {n}{m}" for m in "AR" for f, n in (("count(*)", "n"), ("avg(rmse_ips)", "m"), ("var_samp(rmse_ips)", "v")))} FROM s GROUP BY splitter)
SELECT splitter, CASE WHEN nA > 1 AND nR > 1 THEN round((mA - mR) / sqrt(((nA - 1) * vA + (nR - 1) * vR) / (nA + nR - 2)), 6) + 0.0 ELSE 'NaN'::DOUBLE END AS cohens_d FROM m""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.cohens_d(summary(spark, sf_dir), "splitter", "model", "rmse_ips", "A", "R"))


# Applicability domain columns of predictions.
@query(f"""WITH {PREDICTIONS} SELECT dataset, splitter, "set", count(*) AS n, count(*) FILTER (in_domain) AS n_in, {_R("count(*) FILTER (in_domain) / count(*)", "coverage")} FROM pred GROUP BY ALL""")
def ad_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.count_if(F.coalesce("in_domain", F.lit(False)))
    g = predictions(spark, sf_dir).groupBy(*IDS).agg(F.count(F.lit(1)).alias("n"), inside.alias("n_in"))
    return rounded(g.withColumn("coverage", F.col("n_in") / F.col("n")))


@query(f"""WITH {PREDICTIONS} SELECT splitter, CASE WHEN in_domain THEN 'In-domain' ELSE 'Out-of-domain' END AS domain, count(*) AS n, {_R("median(abs(y_pred - y_true))", "medae")}
FROM pred WHERE "set" = 'test' GROUP BY ALL HAVING count(*) >= 5""")
def domain_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).filter("`set` = 'test'")
    p = p.withColumn("domain", F.when(F.col("in_domain"), "In-domain").otherwise("Out-of-domain"))
    g = p.groupBy("splitter", "domain").agg(F.count(F.lit(1)).alias("n"), F.median(F.abs(F.col("y_pred") - F.col("y_true"))).alias("medae"))
    return rounded(g.filter("n >= 5"))


@query(f"""WITH {PREDICTIONS}, a AS (SELECT dataset, splitter, in_domain, avg(abs(y_pred - y_true)) AS mae FROM pred GROUP BY ALL)
SELECT splitter, in_domain, {_R("avg(mae)", "mae")} FROM a GROUP BY ALL""")
def conditional_on_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = predictions(spark, sf_dir).groupBy("dataset", "splitter", "in_domain").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    return rounded(per.groupBy("splitter", "in_domain").agg(F.avg("mae").alias("mae")))


@query(f"""WITH {PREDICTIONS}, a AS (SELECT dataset, splitter, avg(abs(y_pred - y_true)) FILTER (in_domain AND "set" = 'test') - avg(abs(y_pred - y_true)) FILTER ("set" = 'ips') AS gap FROM pred GROUP BY ALL)
SELECT dataset, splitter, {_R("gap")}, {_R("abs(gap)", "abs_gap")} FROM a""")
def in_domain_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    inside, ips = F.col("in_domain") & (F.col("set") == "test"), F.col("set") == "ips"
    g = predictions(spark, sf_dir).groupBy("dataset", "splitter").agg((F.avg(F.when(inside, e)) - F.avg(F.when(ips, e))).alias("gap"))
    return rounded(g.withColumn("abs_gap", F.abs("gap")))


@query(f"""WITH {PREDICTIONS} SELECT dataset, splitter, rep, fold, "set", sample_id, l_partkey, l_suppkey, model, {_R("min(y_true)", "y_true")}, {_R("avg(y_pred)", "y_pred")}, true AS is_champion
FROM pred GROUP BY ALL""")
def normalised_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = (*CONTEST, "set", "sample_id", "l_partkey", "l_suppkey", "model")
    return rounded(predictions(spark, sf_dir).groupBy(*keys).agg(F.min("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"), F.lit(True).alias("is_champion")))

