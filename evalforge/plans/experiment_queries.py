"""Queries over all metrics of an experiment: rank matrices, Tukey's comparisons, annotated predictions, rollups of gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.functions.columns import correlation, tied_rank
from evalforge.operators import composites, ranking
from evalforge.plans.bindings import FEATURES, PREDICTIONS, features, predictions, table
from evalforge.plans.composite_queries import _AVERAGES, _TIED, _complete, averages
from evalforge.plans.metric_queries import SUMMARY, _R, rounded, summary
from evalforge.plans.registry import query

_MATRIX = f"""WITH {_AVERAGES}, rl AS (SELECT 'benchmark' AS target, metric, dataset, splitter, CASE WHEN higher_better THEN -ips ELSE ips END AS v FROM ag
  UNION ALL SELECT 'gap', metric, dataset, splitter, abs(diff) FROM ag), ok AS (SELECT * FROM rl WHERE v IS NOT NULL AND NOT isnan(v)),
gk AS (SELECT target, metric, count(DISTINCT splitter) AS k FROM ok GROUP BY ALL),
full_ AS (SELECT target, metric, dataset FROM ok JOIN gk USING (target, metric) GROUP BY target, metric, dataset, k HAVING count(*) = k),
rk AS (SELECT target, metric, splitter, {_TIED("v", "target, metric, dataset")} AS rank FROM ok JOIN full_ USING (target, metric, dataset)),
mx AS (SELECT target, metric, splitter, avg(rank) AS avg_rank, count(*) AS n_blocks FROM rk GROUP BY ALL)"""


@query(f"{_MATRIX} SELECT target, metric, splitter, {_R('avg_rank')}, n_blocks FROM mx")
def metric_rank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of splitters by each of eleven metrics, of the external figure and of the gap."""
    return rounded(ranking.metric_ranks(averages(spark, sf_dir)))


@query(f"""{_MATRIX}, b AS (SELECT metric, b.avg_rank AS x, g.avg_rank AS y FROM mx b JOIN mx g USING (metric, splitter) WHERE b.target = 'benchmark' AND g.target = 'gap'),
q AS (SELECT metric, {_TIED("round(x, 9)", "metric")} AS rx, {_TIED("round(y, 9)", "metric")} AS ry FROM b)
SELECT metric, count(*) AS n, {_R("coalesce(corr(rx, ry), 'NaN'::DOUBLE)", "rho")} FROM q GROUP BY metric""")
def rank_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's correlation, over splitters, of their ranks by the external figure and by the gap, for each metric."""
    m = ranking.metric_ranks(averages(spark, sf_dir))
    one = lambda target, name: m.filter(F.col("target") == target).select("metric", "splitter", F.round("avg_rank", 9).alias(name))
    both = one("benchmark", "x").join(one("gap", "y"), ["metric", "splitter"])
    both = both.withColumns({"rx": tied_rank("x", ["metric"]), "ry": tied_rank("y", ["metric"])})
    return rounded(both.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.coalesce(correlation(F.col("rx"), F.col("ry")), F.lit(float("nan"))).alias("rho")))


_SCORES = ("rmse", "mae", "r2", "bias")


@query(f"""{SUMMARY}, tv AS (SELECT 'ips' AS kind, splitter, metric, v FROM (SELECT splitter, {", ".join(f"{m}_ips AS {m}" for m in _SCORES)} FROM s) UNPIVOT (v FOR metric IN ({", ".join(_SCORES)}))
  UNION ALL SELECT 'ips - test', splitter, metric, v FROM (SELECT splitter, {", ".join(f"{m}_ips - {m}_test AS {m}" for m in _SCORES)} FROM s) UNPIVOT (v FOR metric IN ({", ".join(_SCORES)}))),
tg AS (SELECT kind, metric, splitter, count(v) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS s2 FROM tv WHERE NOT isnan(v) GROUP BY ALL),
te AS (SELECT kind, metric, sum((n - 1) * s2) / (sum(n) - count(*)) AS mse FROM tg GROUP BY ALL)
SELECT kind, metric, a.splitter AS group1, b.splitter AS group2, round(b.m - a.m, 5) + 0.0 AS difference, round(abs(b.m - a.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 5) + 0.0 AS statistic
FROM tg a JOIN tg b USING (kind, metric) JOIN te USING (kind, metric) WHERE a.splitter < b.splitter""")
def tukey_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of splitters by every metric, of the external figure and of its difference from the internal one."""
    s = summary(spark, sf_dir)
    ips = s.select("splitter", F.lit("ips").alias("kind"), *[F.col(f"{m}_ips").alias(m) for m in _SCORES])
    gap = s.select("splitter", F.lit("ips - test").alias("kind"), *[(F.col(f"{m}_ips") - F.col(f"{m}_test")).alias(m) for m in _SCORES])
    u = ips.unionByName(gap).unpivot(["kind", "splitter"], list(_SCORES), "metric", "v")
    t = ranking.tukey_by(u, ["kind", "metric"], "splitter", "v", intervals=False)
    return t.select("kind", "metric", "group1", "group2", (F.round("difference", 5) + 0.0).alias("difference"), (F.round("statistic", 5) + 0.0).alias("statistic"))


@query(f"""WITH {PREDICTIONS}, {FEATURES}, tr AS (SELECT * FROM feat WHERE label < 5),
di AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_distance(a.x, b.x) AS d, list_distance(a.x, b.x) AS e FROM feat a, tr b WHERE a.vec_id <> b.vec_id),
kn AS (SELECT i, avg(d) AS score FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM di) WHERE r <= 5 GROUP BY i),
li AS (SELECT avg(score) + 1.5 * stddev_samp(score) AS l FROM kn JOIN tr ON vec_id = i),
ad AS (SELECT i AS l_partkey, score, score <= l AS inside, nn FROM kn JOIN (SELECT i, min(e) AS nn FROM di GROUP BY i) USING (i) JOIN feat ON vec_id = i, li WHERE label >= 5),
no AS (SELECT splitter, "set", l_partkey, model, avg(y_pred) AS y_pred, min(y_true) AS y_true FROM pred GROUP BY ALL)
SELECT splitter, "set", model, count(*) AS n, count(score) AS n_scored, count(*) FILTER (inside) AS n_in, {_R("avg(score)", "ad_score")}, {_R("avg(nn)", "nn_dist_to_train")},
  {_R("avg(abs(y_pred - y_true)) FILTER (inside)", "mae_in")} FROM no LEFT JOIN ad USING (l_partkey) GROUP BY ALL""")
def domain_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of parts with the domain of the part's vector: scores of both sets, left joined."""
    f = features(spark, sf_dir)
    p = predictions(spark, sf_dir).drop("sample_id").withColumnRenamed("l_partkey", "sample_id")
    a = composites.annotated(p, f.filter("label < 5"), f.filter("label >= 5"), keys=("splitter", "set"))
    inside = F.coalesce("in_domain", F.lit(False))
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    return rounded(a.groupBy("splitter", "set", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count("ad_score").alias("n_scored"), F.count_if(inside).alias("n_in"), F.avg("ad_score").alias("ad_score"),
        F.avg("nn_dist_to_train").alias("nn_dist_to_train"), F.avg(F.when(inside, e)).alias("mae_in"),
    ))


_GAP = """a AS (SELECT dataset, splitter, avg(abs(y_pred - y_true)) FILTER (in_domain AND "set" = 'test') - avg(abs(y_pred - y_true)) FILTER ("set" = 'ips') AS gap FROM pred GROUP BY ALL)"""


@query(f"""WITH {PREDICTIONS}, {_GAP}, {_complete('abs(gap)', 'b')}
SELECT x.splitter AS splitter1, y.splitter AS splitter2, {_R("abs(x.rank - y.rank)", "difference")} FROM b x JOIN b y ON x.splitter < y.splitter""")
def in_domain_gap_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of average ranks of the gap inside the domain, by magnitude."""
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    inside, ips = F.col("in_domain") & (F.col("set") == "test"), F.col("set") == "ips"
    g = predictions(spark, sf_dir).groupBy("dataset", "splitter").agg((F.avg(F.when(inside, e)) - F.avg(F.when(ips, e))).alias("gap"))
    return rounded(ranking.nemenyi(g, "dataset", "splitter", "gap", absolute=True).select("splitter1", "splitter2", "difference"))


@query(f"""{SUMMARY} SELECT splitter, round(quantile_cont(bias_gap, 0.5), 3) AS median, round(quantile_cont(abs(bias_gap), 0.5), 3) AS median_abs,
  round(quantile_cont(abs(rmse_gap), 0.5), 3) AS median_abs_rmse FROM s GROUP BY splitter""")
def median_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of gaps and of their magnitudes."""
    g = summary(spark, sf_dir).groupBy("splitter")
    return g.agg(F.round(F.median("bias_gap"), 3).alias("median"), F.round(F.median(F.abs("bias_gap")), 3).alias("median_abs"), F.round(F.median(F.abs("rmse_gap")), 3).alias("median_abs_rmse"))


@query(f"""WITH {PREDICTIONS}, t AS (SELECT dataset, avg(y_true) AS m FROM pred WHERE "set" = 'test' GROUP BY dataset)
SELECT dataset, "set", count(*) AS n, count(*) FILTER (y_true >= m) AS n_active FROM pred JOIN t USING (dataset) GROUP BY ALL""")
def binarised_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sets made 0 and 1 at the mean of the internal one, which the external set has no part in."""
    p = predictions(spark, sf_dir)
    t = p.filter("`set` = 'test'").groupBy("dataset").agg(F.avg("y_true").alias("m"))
    return p.join(t, "dataset").groupBy("dataset", "set").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_true") >= F.col("m")).alias("n_active"))


@query("""SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars > 100 AND text IS NOT NULL GROUP BY source""")
def filtered_countmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name occurs among the rows of one unit and line."""
    d = table(spark, sf_dir, "documents").filter("lang = 'en' AND n_chars > 100 AND text IS NOT NULL")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, '{"depth":' || (o_orderkey % 7) || ',"name":"m' || (o_custkey % 5) || '"}' AS params, (o_orderkey % 7)::INT AS depth, 'm' || (o_custkey % 5) AS name FROM orders""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters written as JSON and read back."""
    params = F.struct((F.col("o_orderkey") % 7).cast("int").alias("depth"), F.concat(F.lit("m"), F.col("o_custkey") % 5).alias("name"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(params).alias("params"))
    return o.withColumn("p", F.from_json("params", "depth int, name string")).select("o_orderkey", "params", "p.depth", "p.name")
