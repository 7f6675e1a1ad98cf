"""Queries of ranks, rank tests, multi-criteria rankings, reshaping and scalar work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.functions.columns import tied_rank
from evalforge.operators import ranking
from evalforge.plans.bindings import PREDICTIONS, predictions, table
from evalforge.plans.metric_queries import SUMMARY, _R, rounded, summary
from evalforge.plans.registry import query

_MEANS = f"{SUMMARY}, m AS (SELECT dataset, splitter, avg(rmse_ips) AS perf, avg(rmse_gap) AS gap FROM s GROUP BY ALL)"


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir).groupBy("dataset", "splitter").agg(F.avg("rmse_ips").alias("perf"), F.avg("rmse_gap").alias("gap"))


_TIED = lambda v, k, d="": f"rank() OVER (PARTITION BY {k} ORDER BY {v} {d}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0::DOUBLE"


@query("""WITH g AS (SELECT l_linenumber::INT AS line, l_quantity AS quantity, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, rank() OVER (PARTITION BY line ORDER BY quantity) + 0.0::DOUBLE AS first_rank FROM g""")
def quantity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").alias("quantity")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("first_rank", tied_rank("quantity", ["line"]))


@query(f"SELECT p_partkey, p_brand, {_TIED('p_size', 'p_brand')} AS rank FROM part")
def tied_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", tied_rank("p_size", ["p_brand"]).alias("rank"))


@query(f"""{_MEANS}, r AS (SELECT splitter, row_number() OVER (PARTITION BY dataset ORDER BY perf, splitter) AS place FROM m)
SELECT splitter, {_R("avg(place)", "place")}, count(*) AS n_datasets FROM r GROUP BY splitter""")
def ordinal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranking.ordinal_ranks(means(spark, sf_dir), ["dataset"], "splitter", "perf", False)
    return rounded(r.groupBy("splitter").agg(F.avg("place").alias("place"), F.count(F.lit(1)).alias("n_datasets")))


_FRIEDMAN = f"""{_MEANS}, r AS (SELECT dataset, splitter, {_TIED('perf', 'dataset')} AS rank FROM m),
g AS (SELECT splitter, sum(rank) AS s, avg(rank) AS avg_rank, count(*) AS n FROM r GROUP BY splitter)"""


@query(f"{_FRIEDMAN} SELECT splitter, {_R('avg_rank')}, {_R('s', 'rank_sum')}, n AS n_blocks FROM g")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.average_ranks(ranking.complete_blocks(means(spark, sf_dir), "dataset", "splitter", "perf"), "dataset", "splitter", "perf"))


@query(f"""{_FRIEDMAN} SELECT max(n) AS n, count(*)::INT AS k, {_R("12 * sum(s * s) / (max(n) * count(*) * (count(*) + 1)) - 3 * max(n) * (count(*) + 1)", "q")} FROM g""")
def friedman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.friedman(means(spark, sf_dir), "dataset", "splitter", "perf").select("n", "k", "q"))


@query(f"""{_FRIEDMAN}, q AS (SELECT max(n) AS n, count(*) AS k, 12 * sum(s * s) / (max(n) * count(*) * (count(*) + 1)) - 3 * max(n) * (count(*) + 1) AS q FROM g)
SELECT n, k::INT AS k, {_R("(n - 1) * q / (n * (k - 1) - q)", "iman_f")} FROM q""")
def iman_davenport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iman and Davenport's statistic; its p value is in friedman_tests."""
    return rounded(ranking.friedman(means(spark, sf_dir), "dataset", "splitter", "perf").select("n", "k", "iman_f"))


@query()
def friedman_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.friedman(means(spark, sf_dir), "dataset", "splitter", "perf")


@query(f"""{_FRIEDMAN} SELECT a.splitter AS splitter1, b.splitter AS splitter2, {_R("a.avg_rank", "rank1")}, {_R("b.avg_rank", "rank2")}, {_R("abs(a.avg_rank - b.avg_rank)", "difference")}
FROM g a JOIN g b ON a.splitter < b.splitter""")
def nemenyi_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ranking.nemenyi(means(spark, sf_dir), "dataset", "splitter", "perf")
    return rounded(n.select("splitter1", "splitter2", "rank1", "rank2", "difference"))


@query()
def nemenyi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.nemenyi(means(spark, sf_dir), "dataset", "splitter", "perf"))


@query()
def homogeneous_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranking.average_ranks(means(spark, sf_dir), "dataset", "splitter", "perf")
    head = r.agg(F.count(F.lit(1)), F.max("n_blocks")).first()
    return ranking.homogeneous_spans(r, "splitter", ranking.critical_difference(head[0], head[1]))


@query(f"""{SUMMARY}, m AS (SELECT dataset, splitter, avg(rmse_ips) AS rmse_ips, avg(mae_ips) AS mae_ips, avg(abs_rmse_gap) AS abs_rmse_gap, avg(abs(bias_gap)) AS bias_gap FROM s GROUP BY ALL),
u AS (SELECT metric, dataset, splitter, v FROM m UNPIVOT (v FOR metric IN (rmse_ips, mae_ips, abs_rmse_gap, bias_gap))),
r AS (SELECT metric, splitter, {_TIED('v', 'metric, dataset')} AS rank FROM u)
SELECT metric, splitter, {_R("avg(rank)", "avg_rank")} FROM r GROUP BY ALL""")
def all_metric_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = summary(spark, sf_dir).groupBy("dataset", "splitter").agg(*[F.avg(c).alias(c) for c in ("rmse_ips", "mae_ips", "abs_rmse_gap")], F.avg(F.abs("bias_gap")).alias("bias_gap"))
    u = m.unpivot(["dataset", "splitter"], ["rmse_ips", "mae_ips", "abs_rmse_gap", "bias_gap"], "metric", "v")
    return rounded(ranking.average_ranks(u, "dataset", "splitter", "v", "metric").select("metric", "splitter", "avg_rank"))


@query(f"""{_MEANS}, r AS (SELECT dataset, {_TIED('perf', 'dataset')} AS a, {_TIED('gap', 'dataset')} AS b FROM m)
SELECT dataset, count(*) AS n, {_R("corr(a, b)", "rho")} FROM r GROUP BY dataset""")
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.rank_correlation(means(spark, sf_dir), "perf", "gap", "dataset"))


_NORMED = f"""{_MEANS}, c AS (SELECT dataset, splitter, perf, abs(gap) AS gap FROM m),
w AS (SELECT dataset, splitter, 2 / 3.0::DOUBLE * perf / sqrt(sum(perf * perf) OVER d) AS p, 1 / 3.0::DOUBLE * gap / sqrt(sum(gap * gap) OVER d) AS g FROM c WINDOW d AS (PARTITION BY dataset)),
x AS (SELECT *, sqrt((p - min(p) OVER d) ** 2 + (g - min(g) OVER d) ** 2) AS best, sqrt((p - max(p) OVER d) ** 2 + (g - max(g) OVER d) ** 2) AS worst FROM w WINDOW d AS (PARTITION BY dataset))"""
_CRITERIA = {"perf": (2.0, False), "gap": (1.0, False)}


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(spark, sf_dir).withColumn("gap", F.abs("gap"))


@query(f"""{_NORMED}, t AS (SELECT dataset, splitter, worst / (best + worst) AS score FROM x)
SELECT dataset, splitter, {_R("score")}, {_TIED('round(score, 12)', 'dataset', 'DESC')} AS rank FROM t""")
def topsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.topsis(_criteria(spark, sf_dir), ["dataset"], _CRITERIA).select("dataset", "splitter", "score", "rank"))


@query(f"""{_NORMED}, t AS (SELECT dataset, splitter, -p - g AS score FROM x)
SELECT dataset, splitter, {_R("score")}, {_TIED('round(score, 12)', 'dataset', 'DESC')} AS rank FROM t""")
def moora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.moora(_criteria(spark, sf_dir), ["dataset"], _CRITERIA).select("dataset", "splitter", "score", "rank"))


@query(f"""{_NORMED}, t AS (SELECT dataset, splitter, worst / (best + worst) AS score FROM x),
r AS (SELECT splitter, score, {_TIED('round(score, 12)', 'dataset', 'DESC')} AS rank FROM t)
SELECT splitter, {_R("avg(rank)", "mean_rank")}, {_R("avg(score)", "mean_score")} FROM r GROUP BY splitter""")
def ranking_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = ranking.check_complete(_criteria(spark, sf_dir), "dataset", "splitter")
    return rounded(ranking.topsis(full, ["dataset"], _CRITERIA).groupBy("splitter").agg(F.avg("rank").alias("mean_rank"), F.avg("score").alias("mean_score")))


@query()
def tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.tukey_hsd(summary(spark, sf_dir), "model", "rmse_ips"))


@query(f"""{SUMMARY}, g AS (SELECT model, count(*) AS n, avg(rmse_ips) AS m, var_samp(rmse_ips) AS v FROM s GROUP BY model),
t AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum((n - 1) * v) AS within, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS between FROM g)
SELECT k, n, round((between / (k - 1)) / (within / (n - k)), 4) AS f FROM t""")
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.anova(summary(spark, sf_dir), "model", "rmse_ips").select("k", "n", F.round("f", 4).alias("f"))


@query("""SELECT event_type, round(regr_slope(value, user_id), 9) AS slope, round(regr_intercept(value, user_id), 6) AS intercept FROM events GROUP BY 1""")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("user_id").cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.regr_slope("value", x), 9).alias("slope"), F.round(F.regr_intercept("value", x), 6).alias("intercept"))


@query(f"""{_FRIEDMAN}, p AS (SELECT a.splitter AS x, b.splitter AS y, a.avg_rank - b.avg_rank AS v FROM g a JOIN g b ON a.splitter < b.splitter)
SELECT x AS "row", y AS "column", {_R("v", "value")} FROM p UNION ALL SELECT y, x, {_R("-v", "v")} FROM p UNION ALL SELECT splitter, splitter, 0.0::DOUBLE FROM g""")
def rank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ranking.nemenyi(means(spark, sf_dir), "dataset", "splitter", "perf").withColumn("v", F.col("rank1") - F.col("rank2"))
    return rounded(ranking.long_pairs_to_matrix(n, "splitter1", "splitter2", "v", True))


# Projections, filters and scalar functions.
_FAMILY = """CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'distance' WHEN p_brand LIKE '%2%' THEN 'cluster' ELSE 'random' END"""


def family(name: Column) -> Column:
    return F.when(name.isin("Brand#11", "Brand#12", "Brand#13"), "distance").when(name.contains("2"), "cluster").otherwise("random")


@query(f"""WITH {PREDICTIONS.replace("p_brand AS splitter", "p_brand AS splitter, " + _FAMILY + " AS family")} SELECT family, "set", count(*) AS n, {_R("avg(abs(y_pred - y_true))", "mae")} FROM pred GROUP BY ALL""")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("family", family(F.col("splitter")))
    return rounded(p.groupBy("family", "set").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae")))


@query("""SELECT p_partkey, upper(substr(p_type, 1, 2)) || right(p_brand, 2) AS code, CASE WHEN p_brand LIKE 'Brand#%' THEN replace(p_brand, 'Brand#', 'B') ELSE p_brand END AS short FROM part""")
def short_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("p_brand")
    short = F.when(b.startswith("Brand#"), F.replace(b, F.lit("Brand#"), F.lit("B"))).otherwise(b)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper(F.substring("p_type", 1, 2)), F.right(b, F.lit(2))).alias("code"), short.alias("short"))


@query("""WITH m AS (SELECT avg(p_retailprice) AS m FROM part) SELECT p_partkey, CASE WHEN p_retailprice < m THEN 0 ELSE 1 END::INT AS y FROM part, m""")
def binarised_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    mean = part.agg(F.avg("p_retailprice").alias("m"))  # one row
    return part.join(F.broadcast(mean)).select("p_partkey", F.when(F.col("p_retailprice") < F.col("m"), 0).otherwise(1).alias("y"))


@query("""SELECT strftime(make_date(2000 + (extract(year FROM o_orderdate) % 100)::BIGINT, extract(month FROM o_orderdate), 1), '%Y-%m-%d') AS month, count(*) AS n FROM orders GROUP BY 1""")
def experiment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates from codes of two digits of the year and two of the month."""
    code = F.concat(F.date_format("o_orderdate", "yyMM"), F.lit("NS01"))
    month = F.make_date(F.lit(2000) + F.substring(code, 1, 2).cast("int"), F.substring(code, 3, 2).cast("int"), F.lit(1))
    return table(spark, sf_dir, "orders").groupBy(month.cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT json_extract(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1""")
def json_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c_custkey, c_mktsegment, last, greatest(last, TIMESTAMP '1998-01-01') AS at FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null-aware later of two dates after a left join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "c_mktsegment", "last", F.greatest("last", F.to_timestamp(F.lit("1998-01-01"))).alias("at"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", -F.col("o_orderkey"))).alias("b")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_orderdate")


@query("""SELECT n_name, r_name, s.n AS suppliers, c.n AS customers FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey""")
def outer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    s = t("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    c = t("customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "full").select("n_name", "r_name", "suppliers", "customers")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(big, "p_partkey", "left_anti")


@query("""SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 99 END, p_type""")
def custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.create_map(F.lit("PROMO"), F.lit(1), F.lit("SMALL"), F.lit(2))
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.coalesce(F.try_element_at(place, F.col("p_type")), F.lit(99)), "p_type")
