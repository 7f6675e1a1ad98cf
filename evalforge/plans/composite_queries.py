"""Queries that compose operators: whole fold reports, multi-criteria views, core tables of a
metric, joins between summaries, and labels of splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.functions import columns
from evalforge.operators import metrics, ranking
from evalforge.plans.bindings import PREDICTIONS, TIES, predictions, table
from evalforge.plans.metric_queries import _LONG, _R, _SUMMARY, GROUP, long, rounded, summary
from evalforge.plans.registry import ORACLES, query
from evalforge.plans.summary_queries import CONTEST
from evalforge.sources.scratch import materialise

#: Metrics of a fold report and whether more of them is better.
METRICS = {
    "rmse": False, "mae": False, "medae": False, "r2": True, "pearson": True, "spearman": True, "kendall": True, "ef5": True, "ef10": True, "ef20": True, "bedroc": True,
}
CONSTRUCTS = (("rmse", "mae", "medae"), ("r2",), ("pearson", "spearman", "kendall"), ("ef5", "ef10", "ef20", "bedroc"))

_KENDALL = f"""WITH {PREDICTIONS}, k AS (SELECT dataset, splitter, "set", y_true AS x, y_pred AS y, row_number() OVER () AS i FROM pred),
p AS (SELECT a.dataset, a.splitter, a."set", sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS sx, sum(abs(sign(a.y - b.y))) AS sy
  FROM k a JOIN k b ON a.dataset = b.dataset AND a.splitter = b.splitter AND a."set" = b."set" AND a.i < b.i GROUP BY ALL),
n AS (SELECT DISTINCT dataset, splitter, "set" FROM k)
SELECT n.*, CASE WHEN sx IS NULL OR sx * sy = 0 THEN 'NaN'::DOUBLE ELSE round(s / sqrt(sx::DOUBLE * sy), 6) + 0.0 END AS kendall FROM n LEFT JOIN p USING (dataset, splitter, "set")"""
_REPORT = f"""SELECT dataset, splitter, "set", f.n, rmse, mae, medae, r2, pearson, spearman, kendall,
  {", ".join(f"CASE WHEN f.n < 2 THEN 'NaN'::DOUBLE ELSE {c} END AS {c}" for c in ("ef5", "ef10", "ef20", "bedroc"))}
FROM ({ORACLES["fold_metrics"]}) f JOIN ({_KENDALL}) k USING (dataset, splitter, "set") JOIN ({ORACLES["enrichment"]}) e USING (dataset, splitter, "set")
JOIN ({ORACLES["bedroc"]}) b USING (dataset, splitter, "set")"""


@query(_REPORT)
def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fold_report(predictions(spark, sf_dir), GROUP, TIES))


_AVERAGES = f"""fr AS ({_REPORT}), lr AS (SELECT dataset, splitter, "set", metric, v FROM fr UNPIVOT (v FOR metric IN ({", ".join(METRICS)}))),
w AS (SELECT dataset, splitter, metric, max(v) FILTER ("set" = 'ips') AS ips, max(v) FILTER ("set" = 'test') AS test FROM lr GROUP BY ALL),
av AS (SELECT *, metric IN ({", ".join(f"'{m}'" for m, up in METRICS.items() if up)}) AS higher_better FROM w),
ag AS (SELECT *, CASE WHEN higher_better THEN test - ips ELSE ips - test END AS diff FROM av)"""


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, splitter, metric, ips, test, higher_better, diff) of the fold reports, written once for all
    that reads them."""
    u = fold_report(spark, sf_dir).unpivot([*GROUP], list(METRICS), "metric", "v")
    w = u.groupBy("dataset", "splitter", "metric").agg(*[F.max(F.when(F.col("set") == s, F.col("v"))).alias(s) for s in ("ips", "test")])
    up = F.col("metric").isin([m for m, better in METRICS.items() if better])
    return materialise(w.withColumns({"higher_better": up, "diff": F.when(up, F.col("test") - F.col("ips")).otherwise(F.col("ips") - F.col("test"))}))


@query(f"WITH {_AVERAGES} SELECT dataset, splitter, metric, ips, test, higher_better, round(diff, 6) + 0.0 AS diff FROM ag")
def metric_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(averages(spark, sf_dir))


def _view_sql(view: str, tag: str, weights: dict[str, float] | None = None) -> str:
    weight = "1.0::DOUBLE" if weights is None else "CASE metric " + " ".join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in weights.items()) + " END"
    ips = "SELECT dataset, splitter, 'ips:' || metric AS criterion, metric, ips AS v, higher_better AS benefit FROM ag"
    diff = "SELECT dataset, splitter, 'diff:' || metric AS criterion, metric, abs(diff) AS v, false AS benefit FROM ag"
    rows = {"performance": ips, "credibility": diff, "combined": f"{ips} UNION ALL {diff}"}[view]
    n = len(METRICS) * (2 if view == "combined" else 1)
    return f"""{tag}1 AS (SELECT *, {weight} AS w, count(*) OVER (PARTITION BY dataset, splitter) AS have FROM ({rows}) WHERE v IS NOT NULL AND NOT isnan(v)),
{tag}2 AS (SELECT *, count(*) OVER (PARTITION BY dataset, criterion) AS rows, sqrt(sum(v * v) OVER (PARTITION BY dataset, criterion)) AS norm, sum(w) OVER (PARTITION BY dataset, splitter) AS total FROM {tag}1 WHERE have = {n}),
{tag}3 AS (SELECT *, coalesce(v / nullif(norm, 0), 0) * w / total AS z FROM {tag}2 WHERE rows > 1),
{tag}4 AS (SELECT *, CASE WHEN benefit THEN max(z) OVER c ELSE min(z) OVER c END AS best, CASE WHEN benefit THEN min(z) OVER c ELSE max(z) OVER c END AS worst FROM {tag}3 WINDOW c AS (PARTITION BY dataset, criterion)),
{tag}5 AS (SELECT dataset, splitter, sqrt(sum((z - best) ** 2)) AS up, sqrt(sum((z - worst) ** 2)) AS down, sum(CASE WHEN benefit THEN z ELSE -z END) AS moora FROM {tag}4 GROUP BY ALL),
{tag}6 AS (SELECT dataset, splitter, 'TOPSIS' AS method, coalesce(down / nullif(up + down, 0), 0.5) AS score FROM {tag}5 UNION ALL SELECT dataset, splitter, 'MOORA', moora FROM {tag}5),
{tag}7 AS (SELECT *, rank() OVER (PARTITION BY dataset, method ORDER BY round(score, 9) DESC) + (count(*) OVER (PARTITION BY dataset, method, round(score, 9)) - 1) / 2.0::DOUBLE AS rank FROM {tag}6),
{tag} AS (SELECT splitter, '{view}' AS "view", method, avg(rank) AS mean_rank, avg(score) AS mean_score, count(*) AS n_datasets FROM {tag}7 GROUP BY splitter, method)"""


_VIEWS = ", ".join(_view_sql(v, v[0] + v[1]) for v in ranking.VIEWS)


@query(f"""WITH {_AVERAGES}, {_VIEWS}, u AS ({" UNION ALL ".join(f"SELECT * FROM {v[0] + v[1]}" for v in ranking.VIEWS)})
SELECT splitter, "view", method, {_R("mean_rank")}, {_R("mean_score")}, n_datasets FROM u""")
def ranking_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = averages(spark, sf_dir)
    out = [ranking.ranking_views(a, v) for v in ranking.VIEWS]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]))


_WEIGHTS = {m: 1 / len(c) for c in CONSTRUCTS for m in c}


@query(f"""WITH {_AVERAGES}, {_view_sql("combined", "x")}, {_view_sql("combined", "y", _WEIGHTS)},
j AS (SELECT splitter, a.mean_rank AS a, b.mean_rank AS b FROM x a JOIN y b USING (splitter) WHERE a.method = 'TOPSIS' AND b.method = 'TOPSIS'),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM j),
e AS (SELECT list_sort(list(splitter ORDER BY a, splitter)[:3]) = list_sort(list(splitter ORDER BY b, splitter)[:3]) AS top_same,
  list_sort(list(splitter ORDER BY a DESC, splitter)[:2]) = list_sort(list(splitter ORDER BY b DESC, splitter)[:2]) AS bottom_same FROM j)
SELECT (SELECT round(corr(ra, rb), 6) + 0.0 FROM r) AS rho, top_same, bottom_same FROM e""")
def weight_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined view with equal weights against one weight a construct."""
    a = averages(spark, sf_dir)
    one, other = (ranking.ranking_views(a, "combined", w).filter("method = 'TOPSIS'").withColumn("mean_rank", F.round("mean_rank", 9)) for w in (None, _WEIGHTS))
    return rounded(ranking.compare_rankings(one, other))


@query(f"""WITH {_AVERAGES}, {_view_sql("performance", "pe")}, {_view_sql("credibility", "cr")}
SELECT splitter, a.method, {_R("a.mean_rank", "perf_rank")}, {_R("b.mean_rank", "cred_rank")} FROM pe a JOIN cr b USING (splitter, method)""")
def performance_and_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = averages(spark, sf_dir)
    p, c = (ranking.ranking_views(a, v).select("splitter", "method", F.col("mean_rank").alias(n)) for v, n in (("performance", "perf_rank"), ("credibility", "cred_rank")))
    return rounded(p.join(c, ["splitter", "method"]))


# Labels of splitters. Names, families and codes are fixed values.
FAMILIES = {
    "Kennard–Stone": ("kennardstone", "mdks", "morais", "spxy-euclidean", "spxy-jaccard"),
    "Diversity": ("optisim", "minimum_dissimilarity", "maximum_dissimilarity"),
    "Random": ("random",),
    "Clustering (Shuffle)": ("butina",),
}
CODES = {
    "kennardstone": "KS", "mdks": "MDKS", "morais": "Morais", "spxy-euclidean": "SPXY", "spxy-jaccard": "SPXY-J", "optisim": "OptiSim", "minimum_dissimilarity": "MinDis",
    "maximum_dissimilarity": "MaxDis", "random": "Rand", "butina": "Butina", "kmeans_stratified": "KM-strat", "kmeans_shuffle": "KM-shuf", "kmedoids_stratified": "KMed-strat",
    "kmedoids_shuffle": "KMed-shuf", "hac_stratified": "HAC-strat", "hac_shuffle": "HAC-shuf",
}
ALGORITHMS = {"butina": "B", "hierarchical": "H", "kmeans": "KM", "kmedoids": "KMed"}
NAMES = (*CODES, "umap-hierarchical_stratified", "umap", "umap_butina", "hierarchical_shuffle", "other")


def splitter_family(name: Column) -> Column:
    out = F.when(name.contains("stratified"), "Clustering (Stratified)").when(name.contains("shuffle"), "Clustering (Shuffle)").otherwise("Clustering (Other)")
    for family, names in FAMILIES.items():
        out = F.when(name.isin(*names), family).otherwise(out)
    return out


def short_code(name: Column) -> Column:
    """A known name's code; else U for a projection, the letters of the algorithms (C for a
    projection alone, nothing for neither) and the way clusters are dealt."""
    letters = F.concat(*[F.when(name.contains(a), c).otherwise("") for a, c in ALGORITHMS.items()])
    letters = F.when(name.contains("umap"), F.concat(F.lit("U"), F.when(letters == "", "C").otherwise(letters))).otherwise(letters)
    rest = F.concat(letters, F.when(name.contains("stratified"), "-strat").otherwise("-shuf"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), name), rest)


_NAME_OF = "[" + ", ".join(f"'{n}'" for n in NAMES) + f"][(hash_place % {len(NAMES)} + 1)::INT]"
_FAMILY_SQL = "CASE " + " ".join("WHEN name IN (" + ", ".join(f"'{n}'" for n in ns) + f") THEN '{f}'" for f, ns in FAMILIES.items()) + """
  WHEN name LIKE '%stratified%' THEN 'Clustering (Stratified)' WHEN name LIKE '%shuffle%' THEN 'Clustering (Shuffle)' ELSE 'Clustering (Other)' END"""
_LETTERS = " || ".join(f"CASE WHEN name LIKE '%{a}%' THEN '{c}' ELSE '' END" for a, c in ALGORITHMS.items())
_CODE_SQL = "CASE " + " ".join(f"WHEN name = '{n}' THEN '{c}'" for n, c in CODES.items()) + f""" ELSE
  CASE WHEN name LIKE '%umap%' THEN 'U' || CASE WHEN {_LETTERS} = '' THEN 'C' ELSE {_LETTERS} END ELSE {_LETTERS} END || CASE WHEN name LIKE '%stratified%' THEN '-strat' ELSE '-shuf' END END"""


@query(f"""WITH p AS (SELECT p_partkey, p_partkey AS hash_place FROM part), n AS (SELECT p_partkey, {_NAME_OF} AS name FROM p)
SELECT p_partkey, name, {_FAMILY_SQL} AS family, {_CODE_SQL} AS code FROM n""")
def splitter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod(F.col("p_partkey"), F.lit(len(NAMES))) + 1).cast("int"))
    n = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return n.select("p_partkey", "name", splitter_family(F.col("name")).alias("family"), short_code(F.col("name")).alias("code"))


# Core table of one metric: external and gap ranks of the splitters.
_TIED = lambda v, k, d="": f"rank() OVER (PARTITION BY {k} ORDER BY {v} {d}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0::DOUBLE"
_CORE = f"""m AS (SELECT dataset, splitter, "set", avg(MAE) AS v FROM l GROUP BY ALL),
a AS (SELECT dataset, splitter, max(v) FILTER ("set" = 'ips') AS ips, max(v) FILTER ("set" = 'ips') - max(v) FILTER ("set" = 'test') AS diff FROM m GROUP BY ALL)"""


def _complete(v: str, tag: str) -> str:
    return f"""{tag}f AS (SELECT dataset FROM a WHERE {v} IS NOT NULL GROUP BY dataset HAVING count(*) = (SELECT count(DISTINCT splitter) FROM a WHERE {v} IS NOT NULL)),
{tag}r AS (SELECT splitter, {_TIED(v, 'dataset')} AS rank FROM a JOIN {tag}f USING (dataset)), {tag} AS (SELECT splitter, avg(rank) AS rank FROM {tag}r GROUP BY splitter)"""


@query(f"""WITH {PREDICTIONS}, {_SUMMARY}, {_LONG}, {_CORE}, {_complete('ips', 'b')}, {_complete('abs(diff)', 'g')}
SELECT splitter, {_R("b.rank", "bench")}, {_R("g.rank", "gap")} FROM b JOIN g USING (splitter)""")
def core_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(core(spark, sf_dir))


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of MAE per data set, splitter and set, the gap, and average ranks of both over the
    complete data sets."""
    m = long(spark, sf_dir).groupBy("dataset", "splitter", "set").agg(F.avg("MAE").alias("v"))
    a = m.groupBy("dataset", "splitter").agg(*[F.max(F.when(F.col("set") == s, F.col("v"))).alias(s) for s in ("ips", "test")])
    a = a.withColumn("diff", F.abs(columns.gap(F.col("test"), F.col("ips"), False)))
    ranks = lambda v: ranking.average_ranks(ranking.complete_blocks(a, "dataset", "splitter", v), "dataset", "splitter", v)
    return ranks("ips").select("splitter", F.col("avg_rank").alias("bench")).join(ranks("diff").select("splitter", F.col("avg_rank").alias("gap")), "splitter")


@query(f"""WITH {PREDICTIONS}, {_SUMMARY}, {_LONG}, {_CORE}, {_complete('ips', 'b')}, {_complete('abs(diff)', 'g')},
u AS (SELECT splitter, 'MAE' AS metric, 'Benchmark' AS target, rank FROM b UNION ALL SELECT splitter, 'MAE', 'Gap', rank FROM g)
SELECT right(splitter, 1) AS family, metric, target, {_R("avg(rank)", "mean_rank")} FROM u GROUP BY ALL""")
def family_rank_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both frames of ranks united, averaged by family (here the last digit of the splitter)."""
    c = core(spark, sf_dir).select("splitter", F.lit("MAE").alias("metric"), "bench", "gap")
    both = c.select("splitter", "metric", F.lit("Benchmark").alias("target"), F.col("bench").alias("rank")).unionByName(c.select("splitter", "metric", F.lit("Gap").alias("target"), F.col("gap").alias("rank")))
    return rounded(both.groupBy(F.right("splitter", F.lit(1)).alias("family"), "metric", "target").agg(F.avg("rank").alias("mean_rank")))


@query(f"""WITH {PREDICTIONS}, a AS (SELECT dataset, splitter, avg(in_domain::INT) AS cov FROM pred GROUP BY ALL), {_complete('cov', 'b').replace("ORDER BY cov ", "ORDER BY cov DESC ")}
SELECT x.splitter AS splitter1, y.splitter AS splitter2, {_R("abs(x.rank - y.rank)", "difference")} FROM b x JOIN b y ON x.splitter < y.splitter""")
def coverage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of average ranks of the mean coverage, more being better."""
    a = predictions(spark, sf_dir).groupBy("dataset", "splitter").agg(F.avg(F.col("in_domain").cast("int")).alias("cov"))
    return rounded(ranking.nemenyi(a, "dataset", "splitter", "cov", higher_better=True).select("splitter1", "splitter2", "difference"))


# Joins between summaries.
@query(f"""WITH {PREDICTIONS}, {_SUMMARY}, meta AS (SELECT DISTINCT dataset, splitter, rep, fold, model, first(run) OVER (PARTITION BY dataset, splitter, rep, fold, model ORDER BY run) AS first_run FROM pred WHERE l_partkey % 2 = 0)
SELECT dataset, splitter, rep, fold, model, {_R("rmse_ips")}, first_run FROM s LEFT JOIN meta USING (dataset, splitter, rep, fold, model)""")
def metrics_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with what is known of the runs, one row of the latter each."""
    keys = (*CONTEST, "model")
    meta = predictions(spark, sf_dir).filter("l_partkey % 2 = 0").groupBy(*keys).agg(F.min("run").cast("int").alias("first_run"))
    return rounded(summary(spark, sf_dir).select(*keys, "rmse_ips").join(meta, list(keys), "left"))


_FOLD_MAX = """x AS (SELECT dataset, splitter, rep, fold, "set", median(abs(y_pred - y_true)) AS medae, max(abs(y_pred - y_true)) AS worst FROM pred WHERE model <> 'N' GROUP BY ALL)"""


@query(f"""WITH {PREDICTIONS}, {_SUMMARY}, {_LONG}, {_FOLD_MAX}
SELECT dataset, splitter, model, rep, fold, "set", {_R("RMSE")}, {_R("medae")}, {_R("worst")} FROM l LEFT JOIN x USING (dataset, splitter, rep, fold, "set")""")
def long_with_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    keys = (*CONTEST, "set")
    x = predictions(spark, sf_dir).filter("model <> 'N'").groupBy(*keys).agg(F.median(e).alias("medae"), F.max(e).alias("worst"))
    return rounded(long(spark, sf_dir).select(*keys, "model", "RMSE").join(x, list(keys), "left"))


@query(f"""WITH {PREDICTIONS}, {_SUMMARY}, q AS (SELECT dataset, splitter, rep, fold, count(*) AS n, avg(y_true) FILTER ("set" = 'ips') - avg(y_true) FILTER ("set" = 'test') AS shift, avg(in_domain::INT) AS inside FROM pred GROUP BY ALL),
a AS (SELECT dataset, splitter, avg(n) AS n, avg(shift) AS shift, avg(inside) AS inside FROM q GROUP BY ALL), g AS (SELECT dataset, splitter, avg(rmse_gap) AS gap FROM s GROUP BY ALL)
SELECT dataset, splitter, {_R("gap")}, {_R("n")}, {_R("shift")}, {_R("inside")} FROM g JOIN a USING (dataset, splitter)""")
def gap_and_split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of splits, averaged by data set and splitter, beside the gaps."""
    y = lambda s: F.avg(F.when(F.col("set") == s, F.col("y_true")))
    q = predictions(spark, sf_dir).groupBy(*CONTEST).agg(F.count(F.lit(1)).alias("n"), (y("ips") - y("test")).alias("shift"), F.avg(F.col("in_domain").cast("int")).alias("inside"))
    a = q.groupBy("dataset", "splitter").agg(*[F.avg(c).alias(c) for c in ("n", "shift", "inside")])
    g = summary(spark, sf_dir).groupBy("dataset", "splitter").agg(F.avg("rmse_gap").alias("gap"))
    return rounded(g.join(a, ["dataset", "splitter"]))


@query(f"""WITH {PREDICTIONS}, e AS (SELECT run, splitter, sqrt(avg((y_pred - y_true) ** 2)) AS rmse FROM pred WHERE run < 3 GROUP BY ALL)
SELECT a.splitter, {_R("a.rmse", "rmse_1")}, {_R("b.rmse", "rmse_2")}, {_R("b.rmse - a.rmse", "change")} FROM e a LEFT JOIN e b ON a.splitter = b.splitter AND b.run = 2 WHERE a.run = 1""")
def cross_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment's figures beside another's, by label."""
    rmse = F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2)))
    of = lambda run: predictions(spark, sf_dir).filter(F.col("run") == run).groupBy("splitter").agg(rmse.alias(f"rmse_{run}"))
    return rounded(of(1).join(of(2), "splitter", "left").withColumn("change", F.col("rmse_2") - F.col("rmse_1")))


_DOMAIN_METRICS = ("rmse", "mae", "medae", "pearson")
_DOMAIN_SQL = lambda where, keys: f"""WITH {PREDICTIONS}, g AS (SELECT {keys}, count(*) AS n, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae,
  median(abs(y_pred - y_true)) AS medae, CASE WHEN min(y_true) = max(y_true) OR min(y_pred) = max(y_pred) THEN 'NaN'::DOUBLE ELSE corr(y_true, y_pred) END AS pearson FROM pred WHERE {where} GROUP BY ALL)
SELECT {keys}, n, {", ".join(f"CASE WHEN n < 2 THEN 'NaN'::DOUBLE ELSE round({c}, 6) + 0.0 END AS {c}" for c in _DOMAIN_METRICS)} FROM g"""  # noqa: E731


@query(_DOMAIN_SQL("\"set\" = 'ips'", "dataset, splitter, rep, in_domain"))
def metrics_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the external set inside and outside the domain."""
    keys = ("dataset", "splitter", "rep", "in_domain")
    p = predictions(spark, sf_dir).filter("`set` = 'ips' AND in_domain IS NOT NULL")
    return rounded(metrics.fold_metrics(p, keys).select(*keys, "n", *_DOMAIN_METRICS))


@query(_DOMAIN_SQL("\"set\" = 'test' AND in_domain", "dataset, splitter, rep"))
def metrics_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the internal set's rows inside the domain."""
    keys = ("dataset", "splitter", "rep")
    p = predictions(spark, sf_dir).filter("`set` = 'test' AND coalesce(in_domain, false)")
    return rounded(metrics.fold_metrics(p, keys).select(*keys, "n", *_DOMAIN_METRICS))
