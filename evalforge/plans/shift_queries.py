"""Queries of splits, distances, distribution shift and applicability domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.functions import columns
from evalforge.operators import distances, splits
from evalforge.plans.bindings import FEATURES, features, table
from evalforge.plans.metric_queries import _R, rounded
from evalforge.plans.registry import query
from evalforge.sources.scratch import materialise


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rank, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, rank, CASE WHEN rank <= floor(0.8 * n + 1e-9) THEN 'train' ELSE 'test' END AS part FROM r""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.8).select("o_orderkey", F.col("rank").cast("long"), "part")


@query("""WITH r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) AS rank, count(*) OVER () AS n FROM orders),
c AS (SELECT o_orderdate AS cutoff FROM r WHERE rank = floor(0.6 * n + 1e-9))
SELECT o_orderkey, CASE WHEN o_orderdate < cutoff THEN 'train' ELSE 'test' END AS part FROM orders, c""")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_split(table(spark, sf_dir, "orders"), "o_orderdate", 0.6).select("o_orderkey", "part")


@query("""WITH r AS (SELECT rep, p_partkey, row_number() OVER (PARTITION BY rep ORDER BY md5('42|' || rep || '|' || p_partkey), p_partkey) AS rank, count(*) OVER (PARTITION BY rep) AS n
  FROM part, range(1, 4) AS x(rep)), b AS (SELECT *, n // 7 AS base, n % 7 AS more FROM r)
SELECT rep::INT AS rep, p_partkey, (CASE WHEN rank <= more * (base + 1) THEN ceil(rank / (base + 1)) ELSE more + ceil((rank - more * (base + 1)) / base) END)::INT AS fold FROM b""")
def repeated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.repeated_folds(table(spark, sf_dir, "part"), "p_partkey", 7, 3)


@query("""WITH s AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1),
b AS (SELECT p_brand, coalesce(sum(c) OVER (ORDER BY md5('42|' || p_brand), p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(c) OVER () AS before FROM s)
SELECT p_partkey, p_brand, CASE WHEN before < 0.7 THEN 'train' ELSE 'test' END AS part FROM part JOIN b USING (p_brand)""")
def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.cluster_split(table(spark, sf_dir, "part"), "p_brand", 0.7).select("p_partkey", "p_brand", "part")


@query("""WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5('42|' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM part)
SELECT p_partkey, p_type, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS part FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(table(spark, sf_dir, "part"), "p_partkey", "p_type", 0.8).select("p_partkey", "p_type", "part")


@query("SELECT c_custkey FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 500")
def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.subsample(table(spark, sf_dir, "customer"), "c_custkey", 500).select("c_custkey")


_PAIRS = f"""WITH {FEATURES}, p AS (SELECT a.vec_id, a.x AS a, b.x AS b FROM feat a JOIN feat b ON b.vec_id = a.vec_id + 1),
z AS (SELECT vec_id, unnest(list_zip(a, b)) AS z FROM p), e AS (SELECT vec_id, z[1] AS a, z[2] AS b FROM z)"""


@query(f"""{_PAIRS} SELECT vec_id, {_R("sqrt(sum((a - b) ** 2))", "euclidean")}, {_R("sum((a - b) ** 2)", "sqeuclidean")}, {_R("sum(abs(a - b))", "cityblock")}, {_R("max(abs(a - b))", "chebyshev")},
  {_R("1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))", "cosine")} FROM e GROUP BY vec_id""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    p = f.select("vec_id", F.col("x").alias("a")).join(f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("b")), "vec_id")
    return rounded(p.select("vec_id", *[columns.distance(m, F.col("a"), F.col("b")).alias(m) for m in ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine")]))


@query(f"""WITH {FEATURES}, q AS (SELECT vec_id AS query, x FROM feat WHERE vec_id % 100 = 0), t AS (SELECT vec_id, x FROM feat WHERE vec_id % 100 <> 0)
SELECT query, {_R("min(list_distance(q.x, t.x))", "d")} FROM q, t GROUP BY query""")
def nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(distances.nn_distance(f.filter("vec_id % 100 = 0"), f.filter("vec_id % 100 <> 0")))


@query(f"""WITH {FEATURES}, q AS (SELECT vec_id AS query, x FROM feat WHERE vec_id % 100 = 0),
d AS (SELECT query, vec_id, 1 - list_cosine_similarity(q.x, t.x) AS d FROM q, feat t WHERE vec_id <> query),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS r FROM d) SELECT query, vec_id, {_R("d")} FROM k WHERE r <= 5""")
def k_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(distances.k_nearest(f.filter("vec_id % 100 = 0"), f, 5, "cosine"))


@query(f"""WITH {FEATURES}, q AS (SELECT vec_id AS query, x FROM feat WHERE vec_id % 100 = 0),
d AS (SELECT query, label, list_distance(q.x, t.x) AS d, row_number() OVER (PARTITION BY query ORDER BY list_distance(q.x, t.x), vec_id) AS r FROM q, feat t WHERE vec_id <> query)
SELECT query AS vec_id, {_R("coalesce(avg(label) FILTER (d <= 1e-12), sum(label / d) FILTER (d > 1e-12) / sum(1 / d) FILTER (d > 1e-12))", "prediction")} FROM d WHERE r <= 7 GROUP BY query""")
def knn_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(distances.knn_regression(f, f.filter("vec_id % 100 = 0"), "label", 7))


_SIDES = f"""WITH {FEATURES}, e AS (SELECT vec_id, label < 5 AS a, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS v FROM feat)"""


@query(f"""{_SIDES} SELECT a, pos::INT AS pos, count(*) AS n, {_R("avg(v)", "mean")}, {_R("var_samp(v)", "variance")}, {_R("min(v)", "low")}, {_R("max(v)", "high")} FROM e GROUP BY a, pos""")
def feature_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.moments(features(spark, sf_dir).withColumn("a", F.col("label") < 5), "x", "a"))


@query(f"""{_SIDES}, m AS (SELECT pos, avg(v) FILTER (a) - avg(v) FILTER (NOT a) AS d FROM e GROUP BY pos) SELECT {_R("sum(d * d)", "mmd")} FROM m""")
def mmd_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.mmd_linear(features(spark, sf_dir).withColumn("a", F.col("label") < 5), "a"))


@query(f"""{_SIDES} SELECT {_R("abs(avg((v > 0)::INT) FILTER (a) - avg((v > 0)::INT) FILTER (NOT a))", "sparsity_gap")} FROM e""")
def sparsity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = features(spark, sf_dir).select((F.col("label") < 5).alias("a"), F.explode("x").alias("v"))
    on = (F.col("v") > 0).cast("double")
    return rounded(e.agg(F.abs(F.avg(F.when(F.col("a"), on)) - F.avg(F.when(~F.col("a"), on))).alias("sparsity_gap")))


_BITS = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w, lang FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT doc_id, lang, ('0x' || substr(md5(unnest(w)), 1, 3))::INT AS bit FROM t)"""


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed word fingerprints of documents: one row a set bit of 4096."""
    w = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("w"))
    return w.select("doc_id", "lang", F.conv(F.substring(F.md5("w"), 1, 3), 16, 10).cast("int").alias("bit")).distinct()


@query(f"""{_BITS}, n AS (SELECT count(DISTINCT doc_id) FILTER (lang = 'en') AS ne, count(DISTINCT doc_id) FILTER (lang <> 'en') AS no FROM b),
f AS (SELECT bit, count(*) FILTER (lang = 'en') / max(ne)::DOUBLE AS p, count(*) FILTER (lang <> 'en') / max(no)::DOUBLE AS q FROM b, n GROUP BY bit)
SELECT {_R("sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END)", "js")} FROM f""")
def bit_frequency_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = materialise(bits(spark, sf_dir))
    sizes = b.select("doc_id", "lang").distinct().agg(F.count_if(F.col("lang") == "en").alias("ne"), F.count_if(F.col("lang") != "en").alias("no"))
    f = b.groupBy("bit").agg(F.count_if(F.col("lang") == "en").alias("ce"), F.count_if(F.col("lang") != "en").alias("co")).crossJoin(F.broadcast(sizes))
    p, q = F.col("ce") / F.col("ne"), F.col("co") / F.col("no")
    term = lambda x: F.when(x > 0, 0.5 * x * F.ln(x / ((p + q) / 2))).otherwise(0.0)
    return rounded(f.agg(F.sum(term(p) + term(q)).alias("js")))


@query(f"""{_BITS} SELECT {_R("count(DISTINCT bit) FILTER (lang <> 'en' AND bit IN (SELECT bit FROM b WHERE lang = 'en')) / count(DISTINCT bit) FILTER (lang <> 'en')", "coverage")} FROM b""")
def bit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = bits(spark, sf_dir).groupBy("bit").agg(F.max(F.col("lang") == "en").alias("train"), F.max(F.col("lang") != "en").alias("test"))
    return rounded(per.agg((F.count_if(F.col("train") & F.col("test")) / F.count_if("test")).alias("coverage")))


@query(f"""{_BITS}, s AS (SELECT doc_id, list(DISTINCT bit) AS s FROM b GROUP BY doc_id)
SELECT x.doc_id, {_R("len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))", "tanimoto")} FROM s x JOIN s y ON y.doc_id = x.doc_id + 1""")
def neighbour_tanimoto(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bits(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("bit").alias("a"))
    p = s.join(s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return rounded(p.select("doc_id", columns.tanimoto(F.col("a"), F.col("b")).alias("tanimoto")))


@query(f"""WITH {FEATURES}, e AS (SELECT vec_id, label < 5 AS a, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM feat),
b AS (SELECT pos, min(v) AS low, max(v) AS high FROM e WHERE a GROUP BY pos)
SELECT vec_id, {_R("avg((v < low OR v > high)::INT)", "score")}, avg((v < low OR v > high)::INT) = 0 AS in_domain FROM e JOIN b USING (pos) WHERE NOT a GROUP BY vec_id""")
def bounding_box_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(distances.bounding_box_scores(f.filter("label < 5"), f.filter("label >= 5")))


@query(f"""WITH {FEATURES}, t AS (SELECT vec_id, x FROM feat WHERE label < 5), q AS (SELECT vec_id, x FROM feat WHERE vec_id % 100 = 0),
o AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.x, b.x) AS d FROM t a, t b WHERE a.vec_id <> b.vec_id),
ok AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM o), os AS (SELECT vec_id, avg(d) AS d FROM ok WHERE r <= 3 GROUP BY vec_id),
l AS (SELECT avg(d) + 1.5 * stddev_samp(d) AS lim FROM os), s AS (SELECT q.vec_id, 1 - list_cosine_similarity(q.x, t.x) AS d FROM q, t WHERE q.vec_id <> t.vec_id),
sk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM s)
SELECT vec_id, {_R("avg(d)", "score")}, avg(d) <= max(lim) AS in_domain FROM sk, l WHERE r <= 3 GROUP BY vec_id""")
def knn_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    train, asked = f.filter("label < 5"), f.filter("vec_id % 100 = 0")
    return rounded(distances.knn_domain(train, asked, k=3))


@query()
def leverage_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(distances.leverage_domain(f.filter("label < 5"), f.filter("label >= 5")))


@query()
def mahalanobis_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    d = distances.mahalanobis_split_distance(f.filter("label < 5"), f.filter("label >= 5"))
    return f.agg(F.count(F.lit(1)).alias("n"), F.lit(round(d, 6)).alias("distance"))


@query(f"""WITH {FEATURES}, d AS (SELECT q.vec_id, min(list_distance(q.x, t.x)) AS d FROM feat q, feat t WHERE q.vec_id % 100 = 0 AND t.vec_id <> q.vec_id GROUP BY q.vec_id)
SELECT {_R("max(d)", "hausdorff")} FROM d""")
def directed_hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(distances.directed_hausdorff(f.filter("vec_id % 100 = 0"), f))


@query(f"""{_SIDES}, m AS (SELECT *, avg(v) OVER (PARTITION BY a, pos) AS m FROM e),
p AS (SELECT x.pos AS i, y.pos AS j, sum((x.v - x.m) * (y.v - y.m)) AS s FROM m x JOIN m y ON x.vec_id = y.vec_id GROUP BY ALL),
n AS (SELECT sum(c - 1) AS w FROM (SELECT count(*) AS c FROM feat GROUP BY label < 5))
SELECT i::INT AS i, j::INT AS j, {_R("s / w", "v")} FROM p, n""")
def pooled_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(distances.covariance_table(distances.pooled_covariance(f.filter("label < 5"), f.filter("label >= 5"), "x"), spark))


@query(f"""{_SIDES} SELECT 64::INT AS n_features, count(DISTINCT vec_id) FILTER (a) AS n_train, {_R("avg(v) FILTER (a)", "mean_train")}, {_R("avg((v > 0)::INT) FILTER (a)", "share_train")},
  count(DISTINCT vec_id) FILTER (NOT a) AS n_test, {_R("avg(v) FILTER (NOT a)", "mean_test")}, {_R("avg((v > 0)::INT) FILTER (NOT a)", "share_test")},
  {_R("abs(avg((v > 0)::INT) FILTER (a) - avg((v > 0)::INT) FILTER (NOT a))", "sparsity_gap")} FROM e""")
def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.split_metrics(features(spark, sf_dir).withColumn("a", F.col("label") < 5), "a"))


@query(f"""{_BITS}, n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id),
s AS (SELECT q.doc_id AS query, x.doc_id, count(*) AS c2 FROM b q JOIN b x ON q.bit = x.bit AND q.doc_id <> x.doc_id WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query, {_R("max(c2 / (a.n + c.n - c2))", "similarity")} FROM s JOIN n a ON a.doc_id = query JOIN n c ON c.doc_id = s.doc_id GROUP BY query""")
def nn_tanimoto(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bits(spark, sf_dir).select("doc_id", "bit")
    return rounded(distances.nn_tanimoto(b.filter("doc_id % 100 = 0"), b, "doc_id"))


@query(f"""WITH m AS (SELECT p_brand, avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part GROUP BY p_brand),
a AS (SELECT p_partkey, p_brand, abs(p_retailprice - m) / s AS score FROM part JOIN m USING (p_brand))
SELECT p_brand, l_returnflag, count(*) AS n, count(*) FILTER (coalesce(score <= 1.5, false)) AS n_in, {_R("avg(score)", "score")}
FROM lineitem LEFT JOIN a ON p_partkey = l_partkey GROUP BY ALL""")
def annotated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain scores of parts, joined to the many predictions of each."""
    part = table(spark, sf_dir, "part")
    m = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    a = part.join(m, "p_brand").select("p_partkey", "p_brand", (F.abs(F.col("p_retailprice") - F.col("m")) / F.col("s")).alias("score"))
    p = table(spark, sf_dir, "lineitem").join(a, F.col("l_partkey") == F.col("p_partkey"), "left")
    inside = F.count_if(F.coalesce(F.col("score") <= 1.5, F.lit(False)))
    return rounded(p.groupBy("p_brand", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), inside.alias("n_in"), F.avg("score").alias("score")))


@query(f"""WITH {FEATURES}, a AS (SELECT vec_id, x FROM feat WHERE vec_id % 100 = 0), b AS (SELECT vec_id, x FROM feat WHERE vec_id % 100 = 50),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.x, b.x) AS d FROM a, b), u AS (SELECT min(d) AS d FROM d GROUP BY i UNION ALL SELECT min(d) FROM d GROUP BY j)
SELECT {_R("max(d)", "hausdorff")} FROM u""")
def hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions between two stated sets of queries."""
    f = features(spark, sf_dir)
    return rounded(distances.hausdorff(f.filter("vec_id % 100 = 0"), f.filter("vec_id % 100 = 50")))


_SIMILAR = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w, lang FROM documents WHERE text IS NOT NULL AND doc_id % 100 IN (0, 50)),
b AS (SELECT DISTINCT doc_id, lang, ('0x' || substr(md5(unnest(w)), 1, 3))::INT AS bit FROM t), n AS (SELECT doc_id, lang, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS c FROM b x JOIN b y ON x.bit = y.bit AND x.doc_id <> y.doc_id GROUP BY ALL),
m AS (SELECT i, j, c / (p.n + q.n - c) AS s, p.doc_id % 100 = 0 AS ti, q.doc_id % 100 = 0 AS tj FROM s JOIN n p ON p.doc_id = i JOIN n q ON q.doc_id = j),
k AS (SELECT doc_id, doc_id % 100 = 0 AS train, coalesce(max(s), 0) AS similarity FROM n LEFT JOIN m ON i = doc_id AND tj GROUP BY ALL)"""


def asked_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of two stated sets: training sets (ids divisible by 100) and queries (50 beyond)."""
    return materialise(bits(spark, sf_dir).filter("doc_id % 100 IN (0, 50)").withColumn("train", F.col("doc_id") % 100 == 0))


@query(f"""{_SIMILAR}, l AS (SELECT greatest(0, least(1, avg(similarity) - 1.5 * stddev_samp(similarity))) AS lim FROM k WHERE train)
SELECT doc_id, {_R("similarity", "score")}, similarity >= lim AS in_domain FROM k, l WHERE NOT train""")
def tanimoto_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = asked_bits(spark, sf_dir)
    return rounded(distances.tanimoto_domain(b.filter("train").select("doc_id", "bit"), b.filter("NOT train").select("doc_id", "bit"), "doc_id"))


@query(f"""{_SIMILAR}, z AS (SELECT count(*) FILTER (doc_id % 100 = 0) AS n_train, count(*) FILTER (doc_id % 100 = 50) AS n_test FROM n),
f AS (SELECT bit, count(*) FILTER (doc_id % 100 = 0) AS a, count(*) FILTER (doc_id % 100 = 50) AS c FROM b GROUP BY bit),
g AS (SELECT a, c, a / n_train::DOUBLE AS p, c / n_test::DOUBLE AS q FROM f, z),
j AS (SELECT sum(CASE WHEN p > 0 THEN 0.5 * p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * ln(q / ((p + q) / 2)) ELSE 0 END) AS js, count(*) FILTER (a > 0 AND c > 0) / count(*) FILTER (c > 0) AS coverage FROM g),
v AS (SELECT avg(similarity) AS nn_mean, stddev_samp(similarity) AS nn_std FROM k WHERE NOT train)
SELECT n_train, n_test, {_R("js")}, {_R("coverage")}, {_R("nn_mean")}, {_R("nn_std")} FROM z, j, v""")
def bit_split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.bit_split_metrics(asked_bits(spark, sf_dir), "train", "doc_id"))
