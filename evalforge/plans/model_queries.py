"""Queries of clusters, designs and learners on the embeddings, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalforge.operators import clustering, models, tpe
from evalforge.plans.bindings import FEATURES, features, table
from evalforge.plans.metric_queries import _R, rounded
from evalforge.plans.registry import query
from evalforge.streaming.incremental import windowed_coverage

THRESHOLD = 0.9


@query(f"""WITH {FEATURES}, n AS (SELECT a.vec_id, count(*) AS n FROM feat a JOIN feat b ON a.vec_id <> b.vec_id AND list_distance(a.x, b.x) <= {THRESHOLD} GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n FROM feat LEFT JOIN n USING (vec_id)""")
def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    n = clustering.neighbour_numbers(f, THRESHOLD)
    return f.select("vec_id").join(n, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n"))


_BUTINA = f"""WITH RECURSIVE {FEATURES}, e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.x, b.x) AS d FROM feat a JOIN feat b ON a.vec_id <> b.vec_id),
c AS (SELECT a AS vec_id, count(*) AS n, list(b) AS near FROM e WHERE d <= {THRESHOLD} GROUP BY a),
o AS (SELECT vec_id, coalesce(near, []) AS near, row_number() OVER (ORDER BY coalesce(n, 0) DESC, vec_id) AS i FROM feat LEFT JOIN c USING (vec_id)),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS taken UNION ALL
  SELECT g.i + 1, CASE WHEN len(list_intersect(o.near, g.taken)) = 0 THEN list_append(g.taken, o.vec_id) ELSE g.taken END FROM g JOIN o ON o.i = g.i + 1),
f AS (SELECT taken FROM g ORDER BY i DESC LIMIT 1),
r AS (SELECT vec_id, CASE WHEN list_contains(taken, vec_id) THEN vec_id ELSE list_filter(taken, lambda x: list_contains(near, x))[1] END AS centroid FROM o, f)"""


@query(f"{_BUTINA} SELECT vec_id, centroid FROM r")
def butina_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sphere_clusters(features(spark, sf_dir), THRESHOLD)


#: Wide enough for clusters of several rows.
WIDE = 1.2


@query(f"""WITH RECURSIVE {FEATURES}, c AS (SELECT a.vec_id, coalesce(list(b.vec_id) FILTER (b.vec_id IS NOT NULL), []) AS near
  FROM feat a LEFT JOIN feat b ON a.vec_id <> b.vec_id AND list_distance(a.x, b.x) <= {WIDE} GROUP BY a.vec_id),
g AS (SELECT 0 AS i, list(vec_id) AS free, NULL::BIGINT AS pick, []::BIGINT[] AS taken FROM feat UNION ALL
  SELECT p.i + 1, list_filter(p.free, lambda v: v <> p.pick AND NOT list_contains(c.near, v)), p.pick, list_append(list_intersect(c.near, p.free), p.pick)
  FROM (SELECT g.i, any_value(g.free) AS free, arg_min(c.vec_id, (-len(list_intersect(c.near, g.free)), c.vec_id)) AS pick
    FROM g JOIN c ON list_contains(g.free, c.vec_id) GROUP BY g.i) p JOIN c ON c.vec_id = p.pick)
SELECT unnest(taken) AS vec_id, pick AS centroid, i::BIGINT AS cluster FROM g WHERE i > 0""")
def butina_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sphere clusters with counts that fall as rows are taken, numbered in the order of the rule."""
    return clustering.reordered_clusters(features(spark, sf_dir), WIDE)


@query(f"""{_BUTINA}, z AS (SELECT *, count(*) OVER (PARTITION BY centroid) AS size FROM r),
m AS (SELECT e.a AS vec_id, q.centroid, row_number() OVER (PARTITION BY e.a ORDER BY e.d, e.b) AS k FROM e JOIN z p ON p.vec_id = e.a AND p.size < 10 JOIN z q ON q.vec_id = e.b AND q.size >= 10)
SELECT vec_id, coalesce(m.centroid, z.centroid) AS centroid FROM z LEFT JOIN m USING (vec_id) WHERE coalesce(k, 1) = 1""")
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return clustering.merge_small(clustering.sphere_clusters(f, THRESHOLD), f, 10)


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(features(spark, sf_dir), 10).select("vec_id", "cluster")


@query()
def linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.hac(features(spark, sf_dir), 10, metric="euclidean").select("vec_id", "cluster")


@query()
def medoid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmedoids(features(spark, sf_dir), 5, metric="euclidean").select("vec_id", "cluster")


@query()
def maximin_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.maximin_design(features(spark, sf_dir), 50)


@query("SELECT label::INT AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label)::INT AS place FROM embeddings GROUP BY label")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_sizes(features(spark, sf_dir), "label")


@query(f"""WITH d AS (SELECT source, toxic AS t, (1 - quality) AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t <> 1 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p <> 1) AS fn, count(*) FILTER (t <> 1 AND p <> 1) AS tn FROM d GROUP BY source)
SELECT *, {_R("(tp + tn) / (tp + fp + fn + tn)", "accuracy")},
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 AS mcc FROM c""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rounded(models.binary_quality(d.select("source", F.col("toxic").alias("t"), (1 - F.col("quality")).alias("p")), "t", "p", "source"))


def _regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return f.withColumns({"y": F.col("x")[0], "x": F.slice("x", 2, 63), "fold": (F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(3)) + 1).cast("int")})


@query()
def cross_validated_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.cross_validated_rms(_regression(spark, sf_dir), "fold", "elasticnet"))


@query()
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _regression(spark, sf_dir)
    return rounded(models.fit_predict(r.filter("fold > 1"), r.filter("fold = 1"), "forest").select("vec_id", "y", "y_pred"))


@query()
def tpe_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of an elastic net, four at a time."""
    return tpe.as_table(spark, models.tpe_search(_regression(spark, sf_dir), "fold", "elasticnet", budget=12))


@query()
def champion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners by their rounds; the error of the champion refitted on the folds beyond the first."""
    r = _regression(spark, sf_dir)
    found = models.select_champion(r.filter("fold > 1").withColumn("inner", F.col("fold")), "inner", ("elasticnet", "forest"), budget=6, keep=(1, 1, 1), first=3)
    top = next(x for x in found if x["is_champion"])
    rms = models.refit(top, r.filter("fold > 1"), r.filter("fold = 1")).agg(F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y"), 2)))).first()[0]
    rows = [(x["learner"], x["trials"], x["cv_rms"], x["round_eliminated"], x["is_champion"], rms if x is top else None) for x in found]
    return rounded(spark.createDataFrame(rows, "learner string, trials int, cv_rms double, round_eliminated int, is_champion boolean, held_out_rms double"))


@query()
def support_vector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error of support vector regression beside that of the mean of the rows it was fitted on."""
    r = _regression(spark, sf_dir)
    p = models.fit_predict(r.filter("fold > 1"), r.filter("fold = 1"), "svr", cost=0.5, epsilon=0.2, gamma=0.005)
    mean = r.filter("fold > 1").agg(F.avg("y").alias("m"))
    rms = lambda c: F.sqrt(F.avg(F.pow(c - F.col("y"), 2)))
    return rounded(p.crossJoin(F.broadcast(mean)).agg(F.count("*").alias("n"), rms(F.col("y_pred")).alias("rms"), rms(F.col("m")).alias("rms_of_mean")))  # one mean


@query()
def seeded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of two runs of a forest on held-out rows and on the rows it was fitted on."""
    r = _regression(spark, sf_dir)
    p = models.train_runs(r.filter("fold > 1"), {"test": r.filter("fold = 1"), "train": r.filter("fold > 1")}, "forest", 2, numTrees=10)
    return rounded(p.groupBy("set", "run").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y"), 2))).alias("rms")))


@query(f"""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, count(*) FILTER (value <= 50) AS n_in, {_R("count(*) FILTER (value <= 50) / count(*)", "coverage")} FROM events GROUP BY ALL""")
def windowed_coverage_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("in_domain", F.col("value") <= 50)
    w = windowed_coverage(e, "ts", "1 day", "1 hour", "event_type")
    return rounded(w.select(F.col("window.start").alias("start"), "event_type", "n", "n_in", "coverage"))
