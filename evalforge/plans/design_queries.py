"""Queries of selections over the whole table of embeddings: farthest pairs, farthest-first orders, OptiSim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalforge.operators import selections
from evalforge.operators.selections import Geometry
from evalforge.plans.bindings import FEATURES, features
from evalforge.plans.metric_queries import _R, rounded
from evalforge.plans.registry import query

#: Picks are a tenth of the rows, this many at least; picks are this far apart at least.
LEAST, CUTOFF, CANDIDATES = 20, 1.2, 10

_DISTANCES = f"""{FEATURES}, pair AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.x, b.x), 9) AS d FROM feat a, feat b),
d AS (SELECT a, list(d ORDER BY b) AS r FROM pair GROUP BY a), ids AS (SELECT list(vec_id ORDER BY vec_id) AS v, greatest({LEAST}, count(*) // 10) AS m FROM feat),
far AS (SELECT a, b, d FROM pair WHERE a < b ORDER BY d DESC, a, b LIMIT 1)"""

#: From g (i, taken, near), always the row farthest from all that are taken, the least of equals.
_FARTHEST = """SELECT s.i + 1, list_append(s.taken, s.k), list_transform(s.near, lambda x, j: least(x, d.r[j]))
  FROM (SELECT g.*, ids.m, list_max(g.near) AS most, ids.v[list_position(g.near, list_max(g.near))] AS k FROM g, ids) s JOIN d ON d.a = s.k WHERE s.i < s.m"""
_PLACES = "SELECT unnest(taken) AS vec_id, generate_subscripts(taken, 1)::BIGINT AS place FROM (SELECT taken FROM g ORDER BY i DESC LIMIT 1)"


def _lot(t: str) -> str:
    return f"substr(md5('42|' || vec_id || '|' || {t}), 1, 8)"


def _wanted(f: DataFrame) -> int:
    return max(LEAST, f.count() // 10)


@query(f"WITH {_DISTANCES} SELECT a, b, {_R('d', 'd')} FROM far")
def farthest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = selections.farthest_pair(features(spark, sf_dir), Geometry("euclidean"))
    return rounded(spark.createDataFrame([pair] if pair else [], "a long, b long, d double"))


@query(f"""WITH RECURSIVE {_DISTANCES}, g AS (SELECT 2 AS i, [far.a, far.b] AS taken, list_transform(p.r, lambda x, j: least(x, q.r[j])) AS near
  FROM far JOIN d p ON p.a = far.a JOIN d q ON q.a = far.b UNION ALL {_FARTHEST}) {_PLACES}""")
def kennard_stone_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return selections.kennard_stone(f, _wanted(f), Geometry("euclidean"))


@query(f"""WITH RECURSIVE {_DISTANCES}, g AS (SELECT 1 AS i, [vec_id] AS taken, d.r AS near FROM (SELECT vec_id FROM feat ORDER BY {_lot("0")}, vec_id LIMIT 1) JOIN d ON d.a = vec_id
  UNION ALL {_FARTHEST} AND s.most >= {CUTOFF}) {_PLACES}""")
def maximum_dissimilarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return selections.optisim(f, _wanted(f), Geometry("euclidean"), 0, CUTOFF)


@query(f"""WITH RECURSIVE {_DISTANCES}, n AS (SELECT a, list(b) AS near FROM pair WHERE d < {CUTOFF} AND a <> b GROUP BY a),
o AS (SELECT vec_id, coalesce(near, []) AS near, row_number() OVER (ORDER BY {_lot("0")}, vec_id) AS i FROM feat LEFT JOIN n ON n.a = vec_id),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS taken UNION ALL
  SELECT g.i + 1, CASE WHEN len(list_intersect(o.near, g.taken)) = 0 THEN list_append(g.taken, o.vec_id) ELSE g.taken END FROM g JOIN o ON o.i = g.i + 1) {_PLACES}""")
def minimum_dissimilarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that are taken in a random order, each unless a row before it is near."""
    f = features(spark, sf_dir)
    return selections.optisim(f, f.count(), Geometry("euclidean"), 1, CUTOFF)


@query(f"""WITH RECURSIVE {_DISTANCES}, g AS (SELECT 1 AS i, [vec_id] AS taken, d.r AS near FROM (SELECT vec_id FROM feat ORDER BY {_lot("0")}, vec_id LIMIT 1) JOIN d ON d.a = vec_id
  UNION ALL SELECT s.i + 1, list_append(s.taken, s.k), list_transform(s.near, lambda x, j: least(x, d.r[j])) FROM (
    SELECT c.*, list_sort(list_transform(list_sort(c.lots)[1:{CANDIDATES}], lambda z, j: {{'n': -z.n, 'j': j, 'k': z.vec_id}}))[1].k AS k FROM (
      SELECT g.i, any_value(g.taken) AS taken, any_value(g.near) AS near, any_value(ids.m) AS m, list({{'h': {_lot("g.i")}, 'vec_id': p.vec_id, 'n': g.near[p.j]}}) AS lots
      FROM g, ids, (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS j FROM feat) p WHERE g.near[p.j] >= {CUTOFF} GROUP BY g.i) c) s
    JOIN d ON d.a = s.k WHERE s.i < s.m) {_PLACES}""")
def optisim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return selections.optisim(f, _wanted(f), Geometry("euclidean"), CANDIDATES, CUTOFF)
