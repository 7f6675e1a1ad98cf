"""Passes of average linkage: names are shuffled, not rows; copies and chains take few passes; bounds leave merges as they are."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalforge.operators import agglomeration
from evalforge.operators.distances import block_distances
from evalforge.sources.scratch import materialise

from .test_agglomeration import members, plain_linkage
from .test_core import vectors


def test_sums_of_clusters_and_one_shuffle_of_names(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("TILE", 3), ("CELLS", 20)):
        monkeypatch.setattr(agglomeration, name, value)
    x = np.random.default_rng(4).normal(size=(40, 3))
    c = np.array([0] * 12 + [i // 3 * 3 for i in range(12, 40)])
    rows = materialise(spark.createDataFrame([(i, v.tolist(), 1 + i % 2, i) for i, v in enumerate(x)], "k long, x array<double>, w long, c0 long").repartition(3))
    own = materialise(spark.createDataFrame([(i, int(c[i]), 1, 1 + i % 2) for i in range(40)], "c0 long, c long, count long, size long"))
    w = 1.0 + np.arange(40) % 2
    d = block_distances("euclidean", x, x) * w[:, None] * w
    want = {(a, b): d[np.ix_(c == a, c == b)].sum() for a in set(c) for b in set(c) if a != b}
    every = agglomeration._cluster_sums(rows, own, own.select("c").distinct(), 40, "euclidean", 0)
    got = {(r["c"], r["o"]): r["s"] for r in every.collect()}
    assert got.keys() == want.keys() and np.allclose([got[p] for p in want], list(want.values()))
    mean = {p: s / (w[c == p[0]].sum() * w[c == p[1]].sum()) for p, s in want.items()}
    near = {r["c"]: (r["o"], r["place"]) for r in agglomeration._nearest_clusters(rows, own, own.select("c").distinct(), 40, "euclidean").collect()}
    assert near == {a: (min((m, o) for (q, o), m in mean.items() if q == a)[1], 1) for a in set(c)}
    plan = agglomeration._cluster_sums(rows, own, own.select("c").filter(F.col("c") > 11), 40, "euclidean", 2, pieced=False)._jdf.queryExecution().executedPlan().toString()
    assert "x#" not in plan


@pytest.mark.parametrize("edges", [100, 300, 900])
def test_merges_by_bounds_equal_the_sequential_rule(spark, monkeypatch, edges):
    monkeypatch.setattr(agglomeration, "EDGES", edges)
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(30, 5)), r.normal(size=(1, 5)) + 0.05 * r.normal(size=(40, 5))])
    _, merges = agglomeration.linkage(vectors(spark, x.tolist()).repartition(3), metric="euclidean", dense=3)
    got = members([tuple(m) for m in merges.collect()], 70)
    want = plain_linkage(block_distances("euclidean", x, x))
    assert [s for _, s in got] == [s for _, s in want]
    assert np.allclose([h for h, _ in got], [h for h, _ in want])


def test_copies_take_no_pass_each(spark, monkeypatch):
    written = []
    monkeypatch.setattr(agglomeration, "materialise", lambda df: written.append(0) or materialise(df))
    df = vectors(spark, [(float(i % 3), float(i % 3) ** 2) for i in range(60)])
    names, merges = agglomeration.linkage(df, metric="euclidean", dense=1)
    assert merges.count() == 59 and len(written) < 30
    c = {r["k"]: r["cluster"] for r in agglomeration.cut(names, merges, 3).collect()}
    assert c == {i: i % 3 + 1 for i in range(60)}
