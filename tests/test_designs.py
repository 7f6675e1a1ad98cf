"""Splits by design and by clusters."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from evalforge.operators import clustering, designs, selections
from evalforge.operators.distances import block_distances
from evalforge.operators.selections import Geometry

from .test_core import vectors


def table(spark, n=90, seed=1):
    x = np.random.default_rng(seed).integers(0, 5, (n, 6)).astype(float)
    return vectors(spark, x.tolist()).selectExpr("vec_id", "x", "x[0] + x[1] AS y"), x


@pytest.mark.parametrize("name", sorted(designs.REGISTRY))
def test_parts_are_disjoint_and_exhaustive(spark, name):
    df, x = table(spark)
    out = designs.make_splitter(name)(df, 0.8, target="y").collect()
    assert sorted(r["vec_id"] for r in out) == list(range(90))
    train = sum(r["part"] == "train" for r in out)
    assert {r["part"] for r in out} <= {"train", "test"} and 0 < train <= 90
    if name in ("random", "kennardstone", "mdks", "morais", "spxy-jaccard", "spxy-euclidean"):
        assert train == 72


def test_unknown_names(spark):
    df, _ = table(spark)
    with pytest.raises(ValueError, match="kennardstone"):
        designs.make_splitter("none")
    with pytest.raises(ValueError, match="target"):
        designs.design_split(df, "spxy-jaccard", 0.5)
    with pytest.raises(ValueError, match="frac"):
        designs.design_split(df, "mdks", 1.0)
    with pytest.raises(ValueError, match="algorithm"):
        designs.clustered(df, "none")
    with pytest.raises(ValueError, match="mode"):
        designs.cluster_splitter(df, "none", 0.5)


def plain_kennard_stone(d: np.ndarray, m: int) -> list[int]:
    n = len(d)
    pairs = [(-d[i, j], i, j) for i in range(n) for j in range(i + 1, n)]
    chosen = list(min(pairs)[1:])[:m]
    while len(chosen) < min(m, n):
        chosen.append(min((-d[i, chosen].min(), i) for i in range(n) if i not in chosen)[1])
    return chosen


def lot(i: int, t: int) -> int:
    return int(hashlib.md5(f"42|{i}|{t}".encode()).hexdigest()[:8], 16)


def plain_optisim(d: np.ndarray, m: int, candidates: int, cutoff: float) -> list[int]:
    chosen = [min(range(len(d)), key=lambda i: (lot(i, 0), i))]
    while len(chosen) < m:
        left = [i for i in range(len(d)) if i not in chosen and d[i, chosen].min() >= cutoff]
        if not left:
            break
        t = 0 if candidates == 1 else len(chosen)
        drawn = sorted(left) if candidates == 0 else sorted(left, key=lambda i: (lot(i, t), i))[:candidates]
        chosen.append(max(drawn, key=lambda i: d[i, chosen].min()))
    return chosen


def order(df) -> list[int]:
    rows = df.orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    return [r["vec_id"] for r in rows]


def test_kennard_stone_by_hand(spark):
    df = vectors(spark, [(0.0,), (1.0,), (10.0,), (5.2,), (4.9,)])
    g = Geometry("euclidean")
    assert selections.farthest_pair(df, g) == (0, 2, 10.0)
    assert order(selections.kennard_stone(df, 3, g)) == [0, 2, 4] and order(selections.kennard_stone(df, 9, g))[:3] == [0, 2, 4]
    assert order(selections.kennard_stone(df.filter("vec_id = 3"), 3, g)) == [3] and order(selections.kennard_stone(df, 1, g)) == [0]
    same = vectors(spark, [(1.0, 1.0)] * 4)
    assert order(selections.kennard_stone(same, 4, g)) == [0, 1, 2, 3]
    assert order(selections.kennard_stone(df.limit(0), 4, g)) == [] and order(selections.kennard_stone(df, 0, g)) == []


def test_optisim_by_hand(spark):
    df = vectors(spark, [(0.0,), (0.1,), (3.0,), (6.0,), (6.2,)])
    x = np.array([0.0, 0.1, 3.0, 6.0, 6.2])
    d = np.abs(x[:, None] - x[None, :])
    for candidates in (0, 1, 2):
        assert order(selections.optisim(df, 5, Geometry("euclidean"), candidates, 0.5)) == plain_optisim(d, 5, candidates, 0.5)
    assert order(selections.optisim(df, 0, Geometry("euclidean"), 2, 0.5)) == []


@pytest.mark.parametrize("metric", ["euclidean", "jaccard"])
@pytest.mark.parametrize("batch_rows", [None, 25])
def test_selections_equal_the_plain_rules(spark, metric, batch_rows, monkeypatch):
    """Also with batches and blocks of a few rows, repeated rows and ties."""
    if batch_rows:
        monkeypatch.setattr(selections, "PAIR_BLOCK", 20)
    df, x = table(spark, 220, 4)
    d = np.round(block_distances(metric, x, x), selections.PLACES)
    g = Geometry(metric)
    assert selections.farthest_pair(df, g)[:2] == tuple(plain_kennard_stone(d, 2))
    assert order(selections.kennard_stone(df.repartition(5), 120, g, batch_rows=batch_rows)) == plain_kennard_stone(d, 120)
    cutoff = float(np.quantile(d[d > 0], 0.05))
    for candidates in (0, 1, 8):
        got = selections.optisim(df.repartition(3), 60, g, candidates, cutoff, steps=128 if batch_rows is None else 7)
        assert order(got) == plain_optisim(d, 60, candidates, cutoff)


def test_designs_of_targets_and_whitened_features(spark):
    df, x = table(spark, 120, 2)
    y = x[:, 0] + x[:, 1]
    for method, metric in (("spxy-jaccard", "jaccard"), ("spxy-euclidean", "euclidean")):
        d = block_distances(metric, x, x)
        d = np.round(np.round(d, 9) / np.round(d, 9).max() + np.abs(y[:, None] - y[None, :]) / (y.max() - y.min()), 9)
        train = {r["vec_id"] for r in designs.design_split(df, method, 0.5, target="y").filter("part = 'train'").collect()}
        assert train == set(plain_kennard_stone(d, 60))
    w = x @ np.linalg.inv(np.linalg.cholesky(np.cov(x.T))).T
    d = np.round(block_distances("euclidean", w, w), 6)
    train = {r["vec_id"] for r in designs.design_split(df, "mdks", 0.25).filter("part = 'train'").collect()}
    assert len(train & set(plain_kennard_stone(d, 30))) >= 27
    ks = {r["vec_id"] for r in designs.picked(df, "morais", 60).collect()}
    assert len(ks) == 60 and len(ks - set(plain_kennard_stone(np.round(block_distances("euclidean", x, x), 9), 60))) == 6


def test_medoids_and_linkage(spark):
    x = [(0, 0), (0, 1), (1, 0), (10, 10), (10, 11), (11, 10), (50, 0), (51, 0)]
    df = vectors(spark, x)
    for f in (clustering.kmedoids, clustering.hac):
        got = {r["vec_id"]: r["cluster"] for r in f(df, 3, metric="euclidean").collect()}
        groups = {}
        for k, c in got.items():
            groups.setdefault(c, set()).add(k)
        assert set(groups) == {1, 2, 3} and sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5], [6, 7]]
    assert clustering.kmedoids(df.limit(0), 3).count() == 0
    members = clustering.cluster_members(clustering.hac(df, 3, metric="euclidean"), "cluster", "vec_id")
    assert [tuple(r) for r in members.filter("cluster = 1").orderBy("place").collect()] == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_a_design_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(clustering, "DESIGN_ROWS", 30)
    df, _ = table(spark, 300, 3)
    a, b = (sorted(map(tuple, clustering.maximin_design(d, 5).collect())) for d in (df.repartition(2), df.repartition(7)))
    assert a == b and len(a) == 5


def test_leading_rows_by_distance_and_key(spark):
    """Each task offers its leading rows without their vectors; the rows that lead are those of the plain order."""
    from pyspark.sql import functions as F

    data = [(i, [float(i), 1.0], 0.0, float("inf") if i > 95 else float(i % 5)) for i in range(100)]
    state = spark.createDataFrame(data, "k long, x array<double>, y double, near double").repartition(6)
    for n in (1, 3, 30, 200):
        got = selections._leading(state, n)
        assert got["k"].tolist() == [r["k"] for r in state.orderBy(F.desc("near"), "k").limit(n).collect()] and "x" in got
    assert len(selections._leading(state.limit(0), 3)) == 0
