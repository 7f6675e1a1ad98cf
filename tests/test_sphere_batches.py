"""Sphere clusters of vectors without lists of pairs: counts in blocks, batches of leading rows."""

from __future__ import annotations

import numpy as np
import pytest

from evalforge.operators import clustering, spheres, stored
from evalforge.operators.distances import block_distances

from .test_core import vectors
from .test_sphere_clusters import rule


def graph(metric: str, seed: int, threshold: float) -> tuple[np.ndarray, dict]:
    r = np.random.default_rng(seed)
    x = np.concatenate([r.integers(0, 5, (90, 3)).astype(float), np.repeat(r.integers(0, 5, (3, 3)), 12, axis=0), [[90.0, 0, 0]]])
    d = block_distances(metric, x, x)
    return x, {i: {j for j in range(len(x)) if j != i and d[i, j] <= threshold + 1e-12} for i in range(len(x))}


def small(monkeypatch) -> None:
    monkeypatch.setattr(stored, "FILE_ROWS", 20)
    monkeypatch.setattr(stored, "LEAST_ROWS", 30)
    monkeypatch.setattr(stored, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(spheres, "FILES_AT_ONCE", 2)


@pytest.mark.parametrize("metric, threshold", [("euclidean", 1.5), ("cityblock", 2.0), ("jaccard", 0.31)])
@pytest.mark.parametrize("listed", [4_000_000, 60])
def test_falling_counts_equal_the_rule_and_write_no_pairs(spark, monkeypatch, metric, threshold, listed):
    small(monkeypatch)
    monkeypatch.setattr(spheres, "LISTED", listed)
    monkeypatch.setattr(clustering, "neighbours", None)
    x, near = graph(metric, 5, threshold)
    got = clustering.reordered_clusters(vectors(spark, x.tolist()).repartition(3), threshold, metric=metric)
    assert {r["vec_id"]: (r["centroid"], r["cluster"]) for r in got.collect()} == rule(list(near), near)


def test_names_may_be_strings_and_batches_few(spark, monkeypatch):
    small(monkeypatch)
    x, near = graph("euclidean", 6, 1.5)
    names = [f"k{(i * 37) % 211:03d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, v) for n, v in zip(names, x.tolist(), strict=True)], "vec_id string, x array<double>")
    want = rule(names, {names[i]: {names[j] for j in o} for i, o in near.items()})
    passes, own = [], spheres._State.take
    monkeypatch.setattr(spheres._State, "take", lambda self, *a: passes.append(1) or own(self, *a))
    assert {r["vec_id"]: (r["centroid"], r["cluster"]) for r in clustering.reordered_clusters(df, 1.5).collect()} == want
    assert len(passes) == 1


def test_odd_tables(spark):
    df = vectors(spark, [(1, 1), (1, 1), (5, 5)])
    twice = df.union(df.filter("vec_id = 2"))
    for f in (df, twice):
        got = clustering.reordered_clusters(f, 0.5).distinct().collect()
        assert sorted(map(tuple, got)) == [(0, 0, 1), (1, 0, 1), (2, 2, 2)]
    assert clustering.reordered_clusters(df.limit(0), 0.5).count() == 0
    odd = vectors(spark, [(float("nan"), 1), (float("nan"), 1), (float("inf"), 1), (1e300, 1), (0, 0), (0, 1e-9)])
    assert {r["vec_id"]: r["centroid"] for r in clustering.reordered_clusters(odd, 0.5).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    with pytest.raises(ValueError, match="negative"):
        clustering.reordered_clusters(df, -1.0)


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-12, 0.0), (1e14, 0.0), (1.0, 1e5)])
def test_products_decide_only_what_is_sure(scale, shift):
    """Distances at the threshold, next to it, and of rows far from the origin."""
    r = np.random.default_rng(1)
    x = r.integers(-3, 4, (60, 8)) * scale + shift
    y = np.concatenate([x[:30], x[:30] + np.eye(8)[0] * scale, x[:30] * (1 + 1e-14)])
    threshold = float(stored.row_distances("euclidean", x[:1], y[30:31])[0])
    got = {(int(a), int(b)) for at, to in stored.near("euclidean", threshold, x, y) for a, b in zip(at, to, strict=True)}
    want = {(i, j) for i in range(60) for j in range(90) if stored.row_distances("euclidean", x[i : i + 1], y[j : j + 1])[0] <= threshold}
    assert got == want


@pytest.mark.parametrize("metric, threshold", [("euclidean", 1.5), ("jaccard", 0.31)])
def test_overlapping_cells_send_no_rows_to_blocks(spark, monkeypatch, metric, threshold):
    """Where each row would visit many cells, tasks read the rows; where cells lie apart, they are dealt to blocks."""
    small(monkeypatch)
    monkeypatch.setattr(clustering, "ROWS_PER_BLOCK", 10)
    x, near = graph(metric, 7, threshold)
    df = vectors(spark, x.tolist()).repartition(3)
    dealt, own = [], clustering._dealt
    monkeypatch.setattr(clustering, "_dealt", lambda *a: dealt.append(1) or own(*a))
    for sent, times in ((1, 0), (1000, 2)):
        monkeypatch.setattr(clustering, "SENT", sent)
        assert {r["vec_id"]: r["n"] for r in clustering.neighbour_numbers(df, threshold, metric=metric).collect()} == {i: len(o) for i, o in near.items() if o}
        assert sorted(map(tuple, clustering.neighbours(df, threshold, metric=metric).collect())) == sorted((i, j) for i in near for j in near[i])
        assert len(dealt) == times


@pytest.mark.parametrize("metric, threshold, leaders", [("euclidean", 1.5, 8192), ("euclidean", 1.0, 9), ("cityblock", 1.0, 9), ("jaccard", 0.31, 30)])
def test_fixed_counts_equal_the_rule_and_write_no_pairs(spark, monkeypatch, metric, threshold, leaders):
    small(monkeypatch)
    monkeypatch.setattr(spheres, "LEADERS", leaders)
    monkeypatch.setattr(spheres, "TILE", 4)
    monkeypatch.setattr(clustering, "neighbours", None)
    x, near = graph(metric, 8, threshold)
    want: dict = {}
    for c in sorted(near, key=lambda i: (-len(near[i]), i)):
        if c not in want:
            want |= {i: c for i in (c, *near[c]) if i not in want}
    got = clustering.sphere_clusters(vectors(spark, x.tolist()).repartition(3), threshold, metric=metric)
    assert {r["vec_id"]: r["centroid"] for r in got.collect()} == want


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "jaccard"])
def test_nearest_rows_leave_tasks_one_a_query(spark, monkeypatch, metric):
    """Ties go by key, also across files; a query does not meet itself."""
    small(monkeypatch)
    x, _ = graph(metric, 9, 1.0)
    df = vectors(spark, x.tolist())
    held, asked = stored.store(df, "vec_id", "x"), df.selectExpr("vec_id AS k", "x").repartition(3)
    d = np.array([[stored.row_distances(metric, x[i : i + 1], x[j : j + 1])[0] if i != j else np.inf for j in range(len(x))] for i in range(len(x))])
    found = stored.nearest(asked, held, metric).collect()
    assert len(found) == len(x) and {r["k"]: r["to"] for r in found} == dict(enumerate(d.argmin(1).tolist()))
    assert stored.nearest(asked, stored.store(df.limit(0), "vec_id", "x"), metric).count() == 0


def test_merged_rows_send_no_query_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    x = np.concatenate([np.zeros((12, 2)), np.full((11, 2), 9.0), [[1.0, 0], [4.5, 4.5], [8.0, 9]]])
    df = vectors(spark, x.tolist())
    near = spark.createDataFrame([(i, 0 if i < 12 else 12 if i < 23 else i) for i in range(26)], "vec_id long, centroid long")
    got = {r["vec_id"]: r["centroid"] for r in clustering.merge_small(near, df, 10).collect()}
    assert got == {i: 0 if i < 12 or i in (23, 24) else 12 for i in range(26)}
