"""Average linkage and k-medoids of all rows against the sequential rules on whole matrices of distances."""

from __future__ import annotations

import numpy as np
import pytest

from evalforge.operators import agglomeration, clustering
from evalforge.operators.distances import block_distances

from .test_core import vectors


def plain_linkage(d: np.ndarray) -> list[float]:
    """Heights and members of merges, nearest clusters first."""
    clusters, out = [[i] for i in range(len(d))], []
    while len(clusters) > 1:
        h, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        out.append((h, frozenset(clusters[i] + clusters[j])))
        clusters = [c for x, c in enumerate(clusters) if x not in (i, j)] + [clusters[i] + clusters[j]]
    return out


def members(merges: list, n: int) -> list[tuple]:
    """The merges' heights with the rows of the cluster that each makes."""
    own, out = {i: frozenset([i]) for i in range(n)}, []
    for a, b, h in sorted(merges, key=lambda m: (m[2], m[0], m[1])):
        own[a] = own[a] | own.pop(b)
        out.append((h, own[a]))
    return out


@pytest.mark.parametrize("metric, dense, block", [("euclidean", 1000, 2000), ("euclidean", 8, 30), ("jaccard", 5, 7)])
def test_merges_equal_the_sequential_rule(spark, monkeypatch, metric, dense, block):
    monkeypatch.setattr(agglomeration, "BLOCK", block)
    x = np.random.default_rng(2).uniform(0.1, 5, (70, 4))
    df = vectors(spark, x.tolist()).repartition(5)
    names, merges = agglomeration.linkage(df, metric=metric, dense=dense)
    got = members([tuple(r) for r in merges.collect()], 70)
    want = plain_linkage(block_distances(metric, x, x))
    assert [s for _, s in got] == [s for _, s in want]
    assert np.allclose([h for h, _ in got], [h for h, _ in want])
    for k in (1, 4, 69, 70):
        c = {r["k"]: r["cluster"] for r in agglomeration.cut(names, merges, k).collect()}
        parts = [{i} for i in range(70)]
        for _, s in want[: 70 - k]:
            parts = [p for p in parts if not p <= s] + [set(s)]
        assert sorted(map(sorted, parts)) == sorted(sorted(i for i in c if c[i] == q) for q in set(c.values())) and set(c.values()) == set(range(1, k + 1))


def test_linkage_of_equal_rows_and_of_none(spark):
    df = vectors(spark, [(1.0, 2.0)] * 6 + [(9.0, 9.0)])
    c = {r["vec_id"]: r["cluster"] for r in clustering.hac(df, 2, metric="euclidean").collect()}
    assert c == {**dict.fromkeys(range(6), 1), 6: 2}
    names, merges = agglomeration.linkage(df, metric="euclidean", dense=1)
    assert merges.count() == 6
    assert clustering.hac(df.limit(0), 2).count() == 0


def plain_pam(d: np.ndarray, k: int) -> float:
    chosen: list[int] = []
    cost = lambda m: d[:, m].min(1).sum()
    for _ in range(k):
        chosen.append(min((round(cost([*chosen, c]), 10), c) for c in range(len(d)) if c not in chosen)[1])
    while True:
        best = min((round(cost([*chosen[:i], *chosen[i + 1 :], c]), 10), c, i) for i in range(k) for c in range(len(d)) if c not in chosen)
        if best[0] >= cost(chosen) - 1e-9:
            return cost(chosen)
        chosen[best[2]] = best[1]


@pytest.mark.parametrize("metric, seed, block", [("euclidean", 1, 2000), ("euclidean", 5, 20), ("jaccard", 3, 25)])
def test_medoids_cost_no_more_than_the_plain_search(spark, monkeypatch, metric, seed, block):
    monkeypatch.setattr(agglomeration, "BLOCK", block)
    x = np.random.default_rng(seed).uniform(0.1, 5, (60, 3))
    df = vectors(spark, x.tolist()).repartition(4)
    keys, cost = agglomeration.pam(df, 5, metric=metric)
    d = block_distances(metric, x, x)
    assert len(keys) == 5 and cost == pytest.approx(d[:, keys].min(1).sum())
    assert cost <= plain_pam(d, 5) + 1e-9


def test_more_medoids_than_rows(spark):
    df = vectors(spark, [(1.0, 2.0), (1.0, 2.0), (5.0, 5.0)])
    assert agglomeration.pam(df, 9)[0] == [0, 1, 2] and agglomeration.pam(df.limit(0), 3) == ([], 0.0)
