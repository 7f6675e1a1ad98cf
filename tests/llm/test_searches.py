"""Top-k joins and ranked lexical search against brute force, with small cells, groups, shards and trees."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalforge.llm import lexical_search, topk_join

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def vectors() -> list[tuple]:
    draw = random.Random(3)
    centres = [[draw.uniform(-5, 5) for _ in range(3)] for _ in range(8)]
    rows = [(i if i % 97 else None, [x + draw.gauss(0, 0.05) for x in centres[i % 8]]) for i in range(1200)]
    rows += [(7, [1.0, 2.0, 3.0])] * 40 + [(50, [1.0, 2.0, 3.0])] * 2
    return rows + [(100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf")]), (300, []), (350, [1.0] * 70), (400, [1e30, -1e30, 2.0])]


def best_products(rows: list[tuple], k: int = 5) -> list[tuple]:
    fine = [(i, [max(LEAST, min(MOST, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i is not None and i % 50 == 0:
            scores = sorted((-max(LEAST + 1, min(MOST, sum(x * y for x, y in zip(q, c, strict=False)))), j is None, j or 0) for b, (j, c) in enumerate(fine) if a != b)
            out += [(i, r, None if unknown else j, -s) for r, (s, unknown, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"pivots": 9, "group_queries": 4, "strip_rows": 100}])
def test_nearest(spark, sizes):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, 2, True) for i, v in rows], "vec_id long, embedding array<double>, key long, cell int, query boolean").repartition(3)
    find = lambda df: topk_join.nearest(df, F.col("vec_id") % 50 == 0, "vec_id", topk_join.scaled(F.col("embedding")), **sizes)
    got = find(df).select("query_id", "rank", "vec_id", "score")
    assert sorted((tuple(r) for r in got.collect()), key=str) == best_products(rows)
    assert find(df.limit(0)).count() == 0


def test_routes_leave_out_far_cells():
    """Ten far clusters on a line: each group needs its own cell and no other."""
    import pandas as pd

    between = np.abs(np.subtract.outer(np.arange(10), np.arange(10))) * 100.0
    cells = pd.DataFrame({"cell": range(10), "n": 50, "queries": 5, "reach": 1.0, "radius": 2.0})
    ways, groups = topk_join.routes(cells, {c: [0.0, 0.1, 0.2, 0.5, 0.6, 0.7] for c in range(10)}, between, 5, 5)
    assert sorted((r.cell, int(groups.set_index("cell")["to"][r.cell]) == r.to) for r in ways.itertuples()) == [(c, True) for c in range(10)]


def tokens(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best_documents(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counted = [(i, Counter(tokens(t))) for i, t in docs if tokens(t)]
    n, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df, out = Counter(w for _, c in counted for w in c), []
    for item, text in items:
        scores = []
        for j, c in counted:
            m = 10 + (90 * sum(c.values()) * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(tokens(text)) if w in c)
            if s > 0:
                scores.append((-s, j is None, j or 0))
        out += [(item, r, None if unknown else j, -s) for r, (s, unknown, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 900, "batch_docs": 16, "fanout": 2}])
def test_lexical_search(spark, sizes):
    docs = [(1, "a b c"), (2, "A b b d"), (3, None), (4, ""), (None, "a é é x1"), (5, "a b c"), (5, "a b c"), (6, "zz " * 30000 + " a"), (7, "É é-c_d")]
    docs += [(100 + i, " ".join(f"t{(i * j) % 37}" for j in range(1, 1 + i % 50))) for i in range(300)]
    items = [(1, "a b"), (2, None), (3, "..."), (None, "É é c"), (1, "a b"), (9, "t1 t2 t3 t4 a zz"), *[(20 + i, " ".join(f"T{(i * k) % 41}" for k in range(9))) for i in range(30)]]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, key long, n long, score long").repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, terms string")
    got = lexical_search.search(d, i, **sizes).select("item_id", "rank", "doc_id", "score")
    assert sorted((tuple(r) for r in got.collect()), key=str) == best_documents(docs, items)
    if not sizes:
        assert lexical_search.search(d, i.limit(0)).count() == lexical_search.search(d.limit(0), i).count() == 0


def test_trees_leave_out_batches():
    """Documents of two vocabularies and items of one of them: nodes of the other are not followed."""
    draw = np.random.default_rng(1)
    items = [np.sort(draw.choice(50, 8, replace=False)) for _ in range(64)]
    tree = lexical_search.ItemTree(items, np.full(100, 1000))
    size = np.full(512, 10)
    term = np.concatenate([np.sort(draw.choice(50, 10, replace=False)) + (50 if d >= 256 else 0) for d in range(512)])
    doc, value = np.repeat(np.arange(512), size), draw.integers(1, 1000, 5120)
    levels = lexical_search.doc_levels(doc, term, value, 512, 100, len(tree.levels), 8)
    d, item, score, followed = lexical_search.dual_search(levels, tree, np.ones(64, np.int64))
    dense, weight = np.zeros((512, 100), np.int64), np.zeros((100, 64), np.int64)
    dense[doc, term] = value
    for place, i in enumerate(tree.order):
        weight[items[i], place] = 1000
    want = dense @ weight
    assert {(a, b): s for a, b, s in zip(d.tolist(), item.tolist(), score.tolist(), strict=True)} == {(a, b): int(want[a, b]) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True)}
    assert followed[0] <= tree.levels[-1][0] * 512 // 8 ** (len(tree.levels) - 1) // 2 and d.max() < 256
