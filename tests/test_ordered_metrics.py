"""Metrics that need an order: groups taken whole by tasks against windows and ranges, and without windows where groups are small."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalforge.operators import metrics

TIES = ("id", "y_true", "y_pred")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    out, i = [], 0
    for g, n in {"plain": 300, "ties": 260, "nulls": 120, "nan": 90, "flat": 50, "two": 2, "one": 1, "none": 5, **{f"s{k}": k % 7 + 1 for k in range(60)}}.items():
        for k in range(n):
            x = float(rng.normal())
            y = x + float(rng.normal())
            if g == "ties":
                x, y = float(rng.integers(0, 5)), float(rng.integers(0, 9))
            elif g == "nulls":
                x, y = None if k % 5 == 0 else x, None if k % 7 == 0 else y
            elif g == "nan":
                x, y = math.nan if k % 5 == 0 else x, math.nan if k % 4 == 0 else y
            elif g == "flat":
                x = 1.0
            elif g == "none":
                x = y = None
            out.append((g, k % 2 if g == "plain" else None, None if k % 11 == 0 else i // 3, x, y))
            i += 1
    return spark.createDataFrame(out, "g string, h int, id long, y_true double, y_pred double").repartition(3).cache()


def same(a: dict, b: dict) -> None:
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].asDict().items():
            w = b[k][c]
            assert v == w or v == pytest.approx(w, nan_ok=True, abs=1e-9), (k, c, v, w)


def test_tasks_and_windows_agree(rows):
    key = lambda df: {(r["g"], r["h"]): r for r in df.collect()}
    one = key(metrics.fold_metrics(rows, ("g", "h")))
    assert len(one) == 69 and one["none", None]["medae"] is None
    same(one, key(metrics.fold_metrics(rows, ("g", "h"), group_rows=0)))
    same(one, key(metrics.fold_metrics(rows, ("g", "h"), group_rows=100)))


def test_reports_agree_with_the_single_operators(rows):
    known = rows.filter("y_true IS NOT NULL AND y_pred IS NOT NULL")
    key = lambda df: {r["g"]: r for r in df.collect()}
    # Rows of equal ties have no order of their own: their values decide.
    one = key(metrics.fold_report(known, ("g",), TIES))
    same(one, key(metrics.fold_report(known, ("g",), TIES, group_rows=0)))
    for more in (metrics.top_k_enrichment(known, ("g",), (0.05, 0.1, 0.2), TIES), metrics.bedroc(known, ("g",), TIES), metrics.kendall(known, ("g",))):
        for r in more.filter("g <> 'one'").collect():
            assert one[r["g"]]["n"] < 2 or all(one[r["g"]][c] == pytest.approx(v, nan_ok=True) for c, v in r.asDict().items() if c != "g")


def test_no_window_orders_small_groups(rows):
    """Windows and medians held all groups of a task, in the memory of that task."""
    plan = metrics.fold_report(rows, ("g",), TIES)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "median" not in plan and "percentile" not in plan


def test_groups_of_one_hash_and_many_pieces(rows, monkeypatch):
    """Small groups come in several pieces of a task's rows, and groups that share a hash stay apart."""
    want = {(r["g"], r["h"]): r for r in metrics.fold_metrics(rows, ("g", "h")).collect()}
    monkeypatch.setattr(metrics, "_AT_ONCE", 7)
    monkeypatch.setattr(metrics.F, "xxhash64", lambda *c: F.pmod(F.hash(*c), F.lit(3)).cast("long"))
    same(want, {(r["g"], r["h"]): r for r in metrics.fold_metrics(rows, ("g", "h")).collect()})


def test_inversions_by_segment():
    rng = np.random.default_rng(1)
    values, seg = rng.integers(0, 12, 200), np.repeat([0, 1, 2, 3], [80, 1, 100, 19])
    want = [sum(v[i] > v[j] for i in range(len(v)) for j in range(i + 1, len(v))) for v in (values[seg == s] for s in range(4))]
    assert metrics._inversions_by(seg * 12 + values, seg, 4).tolist() == want
