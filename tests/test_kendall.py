"""Kendall's tau-b of groups that are counted in ranges, against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalforge.operators.metrics import kendall


def plain(x: np.ndarray, y: np.ndarray) -> float:
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    below = math.sqrt((sx != 0).sum() * (sy != 0).sum())
    return (sx * sy).sum() / below if below else math.nan


def made() -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(4)
    a = rng.normal(size=1500)
    hot = np.where(rng.random(1200) < 0.4, 2.5, rng.normal(size=1200))
    return {
        "plain": (a, a + rng.normal(size=1500)), "ties": (rng.integers(0, 9, 1300).astype(float), rng.integers(0, 30, 1300).astype(float)),
        None: (hot, np.where(rng.random(1200) < 0.5, hot, 2.5)), "flat": (np.ones(700), rng.normal(size=700)), "small": (a[:40], -a[:40]), "reversed": (np.arange(900.0), -np.arange(900.0)),
    }


@pytest.mark.parametrize("range_rows", [10**6, 300, 60])
def test_ranges_equal_all_pairs(spark, range_rows):
    groups = made()
    rows = [(k, 1, float(p), float(q)) for k, (x, y) in groups.items() for p, q in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "g string, h int, y_true double, y_pred double").repartition(4)
    got = {r["g"]: r for r in kendall(df, ("g", "h"), range_rows).collect()}
    assert got.keys() == groups.keys()
    for k, (x, y) in groups.items():
        assert got[k]["n"] == len(x)
        assert got[k]["kendall"] == pytest.approx(plain(x, y), nan_ok=True, abs=1e-12)


def test_a_group_of_very_many_rows(spark):
    """y falls behind x in steps: no task holds the group, and the result is that of whole counts."""
    n = 200_000
    df = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") % 1000).cast("double").alias("y_true"), (-(F.col("id") % 1000)).cast("double").alias("y_pred"))
    assert kendall(df, ("g",), 20_000).first()["kendall"] == pytest.approx(-1.0)
