"""Support vector regression against the dual problem, solved row by row, and on held-out rows."""

from __future__ import annotations

import numpy as np
import pytest

from evalforge.operators import models, svr
from evalforge.operators.task_sums import task_sums


def data(n: int = 200, seed: int = 1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 2))
    return x, np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.05, n)


def table(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "vec_id long, x array<double>, y double").repartition(3)


def dual(z: np.ndarray, y: np.ndarray, cost: float, epsilon: float) -> np.ndarray:
    """Weights from coordinate ascent on the dual: each row's multiplier has a closed best value."""
    a, w, square = np.zeros(len(y)), np.zeros(z.shape[1]), (z * z).sum(1)
    for _ in range(3000):
        moved = 0.0
        for i in range(len(y)):
            free = a[i] + (y[i] - z[i] @ w) / square[i]
            new = np.clip(np.sign(free) * max(0.0, abs(free) - epsilon / square[i]), -cost, cost)
            w += (new - a[i]) * z[i]
            moved, a[i] = max(moved, abs(new - a[i])), new
        if moved < 1e-7:
            break
    return w


def test_agrees_with_the_dual(spark):
    x, y = data()
    m = svr.fit(table(spark, x, y), cost=2.0, epsilon=0.1, gamma=0.5, features=40)
    z = m.features(x)
    w = dual(z, (y - m.y_mean) / m.y_scale, 2.0, 0.1)
    objective = lambda v: 0.5 * v @ v + 2.0 * np.maximum(np.abs((y - m.y_mean) / m.y_scale - z @ v) - 0.1, 0).sum()
    assert objective(m.weights) == pytest.approx(objective(w), rel=4e-3)
    assert np.abs(z @ (m.weights - w)).max() < 0.05


def test_held_out_rows_and_odd_tables(spark):
    x, y = data(400, 2)
    df = table(spark, x, y)
    p = models.fit_predict(df.filter("vec_id < 300"), df.filter("vec_id >= 300"), "svr", cost=10.0, epsilon=0.05, gamma=0.5).toPandas()
    assert np.sqrt(((p["y_pred"] - p["y"]) ** 2).mean()) < 0.3 * y.std()
    flat = svr.predict(svr.fit(df.limit(0)), df.limit(5)).collect()
    assert len(flat) == 5 and all(r["y_pred"] == 0 for r in flat)
    same = table(spark, np.ones((5, 2)), np.full(5, 3.0))
    assert all(r["y_pred"] == pytest.approx(3.0) for r in svr.predict(svr.fit(same), same).collect())


def test_sums_of_tasks(spark):
    df = spark.range(1000).repartition(37).selectExpr("id", "array(double(id), 1D) AS x")
    assert task_sums(df, lambda p: np.array(p["x"].tolist()).sum(0), 2).tolist() == [499500.0, 1000.0]
    assert task_sums(df.limit(0), lambda p: np.ones(2), 2).tolist() == [0.0, 0.0]
