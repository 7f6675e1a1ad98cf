"""Support vector regression with a Gaussian kernel, on random Fourier features.

The kernel exp(-gamma |x - z|^2) is the mean product of cosines of random projections, so the regression is a linear
one of these features: half the squared weights plus C times the epsilon-insensitive loss. The loss is
smoothed over a width that shrinks step by step, and each step is Newton's. A pass sums the gradient and the
second derivatives in tasks, another one the losses at several lengths of the step; what reaches the driver
are arrays as wide as the features squared, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalforge.operators.task_sums import task_sums
from evalforge.sources.scratch import materialise

#: Random features.
FEATURES = 256
#: Widths of the smoothed corner, as shares of the target's deviation.
WIDTHS = (0.5, 0.05, 0.005, 0.001)
STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.02])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    y_mean: float
    y_scale: float

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines of projections, and a constant for the offset."""
        z = np.sqrt(2 / len(self.shift)) * np.cos((x - self.mean) / self.scale @ self.turn + self.shift)
        return np.column_stack([z, np.ones(len(z))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), self.y_mean)
        return self.features(x) @ self.weights * self.y_scale + self.y_mean


def smoothed(r: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The epsilon-insensitive loss of residuals with a rounded corner, and its two derivatives."""
    t = np.abs(r) - epsilon
    bend = (t > 0) & (t < width)
    loss = np.where(t <= 0, 0, np.where(bend, t * t / (2 * width), t - width / 2))
    return loss, np.clip(t / width, 0, 1) * np.sign(r), bend / width


def _rows(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.array(p["x"].tolist(), float), p["y"].to_numpy(float)


def fit(train: DataFrame, target: str = "y", vector: str = "x", cost: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, features: int = FEATURES, seed: int = 42) -> Model:
    """Features and target are scaled to deviation 1 first (epsilon is in units of the target's); gamma is 1 / number of
    features unless given. Rows with a null target or vector take no part; all of a table without rows gives a model of 0."""
    rows = train.select(F.col(vector).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).dropna()
    rows = materialise(rows)
    wide = rows.agg(F.max(F.size("x"))).first()[0] or 1

    def moments(p: pd.DataFrame) -> np.ndarray:
        x, y = _rows(p)
        return np.concatenate([[len(y), y.sum(), (y * y).sum()], x.sum(0), (x * x).sum(0)])

    s = task_sums(rows, moments, 3 + 2 * wide)
    n = max(s[0], 1.0)
    deviation = lambda total, squares: np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    scale, y_scale = deviation(s[3 : 3 + wide], s[3 + wide :]), float(deviation(s[1], s[2]))
    rng = np.random.default_rng(seed)
    turn = rng.normal(0, np.sqrt(2 * (gamma or 1 / wide)), (wide, features))
    m = Model(s[3 : 3 + wide] / n, np.where(scale > 1e-12, scale, 1.0), turn, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), float(s[1] / n), y_scale or 1.0)
    d = features + 1
    for width in WIDTHS:
        for _ in range(15):

            def derivatives(p: pd.DataFrame, m: Model = m, width: float = width) -> np.ndarray:
                x, y = _rows(p)
                z = m.features(x)
                _, first, second = smoothed((y - m.y_mean) / m.y_scale - z @ m.weights, epsilon, width)
                return np.concatenate([z.T @ first, ((z * second[:, None]).T @ z).ravel()])

            s = task_sums(rows, derivatives, d + d * d)
            slope = m.weights - cost * s[:d]
            step = -np.linalg.solve(np.eye(d) + cost * s[d:].reshape(d, d), slope)

            def losses(p: pd.DataFrame, m: Model = m, step: np.ndarray = step, width: float = width) -> np.ndarray:
                x, y = _rows(p)
                z = m.features(x)
                r, along = (y - m.y_mean) / m.y_scale - z @ m.weights, z @ step
                return np.array([smoothed(r - t * along, epsilon, width)[0].sum() for t in (0.0, *STEPS)])

            lengths = np.array([0.0, *STEPS])
            value = cost * task_sums(rows, losses, len(lengths)) + [0.5 * ((m.weights + t * step) ** 2).sum() for t in lengths]
            best = int(value.argmin())
            m.weights = m.weights + lengths[best] * step
            if best == 0 or value[0] - value[best] < 3e-6 * max(1.0, abs(value[0])):
                break
    return m


def predict(model: Model, rows: DataFrame, vector: str = "x") -> DataFrame:
    """rows with y_pred."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield p.assign(y_pred=sent.value.predict(np.array(p[vector].tolist(), float)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "y_pred")
    return rows.drop("y_pred").mapInPandas(run, f"{fields}, y_pred double")
