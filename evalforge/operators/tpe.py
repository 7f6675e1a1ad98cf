"""Search for parameters by tree-structured Parzen estimators, with trials as concurrent Spark jobs.

Trials so far are divided into the good ones and the others; each parameter has a Parzen density
of either kind, and of values drawn from the good density the one with the largest ratio of good to other
is tried next. Trials of a batch are proposed together, those that are still open counting as bad ones, and
run at once: each is a Spark job of its own on a table that is written once. What the driver holds is the list
of trials.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the published search: share of good trials (of the square root of all), trials with full
#: weight, draws for a proposal, weight of the prior.
GAMMA, FULL_WEIGHT, DRAWS, PRIOR = 0.25, 25, 24, 1.0


@dataclass(frozen=True)
class Dimension:
    """uniform, log or integer between low and high, or a choice of values."""

    kind: str
    low: float = 0.0
    high: float = 1.0
    values: tuple = ()

    def __post_init__(self):
        if self.kind not in ("uniform", "log", "integer", "choice"):
            raise ValueError(f"unknown kind {self.kind!r}; known: choice, integer, log, uniform")
        if self.kind == "choice" and not self.values or self.kind != "choice" and not self.low < self.high or self.kind == "log" and self.low <= 0:
            raise ValueError(f"empty dimension {self}")

    @property
    def bounds(self) -> tuple[float, float]:
        if self.kind == "log":
            return math.log(self.low), math.log(self.high)
        half = 0.5 if self.kind == "integer" else 0.0
        return self.low - half, self.high + half

    def inner(self, value: float) -> float:
        return math.log(value) if self.kind == "log" else float(value)

    def outer(self, x: float) -> float | int:
        if self.kind == "integer":
            return int(min(self.high, max(self.low, round(x))))
        return min(self.high, max(self.low, math.exp(x) if self.kind == "log" else x))


def forgetting(n: int, full: int = FULL_WEIGHT) -> np.ndarray:
    """Weights of n trials in order of time: the last `full` have 1, older ones fall to 1 / n."""
    return np.ones(n) if n <= full else np.concatenate([np.linspace(1 / n, 1, n - full), np.ones(full)])


@dataclass(frozen=True)
class Mixture:
    """Normal components, cut off at the bounds."""

    weights: np.ndarray
    means: np.ndarray
    sigmas: np.ndarray
    low: float
    high: float

    def _below(self, x: float) -> float:
        return float(sum(w * 0.5 * (1 + math.erf((x - m) / (s * math.sqrt(2)))) for w, m, s in zip(self.weights, self.means, self.sigmas, strict=True)))

    def density(self, x: float, half: float = 0.0) -> float:
        """The density at x, or with half > 0 the probability within half of x."""
        whole = self._below(self.high) - self._below(self.low)
        if half:
            return (self._below(min(x + half, self.high)) - self._below(max(x - half, self.low))) / whole
        z = (x - self.means) / self.sigmas
        return float((self.weights * np.exp(-0.5 * z * z) / (self.sigmas * math.sqrt(2 * math.pi))).sum() / whole)

    def draw(self, rng: np.random.Generator) -> float:
        while True:
            i = rng.choice(len(self.weights), p=self.weights / self.weights.sum())
            x = float(rng.normal(self.means[i], self.sigmas[i]))
            if self.low <= x <= self.high:
                return x


def parzen(observed: Sequence[float], low: float, high: float) -> Mixture:
    """A component for each observation (in order of time), as wide as the farther of its neighbours is away,
    and the prior: the middle of the range, as wide as the range."""
    spread, n = high - low, len(observed)
    means = np.append(np.asarray(observed, float), (low + high) / 2)
    weights = np.append(forgetting(n), PRIOR)
    order = np.argsort(means, kind="stable")
    means, weights, prior = means[order], weights[order], order == n
    gap = np.diff(means)
    left, right = np.append(0.0, gap), np.append(gap, 0.0)
    sigmas = np.clip(np.maximum(left, right), spread / min(100.0, 1.0 + len(means)), spread)
    sigmas[prior] = spread
    return Mixture(weights / weights.sum(), means, sigmas, low, high)


def choice_probabilities(observed: Sequence[int], n: int) -> np.ndarray:
    """Weighted counts of places with the prior spread evenly."""
    counts = np.bincount(np.asarray(observed, int), weights=forgetting(len(observed)), minlength=n) + PRIOR / n
    return counts / counts.sum()


def split_trials(losses: Sequence[float]) -> np.ndarray:
    """Which trials are good: the ceil(GAMMA * sqrt(n)) of least loss, FULL_WEIGHT at most."""
    n = len(losses)
    good = np.zeros(n, bool)
    good[np.argsort(np.asarray(losses, float), kind="stable")[: min(FULL_WEIGHT, math.ceil(GAMMA * math.sqrt(n)))]] = True
    return good


def _rng(seed: int | str, number: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{number}".encode()).digest()[:8], "big"))


def draw_prior(space: dict[str, Dimension], rng: np.random.Generator) -> dict:
    out = {}
    for name, d in space.items():
        out[name] = d.values[int(rng.integers(len(d.values)))] if d.kind == "choice" else d.outer(float(rng.uniform(*d.bounds)))
    return out


def propose(space: dict[str, Dimension], trials: Sequence[tuple[dict, float]], rng: np.random.Generator) -> dict:
    """The next parameters, each by itself, from (parameters, loss) in order of time."""
    good, out = split_trials([loss for _, loss in trials]), {}
    for name, d in space.items():
        if d.kind == "choice":
            at = [d.values.index(p[name]) for p, _ in trials]
            a, b = (choice_probabilities([x for x, g in zip(at, good, strict=True) if g == side], len(d.values)) for side in (True, False))
            drawn = rng.choice(len(d.values), size=DRAWS, p=a)
            out[name] = d.values[int(max(drawn, key=lambda i: a[i] / b[i]))]
            continue
        x = [d.inner(p[name]) for p, _ in trials]
        a, b = (parzen([v for v, g in zip(x, good, strict=True) if g == side], *d.bounds) for side in (True, False))
        half = 0.5 if d.kind == "integer" else 0.0
        drawn = [float(round(v)) if half else v for v in (a.draw(rng) for _ in range(DRAWS))]
        out[name] = d.outer(max(drawn, key=lambda v: a.density(v, half) / max(b.density(v, half), 1e-300)))
    return out


@dataclass
class Trial:
    number: int
    proposed_by: str
    params: dict
    loss: float = math.nan


def search(evaluate: Callable[[dict], float], space: dict[str, Dimension], budget: int = 50, batch: int = 4, seed: int | str = 42, history: Sequence[Trial] = ()) -> list[Trial]:
    """budget more trials after those of history, all of them returned. The first clamp(budget / 3, 5, 20) of a history
    come from the prior. evaluate is called from `batch` threads at once; a loss that is not finite
    counts as the worst. The result depends on the seed and on batch, not on which trial ends first."""
    trials, end = list(history), len(history) + budget
    start = max(5, min(20, budget // 3))
    with ThreadPoolExecutor(max_workers=max(1, batch)) as pool:
        while len(trials) < end:
            known = [(t.params, t.loss if math.isfinite(t.loss) else math.inf) for t in trials]
            now: list[Trial] = []
            for number in range(len(trials), min(end, len(trials) + batch)):
                rng = _rng(seed, number)
                if number < start or not trials:
                    now.append(Trial(number, "prior", draw_prior(space, rng)))
                else:
                    now.append(Trial(number, "tpe", propose(space, [*known, *((t.params, math.inf) for t in now)], rng)))
            # A wrapped target each: it keeps the session's local properties, and is made for one thread.
            jobs = [pool.submit(inheritable_thread_target(evaluate), t.params) for t in now]
            for t, job in zip(now, jobs, strict=True):
                t.loss = float(job.result())
            trials += now
    return trials


def best(trials: Sequence[Trial]) -> Trial:
    """The least loss, the earliest of equals."""
    return min(trials, key=lambda t: (t.loss if math.isfinite(t.loss) else math.inf, t.number))


def as_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    """(trial, proposed_by, params, loss, best_so_far, is_best): a history as rows, params as JSON."""
    rows, least, top = [], math.inf, best(trials).number if trials else -1
    for t in trials:
        least = min(least, t.loss if math.isfinite(t.loss) else math.inf)
        rows.append((t.number + 1, t.proposed_by, json.dumps(t.params, sort_keys=True), t.loss, least, t.number == top))
    return spark.createDataFrame(rows, "trial int, proposed_by string, params string, loss double, best_so_far double, is_best boolean")
