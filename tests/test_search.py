"""Searches by Parzen estimators: densities against sums over components, and budgets against a grid."""

from __future__ import annotations

import math
import threading

import numpy as np
import pytest

from evalforge.operators import models, tpe
from evalforge.operators.tpe import Dimension


def test_densities_equal_a_plain_sum():
    seen = [0.2, 3.0, 2.5, 9.0]
    m = tpe.parzen(seen, 0.0, 10.0)
    points = sorted([*seen, 5.0])
    plain = []
    for i, p in enumerate(points):
        gap = max(p - points[i - 1] if i else 0, points[i + 1] - p if i + 1 < len(points) else 0)
        plain.append((0.2, p, 10.0 if p == 5.0 else min(10.0, max(gap, 10.0 / 6))))
    cdf = lambda x, mu, s: 0.5 * (1 + math.erf((x - mu) / s / math.sqrt(2)))
    whole = sum(w * (cdf(10, mu, s) - cdf(0, mu, s)) for w, mu, s in plain)
    for x in (0.0, 0.7, 4.2, 10.0):
        want = sum(w * math.exp(-((x - mu) ** 2) / 2 / s**2) / s / math.sqrt(2 * math.pi) for w, mu, s in plain) / whole
        assert m.density(x) == pytest.approx(want, rel=1e-12)
    grid = np.linspace(0, 10, 20001)
    assert np.trapezoid([m.density(x) for x in grid], grid) == pytest.approx(1, abs=1e-6)
    assert sum(m.density(x, 0.5) for x in np.arange(0.5, 10)) == pytest.approx(1)


def test_choices_weights_and_halves():
    assert tpe.choice_probabilities([0, 0, 2], 3) == pytest.approx([(2 + 1 / 3) / 4, (1 / 3) / 4, (1 + 1 / 3) / 4])
    assert tpe.forgetting(30)[:6] == pytest.approx(np.r_[np.linspace(1 / 30, 1, 5), 1.0])
    assert tpe.split_trials([3, 1, 2, 1]).tolist() == [False, True, False, False]
    assert tpe.split_trials(list(range(100))).sum() == 3
    with pytest.raises(ValueError):
        Dimension("log", 0, 1)
    with pytest.raises(ValueError):
        Dimension("other")


def loss(p: dict) -> float:
    """Least at a rate of 0.013 and a mix of 0.83, far from a coarse grid's points."""
    return (math.log10(p["regParam"]) - math.log10(0.013)) ** 2 + 4 * (p["elasticNetParam"] - 0.83) ** 2


def test_beats_the_shuffled_grid():
    wins = 0
    for seed in range(8):
        trials = tpe.search(loss, models.DIMENSIONS["elasticnet"], 20, 4, seed)
        assert len(trials) == 20 and [t.proposed_by for t in trials].count("prior") >= 5
        wins += tpe.best(trials).loss < min(loss(p) for p in models.candidates("elasticnet", seed)[:20])
    assert wins >= 6
    first = min(loss(t.params) for s in range(8) for t in tpe.search(loss, models.DIMENSIONS["elasticnet"], 60, 4, s))
    assert first < 0.01


def test_batches_run_at_once_and_repeat():
    together, most, lock = [0], [0], threading.Barrier(3, timeout=20)

    def slow(p: dict) -> float:
        together[0] += 1
        most[0] = max(most[0], together[0])
        lock.wait()
        together[0] -= 1
        return p["n"] + p["c"]

    space = {"n": Dimension("integer", 1, 9), "c": Dimension("choice", values=(0, 5))}
    a = tpe.search(slow, space, 12, 3, 7)
    b = tpe.search(lambda p: p["n"] + p["c"], space, 12, 3, 7)
    assert most[0] == 3 and [t.params for t in a] == [t.params for t in b]
    more = tpe.search(lambda p: math.nan, space, 3, 3, 7, a)
    assert len(more) == 15 and tpe.best(more).loss == tpe.best(a).loss
    assert all(isinstance(t.params["n"], int) and 1 <= t.params["n"] <= 9 for t in more)


def test_history_as_rows(spark):
    trials = [tpe.Trial(0, "prior", {"b": 1, "a": 2}, 3.0), tpe.Trial(1, "tpe", {"a": 0}, math.nan), tpe.Trial(2, "tpe", {"a": 1}, 2.0)]
    got = [tuple(r) for r in tpe.as_table(spark, trials).orderBy("trial").collect()]
    assert got[0] == (1, "prior", '{"a": 2, "b": 1}', 3.0, 3.0, False) and got[2][3:] == (2.0, 2.0, True) and got[1][4] == 3.0
    assert tpe.as_table(spark, []).count() == 0


def test_champion_and_refit(spark):
    rows = [(i, i % 3, [float(i % 7), float(i % 5)], 2.0 * (i % 7) - (i % 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, fold int, x array<double>, y double")
    found = models.select_champion(df, "fold", ("elasticnet", "forest"), budget=4, keep=(1, 1, 1), first=2)
    top = next(x for x in found if x["is_champion"])
    assert top["learner"] == "elasticnet" and top["round_eliminated"] == 0 and top["trials"] == 4
    assert [x["round_eliminated"] for x in found if x is not top] == [1] and all(x["trials"] == 2 for x in found if x is not top)
    p = models.refit(top, df, df)
    assert p.count() == 90 and "y_pred" in p.columns
    assert models.refit_seed(42, "forest") != models.refit_seed(42, "gbt") != models.refit_seed(43, "gbt")
    runs = models.train_runs(df, {"a": df, "b": df.limit(10)}, "elasticnet", 2)
    assert {(r["set"], r["run"]): r["count"] for r in runs.groupBy("set", "run").count().collect()} == {("a", 1): 90, ("a", 2): 90, ("b", 1): 10, ("b", 2): 10}
