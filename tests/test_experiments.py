"""Tukey's comparisons by metric, rank matrices and annotated predictions on tables worked by hand."""

from __future__ import annotations

import math

import pytest

from evalforge.operators import composites, ranking

from .test_core import vectors


def test_tukey_by_equals_tukey_of_each_metric(spark):
    rows = [(m, g, float(i * i % 7 + 3 * (g == "b") + (g == "c") * (m == "r")) if i else math.nan) for m in "rs" for g in "abc" for i in range(9)] + [("lonely", "a", 1.0), ("r", "d", None)]
    df = spark.createDataFrame(rows, "metric string, alg string, v double")
    got = {(r["metric"], r["group1"], r["group2"]): r for r in ranking.tukey_by(df, ["metric"], "alg", "v").collect()}
    assert len(got) == 6 and {k[0] for k in got} == {"r", "s"}
    for m in "rs":
        one = ranking.tukey_hsd(df.filter(f"metric = '{m}' AND NOT isnan(v)"), "alg", "v").collect()
        for w in one:
            g = got[m, w["group1"], w["group2"]]
            assert [g[c] for c in ("difference", "low", "high", "p_corrected")] == pytest.approx([w[c] for c in ("difference", "low", "high", "p_corrected")])
    assert ranking.tukey_by(df, ["metric"], "alg", "v", intervals=False).columns == ["metric", "group1", "group2", "difference", "statistic"]
    assert ranking.tukey_by(df.limit(0), ["metric"], "alg", "v").count() == 0


def test_metric_ranks_of_complete_data_sets(spark):
    rows = [("d1", "x", "r2", 0.9, -0.1, True), ("d1", "y", "r2", 0.5, 0.3, True), ("d2", "x", "r2", 0.2, 0.0, True), ("d2", "y", "r2", 0.2, -0.2, True), ("d3", "x", "r2", 0.7, 0.1, True), ("d3", "y", "r2", math.nan, 0.1, True)]
    df = spark.createDataFrame(rows, "dataset string, splitter string, metric string, ips double, diff double, higher_better boolean")
    got = {(r["target"], r["splitter"]): (r["avg_rank"], r["n_blocks"]) for r in ranking.metric_ranks(df).collect()}
    assert got == {("benchmark", "x"): (1.25, 2), ("benchmark", "y"): (1.75, 2), ("gap", "x"): (3.5 / 3, 3), ("gap", "y"): (pytest.approx(5.5 / 3), 3)}


def test_annotated_predictions(spark):
    train = vectors(spark, [(1.0, 0.0), (0.9, 0.1), (0.95, 0.05), (0.8, 0.1)])
    asked = spark.createDataFrame([(10, [1.0, 0.02]), (11, [-1.0, 0.5])], "vec_id long, x array<double>")
    runs = [(10, "m", 1.0, 1.0), (10, "m", 1.0, 3.0), (11, "m", 2.0, 2.0), (12, "m", 5.0, 4.0)]
    p = spark.createDataFrame(runs, "sample_id long, model string, y_true double, y_pred double")
    got = {r["sample_id"]: r for r in composites.annotated(p, train, asked, k=2).collect()}
    assert got[10]["y_pred"] == 2.0 and got[10]["is_champion"] and got[10]["in_domain"] and not got[11]["in_domain"]
    assert got[10]["nn_dist_to_train"] == pytest.approx(0.02) and got[12]["in_domain"] is None and got[12]["ad_score"] is None
    chosen = spark.createDataFrame([(10, "a", True, 1.0, 1.0), (10, "b", False, 1.0, 7.0)], "sample_id long, model string, is_champion boolean, y_true double, y_pred double")
    assert sorted((r["model"], r["is_champion"], r["y_pred"]) for r in composites.normalised(chosen).collect()) == [("a", True, 1.0), ("b", False, 7.0)]
