"""Published and hand-made values of the core operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from evalforge.functions import columns, special
from evalforge.operators import clustering, distances, metrics, models, ranking, selection, splits, summaries
from evalforge.sources import loaders, sinks
from evalforge.streaming import incremental

# Published examples: three and five treatments.
FRIEDMAN_A = [
    (4, 6, 3, 4, 3, 2, 2, 7, 6, 5, 3, 8, 6, 1, 5, 7), (5, 6, 8, 7, 7, 8, 4, 6, 4, 5, 2, 4, 4, 3, 8, 9), (2, 4, 4, 3, 2, 2, 1, 4, 3, 2, 5, 3, 5, 7, 6, 1),
]
FRIEDMAN_B = [(72, 96, 88, 92, 74, 76, 82), (120, 120, 132, 120, 101, 96, 112), (76, 95, 104, 96, 84, 72, 76)]


def long_of(spark, groups):
    rows = [(f"b{i}", f"g{k}", float(v)) for k, g in enumerate(groups) for i, v in enumerate(g)]
    return spark.createDataFrame(rows, "block string, grp string, v double")


def vectors(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, x array<double>")


def test_tanimoto(spark):
    df = spark.createDataFrame([([0, 2], [0, 1]), ([0], [1]), ([], [])], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(columns.tanimoto(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1 / 3, 0, 1])


def test_nearest(spark):
    train, test = vectors(spark, [(1, 2), (3, 4), (5, 6)]), vectors(spark, [(1.1, 2.1), (5.1, 6.1)], 10)
    assert [r["d"] for r in distances.nn_distance(test, train).orderBy("query").collect()] == pytest.approx([0.141421] * 2, abs=1e-6)
    train, test = vectors(spark, [(1, 0, 1), (0, 0, 0)]), vectors(spark, [(1, 0, 0), (0, 1, 0)], 10)
    assert [r["d"] for r in distances.nn_distance(test, train, "jaccard").orderBy("query").collect()] == pytest.approx([0.5, 1.0])
    assert distances.nn_distance(test.limit(0), train).count() == 0


def test_mmd(spark):
    a, b = vectors(spark, [(0, 0), (1, 1)]), vectors(spark, [(1, 0), (0, 1)])
    assert distances.mmd(a, b) == pytest.approx(0.154818121, abs=1e-8)
    both = a.withColumn("s", F.lit(True)).union(b.withColumn("s", F.lit(False)))
    assert distances.mmd_linear(both, "s").first()[0] == pytest.approx(distances.mmd(a, b, "linear"), abs=1e-12)
    with pytest.raises(ValueError):
        distances.mmd(a.limit(0), b)
    a, b = vectors(spark, [(1, 2, 3), (4, 5, 6), (7, 8, 9)]), vectors(spark, [(7, 6, 5), (4, 3, 2), (1, 1, 8), (0, 2, 5)])
    for kernel, want in (("linear", 6.0), ("sqexp", 0.56878), ("polynomial", 2436.5)):
        assert distances.mmd(a, b, kernel) == pytest.approx(want, abs=1e-5)


def test_mahalanobis(spark):
    assert distances.mahalanobis_split_distance(vectors(spark, [(1, 3), (3, 3)]), vectors(spark, [(4, 4), (4, 6)])) == pytest.approx(9.0)


def test_friedman_p_values():
    assert special.chi2_sf(8.098360655737705, 2) == pytest.approx(0.017436661128762587, rel=1e-9)
    assert special.chi2_sf(10.57142857142857, 2) == pytest.approx(0.005063414171757498, rel=1e-9)
    assert special.chi2_sf(2.48, 4) == pytest.approx(0.6482206481834754, rel=1e-9)
    assert special.f_sf(4.0, 2, 10) == pytest.approx(0.0528, abs=2e-4)


def test_studentized_range():
    assert special.range_quantile(0.95, 3) == pytest.approx(3.314, abs=2e-3)
    assert special.range_quantile(0.95, 4, 16) == pytest.approx(4.046, abs=3e-3)
    assert special.range_cdf(special.range_quantile(0.9, 5), 5) == pytest.approx(0.9, abs=1e-6)


def test_friedman_statistic(spark):
    df = long_of(spark, FRIEDMAN_A)
    r = ranking.friedman(df, "block", "grp", "v").first()
    ranks = {x["grp"]: x["rank_sum"] for x in ranking.average_ranks(df, "block", "grp", "v").collect()}
    assert ranks == {"g0": 33.5, "g1": 39.0, "g2": 23.5} and (r["n"], r["k"]) == (16, 3)
    assert r["q"] == pytest.approx(8.098360655737705) and r["p"] == pytest.approx(0.017436661128762587)
    b = ranking.friedman(long_of(spark, FRIEDMAN_B), "block", "grp", "v").first()
    assert b["q"] == pytest.approx(10.57142857142857) and b["iman_f"] == pytest.approx(6 * b["q"] / (14 - b["q"]))
    # A block that lacks a group does not count.
    more = df.union(spark.createDataFrame([("late", "g0", 1.0)], df.schema))
    assert ranking.friedman(more, "block", "grp", "v").first()["n"] == 16


def test_topsis(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 2.0)], "d string, m string, c double")
    up = {r["m"]: (r["score"], r["rank"]) for r in ranking.topsis(df, ["d"], {"c": (1.0, True)}).collect()}
    assert up == {"a": (0.0, 2.0), "b": (1.0, 1.0)}
    down = {r["m"]: r["rank"] for r in ranking.topsis(df, ["d"], {"c": (1.0, False)}).collect()}
    assert down == {"a": 1.0, "b": 2.0}
    tie = spark.createDataFrame([("d", m, v) for m, v in (("a", 1.0), ("b", 1.0), ("c", 3.0))], "d string, m string, c double")
    assert sorted(r["rank"] for r in ranking.moora(tie, ["d"], {"c": (2.0, True)}).collect()) == [1.0, 2.5, 2.5]
    with pytest.raises(ValueError):
        ranking.topsis(df, ["d"], {"c": (-1.0, True)})


def test_tukey_corrected_p_agrees_with_the_interval(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in {"a": (6, 8, 4, 5, 3), "b": (8, 12, 9, 11, 6), "c": (13, 9, 11, 8, 7)}.items() for v in vs], "g string, v double")
    for r in ranking.tukey_hsd(df, "g", "v").collect():
        assert (r["p_corrected"] < 0.05) == (r["low"] > 0 or r["high"] < 0)


def test_published_tukey_intervals(spark):
    nist = {"G1": (6.9, 5.4, 5.8, 4.6, 4.0), "G2": (8.3, 6.8, 7.8, 9.2, 6.5), "G3": (8.0, 10.5, 8.1, 6.9, 9.3), "G4": (5.8, 3.8, 6.1, 5.6, 6.2)}
    rows = lambda groups: spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {(r["group1"], r["group2"]): (r["low"], r["high"]) for r in ranking.tukey_hsd(rows(nist), "g", "v").collect()}
    want = {("G1", "G2"): (0.29, 4.47), ("G1", "G3"): (1.13, 5.31), ("G1", "G4"): (-1.93, 2.25), ("G2", "G3"): (-1.25, 2.93), ("G2", "G4"): (-4.31, -0.13), ("G3", "G4"): (-5.15, -0.97)}
    assert got.keys() == want.keys()
    for pair, ends in want.items():
        assert got[pair] == pytest.approx(ends, abs=0.05)
    three = {"G0": (24.5, 23.5, 26.4, 27.1, 29.9), "G1": (28.4, 34.2, 29.5, 32.2, 30.1), "G2": (26.1, 28.3, 24.3, 26.2, 27.8)}
    got = {(r["group1"], r["group2"]): (r["low"], r["high"]) for r in ranking.tukey_hsd(rows(three), "g", "v", 0.01).collect()}
    for pair, ends in {("G0", "G1"): (-0.280, 9.480), ("G0", "G2"): (-4.620, 5.140), ("G1", "G2"): (-9.220, 0.540)}.items():
        assert got[pair] == pytest.approx(ends, abs=0.05)


def sequential_spheres(nodes, edges):
    """Take the free row with most neighbours, ties by least key, and its free neighbours."""
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for c in sorted(nodes, key=lambda n: (-len(near[n]), n)):
        if c not in out:
            out |= {n: c for n in near[c] | {c} if n not in out}
    return out


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_butina_is_the_sequential_rule(spark, seed):
    import random

    if seed is None:
        nodes, edges = range(1, 16), [(1, 2), (1, 10), (1, 11), (1, 12), (2, 3), (2, 13), (3, 5), (3, 14), (4, 5), (4, 15)]
    else:
        r = random.Random(seed)
        nodes = range(60)
        edges = list({tuple(sorted(r.sample(range(60), 2))) for _ in range(40 * seed)})
    both = [e for a, b in edges for e in ((a, b), (b, a))]
    got = clustering.butina(spark.createDataFrame([(n,) for n in nodes], "vec_id long"), spark.createDataFrame(both, "a long, b long"))
    assert {r["vec_id"]: r["centroid"] for r in got.collect()} == sequential_spheres(nodes, edges)


@pytest.mark.parametrize("metric", ["euclidean", "jaccard", "cityblock"])
def test_neighbours_against_brute_force(spark, monkeypatch, metric):
    import numpy as np

    monkeypatch.setattr(clustering, "ROWS_PER_BLOCK", 15)
    x = np.random.default_rng(4).integers(0, 4, (150, 3)).astype(float)
    x[:40] = x[0]  # a third of the rows alike
    threshold = {"euclidean": 1.0, "jaccard": 0.25, "cityblock": 1.0}[metric]
    d = distances.block_distances(metric, x, x)
    want = {(i, j) for i in range(150) for j in range(150) if i != j and d[i, j] <= threshold + 1e-12}
    got = [tuple(r) for r in clustering.neighbours(vectors(spark, x.tolist()), threshold, metric=metric).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert clustering.neighbours(vectors(spark, [(1, 1)]).limit(0), 1.0).count() == 0


def test_ties_of_nearest_rows_go_by_key(spark):
    df = vectors(spark, [(1, 1)] * 30).repartition(3)
    got = distances.k_nearest(df.filter("vec_id = 0"), df, 3)
    assert sorted(r["vec_id"] for r in got.collect()) == [1, 2, 3]


def test_butina(spark):
    df = vectors(spark, [(1, 1, 0), (1, 1, 0), (0, 0, 1), (0, 0, 1), (9, 9, 9)])
    for threshold, n in ((0.0, 3), (2.0, 2)):
        got = clustering.butina(df, clustering.neighbours(df, threshold))
        assert got.count() == 5 and got.select("centroid").distinct().count() == n
    small = clustering.merge_small(clustering.butina(df, clustering.neighbours(df, 0.0)), df, 2)
    assert sorted(r["count"] for r in small.groupBy("centroid").count().collect()) == [2, 3]
    same = clustering.merge_small(clustering.butina(df, clustering.neighbours(df, 0.0)), df, 9)
    assert same.select("centroid").distinct().count() == 3


def test_maximin(spark):
    df = vectors(spark, [(0, 0), (1, 0), (10, 0)])
    assert {r["vec_id"] for r in clustering.maximin_design(df, 2).collect()} == {0, 2}


def test_splits(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    got = splits.random_split(df, "k", 0.8)
    assert got.filter("part = 'train'").count() == 16 and got.count() == 20
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 21))
    t = splits.time_split(spark.range(5), "id", 0.6)
    assert t.filter("part = 'train'").count() == 2
    folds = splits.repeated_folds(df, "k", 3, 2)
    assert sorted(r["count"] for r in folds.groupBy("rep", "fold").count().collect()) == [6, 6, 7, 7, 7, 7]
    with pytest.raises(ValueError, match="known"):
        splits.make_splitter("nope")
    with pytest.raises(ValueError):
        splits.random_split(df, "k", 1.0)


def test_domains(spark):
    train = vectors(spark, [(1, 2, 3, 4), (2, 1, 3, 5), (2, 2, 2, 4), (1, 1, 3, 4.5), (1.5, 2, 2.5, 5)])
    rows = vectors(spark, [(1.5, 1.5, 2.5, 4.5), (-90, 80, -70, 60)], 10)
    for got in (distances.bounding_box_scores(train, rows), distances.leverage_domain(train, rows), distances.knn_domain(train, rows, k=2, metric="euclidean", z=3.0)):
        assert {r["vec_id"]: r["in_domain"] for r in got.collect()} == {10: True, 11: False}


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 1.0), ("b", 3.0, 2.0), ("c", 1.0, 1.0), ("c", 2.0, 3.0), ("c", 3.0, 2.0)], "g string, y_true double, y_pred double")
    r = {x["g"]: x for x in metrics.fold_metrics(df, ["g"]).collect()}
    assert math.isnan(r["a"]["rmse"]) and r["a"]["n"] == 1
    assert math.isnan(r["b"]["r2"]) and math.isnan(r["b"]["pearson"]) and r["b"]["mae"] == 1.5
    assert r["c"]["spearman"] == pytest.approx(0.5)
    k = {x["g"]: x["kendall"] for x in metrics.kendall(df, ["g"]).collect()}
    assert math.isnan(k["a"]) and math.isnan(k["b"]) and k["c"] == pytest.approx(1 / 3)


def test_missing_values_propagate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", float("nan"))], "g string, v double")
    assert {r["g"]: r["v"] for r in summaries.merge_runs(df, ["g"], ["v"]).collect()}["a"] is None
    c = {r["g"]: r["v"] for r in summaries.collapsed(df, ["g"], "v").collect()}
    assert c == {"a": 1.0, "b": 1.0}
    s = {r["g"]: r["range"] for r in summaries.spread(df.filter("g = 'b' AND isnan(v)"), "g", "v").collect()}
    assert s == {"b": 0.0}


def test_pivot_refuses_repeated_cells(spark):
    df = spark.createDataFrame([("r", "x", 1.0), ("r", "x", 2.0)], "r string, c string, v double")
    with pytest.raises(Exception, match="several values"):
        summaries.pivoted(df, "r", "c", ["x"], "v").collect()


def test_selection(spark):
    df = spark.createDataFrame([("f", "a", 1.0, 5.0), ("f", "b", 2.0, 4.0), ("f", "c", 3.0, float("nan"))], "f string, model string, cv double, loss double")
    marked = selection.champions(df, ["f"], "cv")
    q = selection.selection_quality(marked, ["f"], "loss").first()
    assert (q["n"], q["mean_advantage"], q["hit"]) == (2, -1.0, False)
    rounds = {r["model"]: r["round_eliminated"] for r in selection.halving_rounds(df, ["f"], "cv").collect()}
    assert rounds == {"a": 0, "b": 2, "c": 1}


def test_loaders(spark, tmp_path):
    (tmp_path / "t_training.csv").write_text("MOLECULE,Act,D_1,D_2,D_3,D_4\nm1,1.5,1,2,3,4\n")
    (tmp_path / "t_test.csv").write_text("MOLECULE,Act,D_3,D_1,D_2,D_9\nm2,2.5,3,1,2,7\n")
    train, test = loaders.train_and_test(spark, f"{tmp_path}/t_training.csv", f"{tmp_path}/t_test.csv")
    assert train.first()["features"] == [1, 2, 3, 4] and test.first()["features"] == [1, 2, 3, 0]
    with pytest.raises(FileNotFoundError):
        loaders.resolve_csv(spark, f"{tmp_path}/none.csv")
    dates = spark.createDataFrame([("1102NS11",), ("0004NS35",), ("bad",)], "c string").select(loaders.experiment_date(F.col("c")).cast("string")).collect()
    assert [d[0] for d in dates] == ["2011-02-01", "2000-04-01", None]
    names = spark.createDataFrame([("A_training.csv",), ("A_test.csv",), ("B_training_disguised.csv",), ("x.csv",)], "file string")
    assert [r[0] for r in loaders.dataset_names(names).collect()] == ["A"]
    assert [r[0] for r in loaders.dataset_names(names, disguised=True).collect()] == ["A", "B"]


def test_config_defaults():
    c = loaders.load_config('datasets = ["A"]\nfrac = 0.7\n[model]\nn_runs = 3\nextra = 1\n')
    assert (c.seed, c.ratios, c.repeats, c.k_folds, c.tpe_budget, c.ad_k, c.ad_z, c.n_runs, c.rest) == (42, (0.7,), 5, 5, 50, 5, 1.5, 3, {"extra": 1})


def test_sinks(spark, tmp_path):
    df = spark.range(6).withColumn("g", F.col("id") % 2)
    sinks.write_results(df, f"{tmp_path}/r", ["g"])
    sinks.append_new(spark, df, f"{tmp_path}/a", ["id"])
    sinks.append_new(spark, df.union(spark.createDataFrame([(9, 1)], df.schema)), f"{tmp_path}/a", ["id"])
    assert spark.read.parquet(f"{tmp_path}/r").count() == 6 and spark.read.parquet(f"{tmp_path}/a").count() == 7
    with pytest.raises(ValueError):
        sinks.check_counts(df, ["g"], 4)
    both = loaders.shards(spark, [f"{tmp_path}/r", f"{tmp_path}/none", f"{tmp_path}/a"], ["id"])
    assert both.count() == 13


def test_streaming_agrees_with_batch(spark, tmp_path):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.5), ("b", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, y_true double, y_pred double")
    df.write.parquet(f"{tmp_path}/in")
    stream = incremental.streaming_errors(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["g"])
    q = stream.writeStream.format("memory").queryName("errors").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("errors").collect()))
    assert got == sorted(map(tuple, incremental.streaming_errors(df, ["g"]).collect()))


def test_binary_quality(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "t int, p int")
    r = models.binary_quality(df, "t", "p").first()
    assert r["accuracy"] == 0.75 and r["mcc"] == pytest.approx(2 / math.sqrt(12))


def test_k_nearest_in_parts(spark, monkeypatch):
    """More queries than are sent at once are answered in parts, with the same result."""
    from evalforge.operators import distances

    df = spark.createDataFrame([(i, [float(i * i % 37), float(i % 11)]) for i in range(60)], "vec_id long, x array<double>")
    want = sorted(map(tuple, distances.k_nearest(df, df, 2).collect()))
    monkeypatch.setattr(distances, "MAX_QUERIES", 25)
    assert len(want) == 120 and sorted(map(tuple, distances.k_nearest(df, df, 2).collect())) == want


def test_kernel_queries_in_parts(spark, monkeypatch):
    a, b = vectors(spark, [(i, i * i % 5) for i in range(40)]), vectors(spark, [(i % 7, 1) for i in range(30)])
    want = distances.mean_kernel(a, b)
    monkeypatch.setattr(distances, "MAX_QUERIES", 9)
    assert distances.mean_kernel(a, b) == pytest.approx(want, rel=1e-12)
    with pytest.raises(ValueError):
        distances.mean_kernel(a, b, "none")


def test_tanimoto_domain(spark):
    bits = lambda sets: spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "k long, bit int")
    train = {1: (1, 2, 3), 2: (1, 2, 4), 3: (1, 2, 3, 4), 4: (2, 3, 4)}
    got = {r["k"]: (r["score"], r["in_domain"]) for r in distances.tanimoto_domain(bits(train), bits({10: (1, 2, 3), 11: (7, 8, 9)}), "k").collect()}
    assert got == {10: (1.0, True), 11: (0.0, False)}
    assert distances.hausdorff(vectors(spark, [(0, 0), (1, 0)]), vectors(spark, [(0, 0), (5, 0)], 10)).first()[0] == 4.0


def test_nemenyi_of_published_ranks(spark):
    df = long_of(spark, FRIEDMAN_B)
    got = {(r["grp1"], r["grp2"]): r for r in ranking.nemenyi(df, "block", "grp", "v").collect()}
    one = got["g0", "g1"]
    assert (one["rank1"], one["rank2"]) == pytest.approx((10 / 7, 3.0)) and one["significant"] and one["p_value"] < 0.05
    assert all(r["significant"] == (r["p_value"] < 0.05) for r in got.values())
    up = {(r["grp1"], r["grp2"]): r["rank1"] for r in ranking.nemenyi(df, "block", "grp", "v", higher_better=True).collect()}
    assert up["g0", "g1"] == pytest.approx(4 - 10 / 7)
    minus = df.withColumn("v", -F.col("v"))
    same = {(r["grp1"], r["grp2"]): r["rank1"] for r in ranking.nemenyi(minus, "block", "grp", "v", absolute=True).collect()}
    assert same == {k: r["rank1"] for k, r in got.items()}
    few = ranking.nemenyi(df.filter("block = 'b0'"), "block", "grp", "v").collect()
    assert len(few) == 3 and all(math.isnan(r["difference"]) and not r["significant"] and r["p_value"] == 1.0 for r in few)
    f, p, pairs = ranking.nemenyi_after_iman(df, "block", "grp", "v")
    assert p < 0.05 and f > 1 and pairs.count() == 3
    assert ranking.nemenyi_after_iman(df, "block", "grp", "v", alpha=1e-9)[2] is None
    assert [r[2] for r in ranking.bar_rows([(1, 2), (1.5, 3), (4, 5), (2.5, 4.5)])] == [1.0, 1.25, 1.0, 1.5]


def test_homogeneous_spans(spark):
    ranks = spark.createDataFrame([("a", 1.0), ("b", 1.5), ("c", 2.4), ("d", 4.0), ("e", 4.5)], "m string, avg_rank double")
    got = {(r["first"], r["last"]) for r in ranking.homogeneous_spans(ranks, "m", 1.0).collect()}
    assert got == {("a", "b"), ("b", "c"), ("d", "e")}


def test_matrix_of_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 3.0)], "x string, y string, v double")
    cells = lambda **o: {(r["row"], r["column"]): r["value"] for r in ranking.pairs_to_matrix(pairs, "x", "y", "v", **o).collect()}
    m = cells()
    assert len(m) == 9 and m["b", "a"] == 2.0 and m["a", "b"] == -2.0 and m["a", "a"] == 0.0 and math.isnan(m["b", "c"])
    assert cells(mode="symmetric", diagonal=1.0)["a", "b"] == 2.0 and math.isnan(cells(mode="copy")["a", "b"])
    order = ranking.pairs_to_matrix(pairs, "x", "y", "v", order=["c", "z"]).filter("j = 1").orderBy("i").collect()
    assert [r["row"] for r in order] == ["c", "z", "a", "b"]
    with pytest.raises(ValueError):
        ranking.pairs_to_matrix(pairs, "x", "y", "v", mode="none")


def test_ranking_views(spark):
    rows = [(d, s, m, v, g, m == "r2") for d in ("d1", "d2") for s, m, v, g in (("a", "rmse", 1.0, 0.9), ("a", "r2", 0.9, 0.8), ("b", "rmse", 2.0, 0.1), ("b", "r2", 0.5, 0.1))]
    rows += [("d3", "a", "rmse", 1.0, 0.5, False), ("d1", "c", "rmse", 0.1, 0.0, False), ("d1", "c", "r2", None, 0.0, True)]
    a = spark.createDataFrame(rows, "dataset string, splitter string, metric string, ips double, diff double, higher_better boolean")
    got = {(r["splitter"], r["method"]): r for r in ranking.ranking_views(a, "performance").collect()}
    assert set(got) == {(s, m) for s in "ab" for m in ("TOPSIS", "MOORA")} and all(r["n_datasets"] == 2 for r in got.values())
    assert got["a", "TOPSIS"]["mean_rank"] == 1.0 and got["a", "TOPSIS"]["mean_score"] == pytest.approx(1.0)
    cred = {(r["splitter"], r["method"]): r["mean_rank"] for r in ranking.ranking_views(a, "credibility").collect()}
    assert cred["b", "TOPSIS"] == 1.0 and cred["c", "TOPSIS"] == 1.0 or cred["c", "TOPSIS"] < cred["b", "TOPSIS"]
    x = spark.createDataFrame([(s, float(i)) for i, s in enumerate("abcdef")], "splitter string, mean_rank double")
    same = ranking.compare_rankings(x, x.withColumn("mean_rank", F.col("mean_rank") * 2)).first()
    assert (same["rho"], same["top_same"], same["bottom_same"]) == (pytest.approx(1.0), True, True)
    back = ranking.compare_rankings(x, x.withColumn("mean_rank", -F.col("mean_rank"))).first()
    assert (back["rho"], back["top_same"], back["bottom_same"]) == (pytest.approx(-1.0), False, False)


def test_fold_report(spark):
    from evalforge.plans.bindings import TIES

    rows = [("a", i, 1, 1, None, float(i), float((i * 7) % 5)) for i in range(10)] + [("b", 0, 1, 1, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, sample_id int, l_partkey int, l_suppkey int, l_shipdate date, y_true double, y_pred double")
    r = {x["g"]: x for x in metrics.fold_report(df, ["g"], TIES).collect()}
    k = metrics.kendall(df, ["g"]).filter("g = 'a'").first()["kendall"]
    assert r["a"]["kendall"] == k and r["a"]["ef20"] == metrics.top_k_enrichment(df, ["g"], (0.2,), TIES).filter("g = 'a'").first()["ef20"]
    assert r["b"]["n"] == 1 and all(math.isnan(r["b"][c]) for c in ("rmse", "kendall", "ef5", "bedroc"))


def test_time_split_by_ranges(spark, monkeypatch):
    df = spark.range(500).select(F.col("id"), (F.col("id") * F.col("id") % 83).alias("t"))
    want = sorted(map(tuple, splits.time_split(df, "t", 0.6).collect()))
    monkeypatch.setattr(splits, "ROWS_PER_BUCKET", 20)
    assert sorted(map(tuple, splits.time_split(df, "t", 0.6).collect())) == want
    cutoff = sorted(r[1] for r in want)[299]
    assert all((r[2] == "train") == (r[1] < cutoff) for r in want)
    assert sorted(r["rank"] for r in splits.shuffled_rank(df, "id", "s").collect()) == list(range(1, 501))


def test_more_loaders(spark, tmp_path):
    split = spark.createDataFrame([(1, 1, k, "train" if k < 3 else "test") for k in range(5)], "rep int, fold int, sample_id int, part string")
    data = spark.range(5).select(F.col("id").cast("int").alias("sample_id"))
    ids = lambda df: sorted(r["sample_id"] for r in df.collect())
    assert ids(loaders.rows_of_split(data, split, "test", rep=1, fold=1)) == [3, 4]
    assert ids(loaders.outer_subset(data, split, 1, 1)) == [0, 1, 2]
    drawn = spark.createDataFrame([(1, 1, 2)], "rep int, fold int, sample_id int")
    assert ids(loaders.outer_subset(data, split, 1, 1, drawn)) == [2]
    inner = spark.createDataFrame([(1, 1, 0, "valid")], "rep int, fold int, sample_id int, part string")
    assert {r["sample_id"]: r["inner_part"] for r in loaders.each_split(split, inner).collect()} == {0: "valid", 1: None, 2: None, 3: None, 4: None}
    assert loaders.load_fold(split, rep=1).count() == 5
    with pytest.raises(LookupError):
        loaders.load_fold(split, rep=2)
    split.union(split).write.parquet(f"{tmp_path}/meta")
    assert loaders.champion_meta(spark, [f"{tmp_path}/meta", f"{tmp_path}/none"], ["rep", "part"]).count() == 2
    (tmp_path / "m.csv").write_text("fold,rmse\n1,0.5\n2,0.6\n")
    m = loaders.metrics_table(spark, {"a": f"{tmp_path}/m.csv", "b": f"{tmp_path}/none.csv"}, "fold int, rmse double", 2)
    assert [(r["algorithm"], r["complete"]) for r in m.collect()] == [("a", True)] * 2
    assert loaders.metrics_table(spark, {}, "fold int", 2).count() == 0
    (tmp_path / "c.csv").write_text("sample_id,cluster\nx,1\ny,2\n")
    assert sorted(map(tuple, loaders.assignments(spark, f"{tmp_path}/c.csv").collect())) == [("x", 1), ("y", 2)]
    (tmp_path / "bad.csv").write_text("sample_id,cluster\nx,0\n")
    with pytest.raises(Exception, match="numbered"):
        loaders.assignments(spark, f"{tmp_path}/bad.csv").collect()
    df = spark.createDataFrame([(1, 2.0, None)], "k int, a double, b double")
    assert loaders.compacted(df, ["a", "z"]).dtypes == [("k", "int"), ("a", "float"), ("b", "double")]
    assert loaders.prefixed(df, "internal_", ["k"]).columns == ["k", "internal_a", "internal_b"]
    assert loaders.not_null(df, "a").count() == 1
    with pytest.raises(Exception, match="null in b"):
        loaders.not_null(df, "b").collect()
    (tmp_path / "split_umap-kmeans_lightgbm.tsv").write_text("s\tmax_rss\n1\t2\n")
    (tmp_path / "gather_kmeans.tsv").write_text("s\tmax_rss\n3\t4\n")
    logs = {r["key"]: (r["splitter"], r["model"]) for r in loaders.job_logs(spark, f"{tmp_path}/*.tsv", ["kmeans", "umap-kmeans"], ["lightgbm", "knn"]).collect()}
    assert logs == {"split_umap-kmeans_lightgbm": ("umap-kmeans", "lightgbm"), "gather_kmeans": ("kmeans", "*")}
    assert loaders.experiment_paths("/r/", "D", "random", 0.8, 1, 2)["splits"] == "/r/splits/dataset=D/splitter=random/ratio=0.8/rep=1/fold=2"


def test_assays_and_arrow(spark, tmp_path):
    import pyarrow as pa

    a = spark.createDataFrame([("C", "2020-01-01", "2021-01-01", 1.0), ("N", "2020-01-01", None, 2.0), (None, "2020-01-01", None, 3.0), ("O", None, None, 4.0)], "SMILES string, ORDER_DATE string, SHIPMENT_DATE string, target double")
    assert sorted(map(tuple, loaders.assay(a).collect())) == [("C", "2021-01-01", 1.0), ("N", "2020-01-01", 2.0)]
    with pytest.raises(ValueError):
        loaders.assay(a.drop("target"))
    act = spark.createDataFrame([(1, "p", 1, "x", 5.0), (1, "p", 2, "x", 6.0), (2, "p", 1, "x", None)], "NSC int, PANEL string, RELEASE_DATE int, EXPID string, AVERAGE double")
    s = spark.createDataFrame([("1", "CC"), ("2", "CN")], "NSC string, SMILES string")
    assert [(r["NSC"], r["NLOGGI50_N"]) for r in loaders.latest_activity(act, s, "PANEL").collect()] == [("1", 6.0)]
    with pa.OSFile(f"{tmp_path}/a.arrow", "wb") as f, pa.ipc.new_file(f, pa.schema([("k", pa.int64())])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array([1, 2])], ["k"]))
        w.write_batch(pa.RecordBatch.from_arrays([pa.array([3])], ["k"]))
    assert sorted(r["k"] for r in loaders.arrow_files(spark, [f"file://{tmp_path}/a.arrow"], "k long").collect()) == [1, 2, 3]


def test_more_sinks(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "k")
    folds = sinks.build_folds(df, f"{tmp_path}/cv", "k", 4, 2, dataset="D")
    assert folds.count() == 40 and folds.groupBy("rep", "fold").count().filter("count = 5").count() == 8
    assert '"dataset": "D"' in spark.read.text(f"{tmp_path}/cv/meta").first()[0]
    good = spark.createDataFrame([("a", 1), ("a", 2)], "g string, v int")
    good.write.parquet(f"{tmp_path}/good")
    good.limit(1).write.parquet(f"{tmp_path}/short")
    paths = [f"{tmp_path}/{x}" for x in ("good", "short", "none")]
    for _ in range(2):  # the second time adds nothing
        done, left = sinks.consolidate(spark, paths, f"{tmp_path}/all", ["g"], 2)
        assert done == paths[:1] and left == paths[1:] and spark.read.parquet(f"{tmp_path}/all").count() == 2
    sinks.write_csv(good, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2


def test_learners(spark):
    df = spark.range(240).select(
        F.col("id").alias("vec_id"), F.array(*[((F.col("id") * p) % 17 / 17.0) for p in (3, 5, 7)]).alias("x"), (F.col("id") % 3 + 1).cast("int").alias("fold")
    )
    df = df.withColumn("y", 2 * F.col("x")[0] - F.col("x")[1]).withColumn("c", (F.col("y") > 0.5).cast("int"))
    out = models.select_champion(df, "fold", ["elasticnet", "forest"], budget=4, keep=(2, 1, 1), first=2)
    best = next(r for r in out if r["is_champion"])
    assert best["learner"] == "elasticnet" and best["cv_rms"] < 0.05 and best["round_eliminated"] == 0
    assert [r["round_eliminated"] for r in out if not r["is_champion"]] == [2]
    again = models.fit_predict(df.filter("fold > 1"), df.filter("fold = 1"), "elasticnet", **best["params"])
    assert again.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("y_pred"), 2)))).first()[0] < 0.05
    runs = models.train_runs(df.filter("fold > 1"), {"test": df.filter("fold = 1"), "ips": df.limit(5)}, "elasticnet", 2)
    assert {(r["set"], r["run"]) for r in runs.select("set", "run").distinct().collect()} == {(s, r) for s in ("test", "ips") for r in (1, 2)}
    assert runs.count() == 2 * (80 + 5)
    c = models.fit_classes(df.filter("fold > 1"), df.filter("fold = 1"), "c")
    assert models.binary_quality(c, "c", "y_pred").first()["accuracy"] > 0.9


def test_composites(spark):
    from evalforge.operators import composites

    rows = []
    for i in range(12):
        for model, err, champ in (("a", 0.1, True), ("b", 0.5, False), ("c", 0.3, False)):
            for s in ("test", "ips"):
                rows.append(("d", "r", 1, 1, s, i, model, champ, float(i), float(i) + err * (1 + i % 3), i % 4 != 0 if i < 11 else None, float(i)))
    rows.append(("d", "r", 1, 1, "ips", 99, "a", True, None, 1.0, True, None))
    spec = "dataset string, splitter string, rep int, fold int, `set` string, sample_id int, model string, is_champion boolean, y_true double, y_pred double, in_domain boolean, nn_dist_to_train double"
    pred = spark.createDataFrame(rows, spec)
    one = composites.ad_summary(pred.filter("model = 'a'"), ["sample_id"])
    assert set(one) == {"fold_reports", "coverage", "metrics_by_domain", "metrics_in_domain", "distances"}
    r = {x["set"]: x for x in one["fold_reports"].collect()}
    assert r["ips"]["n"] == 12 and r["test"]["spearman"] == pytest.approx(1.0) and r["ips"]["algorithm"] == "r"
    assert tuple(one["coverage"].select("n", "n_in").first()) == (13, 9)
    assert {x["in_domain"]: x["n"] for x in one["metrics_by_domain"].collect()} == {True: 9, False: 3} and one["distances"].count() == 12
    assert one["metrics_in_domain"].first()["n"] == 8
    meta = spark.createDataFrame([("d", "r", 1, 1, m, m == "a", v) for m, v in (("a", 0.1), ("b", 0.2), ("a", 0.1))], "dataset string, splitter string, rep int, fold int, model string, is_champion boolean, cv_rms double")
    two = composites.champion_summary(pred.filter("y_true IS NOT NULL"), meta)
    assert [tuple(x) for x in two["champions"].collect()] == [("d", "r", 1, 1, "a", 0.1)]
    assert two["fold_selection"].first()["hit"] and two["hit_rates"].first()["hit_rate"] == 1.0
    assert {x["model"]: x["cv_rms"] for x in two["fold_metrics"].collect()} == {"a": 0.1, "b": 0.2, "c": None}
    inside = [i for i in range(12) if i % 4 and i < 11]
    size = math.sqrt(sum((1 + i % 3) ** 2 for i in inside) / len(inside))
    assert two["ips_advantage"].first()["ips_adv_rmse"] == pytest.approx(0.2 * size)
    assert two["selection_by_dataset"].first()["mean_advantage"] == pytest.approx(0.3 * math.sqrt(sum((1 + i % 3) ** 2 for i in range(12)) / 12))
