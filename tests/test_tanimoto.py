"""Nearest Tanimoto sets against all pairs, and what a bit that all rows hold costs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evalforge.operators import distances
from evalforge.operators.splits import range_rank


def nearest(queries: dict, rows: dict) -> dict:
    sim = lambda a, b: len(a & b) / len(a | b)
    return {q: max((sim(s, t) for k, t in rows.items() if k != q), default=0.0) for q, s in queries.items()}


def table(spark, sets: dict):
    return spark.createDataFrame([(k, b) for k, s in sets.items() for b in sorted(s)], "k long, bit long")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(distances, "TANIMOTO_SAMPLE", 3)
    draw = random.Random(seed)
    rows = {i: {0} | {int(60 * draw.random() ** 2) for _ in range(draw.choice([1, 4, 9, 20]))} for i in range(120)}
    rows |= {200 + i: set(rows[i]) | {i + 70} for i in range(10)} | {300: {999}, 301: set(rows[5])}
    queries = {i: rows[i] for i in (*range(0, 60), *range(200, 205), 300, 301)} | {900: {5000, 5001}, 901: {0, 5000}}
    got = {r["query"]: r["similarity"] for r in distances.nn_tanimoto(table(spark, queries), table(spark, rows), "k").collect()}
    assert got == pytest.approx(nearest(queries, rows))


def test_a_bit_of_all_rows_is_not_looked_up(spark):
    """400 sets of a common bit and three of their own: no pair shares two bits, so none is a candidate."""
    rows = {i: {0, 3 * i + 1, 3 * i + 2, 3 * i + 3} for i in range(400)}
    df = table(spark, rows)
    ranks = range_rank(df.groupBy("bit").count(), F.asc("count"), F.asc("bit")).select("bit", "rank")
    sets = distances.bit_sets(df, ranks, "k", "bit")
    asked = sets.withColumnRenamed("k", "query").withColumn("best", F.lit(1 / 7))
    assert distances.tanimoto_candidates(asked, sets, F.col("best"), 1 / 7).count() == 0
    got = distances.nn_tanimoto(df, df, "k").collect()
    assert len(got) == 400 and all(r["similarity"] == pytest.approx(1 / 7) for r in got)
    assert distances.nn_tanimoto(df.limit(0), df, "k").count() == 0
    assert distances.nn_tanimoto(df.filter("k = 1"), df.filter("k = 1"), "k").first()["similarity"] == 0


@pytest.mark.parametrize("bits, turns", [(40, 1000), (40, 1)])
def test_turns_and_index_equal_all_pairs(spark, monkeypatch, bits, turns):
    monkeypatch.setattr(distances, "TANIMOTO_BITS", bits)
    monkeypatch.setattr(distances, "TANIMOTO_TURNS", turns)
    draw = random.Random(4)
    rows = {i: {0} | {int(40 * draw.random() ** 2) for _ in range(draw.choice([1, 4, 9]))} for i in range(60)} | {99: {777}}
    got = {r["query"]: r["similarity"] for r in distances.nn_tanimoto(table(spark, rows), table(spark, rows), "k").collect()}
    assert got == pytest.approx(nearest(rows, rows))


def test_no_pair_is_written(spark, monkeypatch):
    """120 sets that share 30 common bits: what is written has a row a set or query, not one a pair."""
    written = []
    monkeypatch.setattr(distances, "materialise", lambda df: written.append(df.count()) or df)
    rows = {i: set(range(30)) | {100 + i, 300 + i} for i in range(120)}
    got = distances.nn_tanimoto(table(spark, rows), table(spark, rows), "k").collect()
    assert len(got) == 120 and all(r["similarity"] == pytest.approx(30 / 34) for r in got) and max(written) <= 120
