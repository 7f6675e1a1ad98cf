"""The driver contract: names, schemas, and equal rows for a few queries."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_entry_runs(spark, sf):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["layer1_summary", "selection_quality", "topsis", "time_split", "k_nearest"])
def test_rows_agree_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = lambda df: sorted((tuple(("nan" if v != v else round(v, 5)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    a, b = key(got), key(want)
    assert all(x == y or all(p == q or abs(p - q) < 1e-4 for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))
