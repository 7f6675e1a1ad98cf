"""Arrow files as a data source: batches, columns and filters."""

from __future__ import annotations

import contextlib
import io

import pyarrow as pa
import pytest

from evalforge.sources.arrow_source import arrow_scan


@pytest.fixture(scope="module")
def uris(tmp_path_factory):
    root, out = tmp_path_factory.mktemp("arrow"), []
    for f in range(2):
        path = root / f"{f}.arrow"
        t = pa.table({"k": pa.array(range(f * 100, f * 100 + 100)), "s": pa.array([None if i % 10 == 0 else f"n{i % 7}" for i in range(100)]), "v": pa.array([float("nan") if i == 5 else i / 2 for i in range(100)]), "big": ["x" * 50] * 100})
        with pa.ipc.new_file(str(path), t.schema) as w:
            w.write_table(t, max_chunksize=10)
        out.append(f"file://{path}")
    return out


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("formatted")
    return said.getvalue()


def test_a_file_is_read_by_several_tasks(spark, uris):
    df = arrow_scan(spark, uris, batches=3)
    assert df.rdd.getNumPartitions() == 8 and df.count() == 200
    assert df.columns == ["k", "s", "v", "big"]


def test_columns_and_filters_reach_the_reader(spark, uris):
    df = arrow_scan(spark, uris, ["k", "s"]).filter("k >= 150 AND k < 180 AND s = 'n3'")
    assert df.columns == ["k", "s"] and "PushedFilters" in plan(df) and "GreaterThanOrEqual(k,150)" in plan(df).replace(" ", "").replace("#", "")
    assert sorted(r["k"] for r in df.collect()) == [100 + i for i in range(50, 80) if i % 10 and i % 7 == 3]
    assert arrow_scan(spark, uris, ["k"]).filter("k IN (1, 199, 500)").count() == 2
    assert arrow_scan(spark, uris, ["s"]).filter("s IS NULL").count() == 20
    assert arrow_scan(spark, uris, ["s"]).filter("s <=> NULL OR s = 'n1'").count() == 20 + sum(i % 10 != 0 and i % 7 == 1 for i in range(100)) * 2
    assert arrow_scan(spark, uris, ["s", "k"]).filter("s LIKE 'n2%' AND k < 100").count() == sum(i % 10 != 0 and i % 7 == 2 for i in range(100))


def test_fractions_are_compared_by_spark(spark, uris):
    """Not-a-number is above all numbers there."""
    assert arrow_scan(spark, uris, ["v"]).filter("v > 45").count() == 2 * (sum(i / 2 > 45 for i in range(100)) + 1)


def test_unknown_columns(spark, uris):
    with pytest.raises(Exception, match="columns lack"):
        arrow_scan(spark, uris, ["none"]).count()
