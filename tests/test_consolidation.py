"""Consolidation: whole tables only, once each, and the old table as it was until the new one is whole."""

from __future__ import annotations

import pytest

from evalforge.sources import sinks

SPEC = "g string, fold int, model string, value double"


def shard(spark, path, rows):
    spark.createDataFrame(rows, SPEC).repartition(2).write.parquet(str(path))
    return str(path)


def content(spark, path) -> list:
    return sorted((str(tuple(r)) for r in spark.read.parquet(str(path)).collect()))


def test_reruns_add_nothing_with_nulls_and_repeated_rows(spark, tmp_path):
    root = tmp_path / "shards"
    shard(spark, root / "a" / "x", [("a", 1, None, 1.0), ("a", 1, None, 1.0)])
    shard(spark, root / "b", [(None, None, "m", None), (None, None, None, 2.0)])
    shard(spark, root / "short", [("c", 1, "m", 1.0)])
    (root / "running" / "_temporary").mkdir(parents=True)
    (root / "running" / "part-0.parquet").write_bytes(b"not yet")
    target = str(tmp_path / "all")
    done, left = sinks.consolidate(spark, str(root), target, ["g", "fold"], 2)
    assert [p.rpartition("/")[2] for p in done] == ["x", "b"] and [p.rpartition("/")[2] for p in left] == ["short"]
    first = content(spark, target)
    assert len(first) == 4
    again = sinks.consolidate(spark, str(root), target, ["g", "fold"], 2)
    assert again == (done, left) and content(spark, target) == first
    assert {r["path"]: r["rows"] for r in sinks.manifest(spark, target).collect()} == dict.fromkeys(done, 2)
    # Without the manifest the groups themselves are known.
    twin = shard(spark, tmp_path / "twin", [("a", 1, "other", 9.0), ("a", 1, "other", 9.0), ("d", 1, "n", 1.0), ("d", 1, "n", 1.0)])
    sinks.consolidate(spark, [twin, str(tmp_path / "none")], target, ["g", "fold"], 2)
    assert len(content(spark, target)) == 6 and set(first) < set(content(spark, target))


def test_a_failure_before_the_swap_leaves_the_table(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "all")
    a, b = (shard(spark, tmp_path / n, [(n, 1, "m", 1.0), (n, 1, "m", 2.0)]) for n in "ab")
    sinks.consolidate(spark, [a], target, ["g"], 2)
    before = content(spark, target)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_swap", broken)
        with pytest.raises(OSError):
            sinks.consolidate(spark, [a, b], target, ["g"], 2)
    assert content(spark, target) == before
    # Cut short between the two renames: the table is put back.
    fs, p = sinks._files(spark, target)
    fs.rename(p, sinks._files(spark, target + ".before-1")[1])
    sinks.recover(spark, target)
    assert content(spark, target) == before and sorted(x.name for x in tmp_path.iterdir()) == ["a", "all", "b"]
    sinks.consolidate(spark, [a, b], target, ["g"], 2)
    assert len(content(spark, target)) == 4


def test_append_new_takes_nulls_as_values(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "m", 1.0), (None, 2, None, 2.0)], SPEC)
    for _ in range(2):
        sinks.append_new(spark, df, str(tmp_path / "t"), ["g", "fold", "model"])
    assert len(content(spark, tmp_path / "t")) == 2
