"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the component's least node.

    Alternates large-star and small-star steps until the edges are stars. Each step is a
    grouped minimum, combined on the map side and written, and a plain inner join with it, which
    AQE splits, so a node with very many neighbours never meets in one task.
    """

    def hooked(e: DataFrame, larger: bool) -> DataFrame:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        near = both if larger else both.filter("v < u")
        least = scratch.save(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        if larger:
            return both.filter("v > u").join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return near.join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))

    tidy = lambda e: e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(tidy(edges.select("u", "v")), "edges")
    while True:
        half = scratch.save(tidy(hooked(e, True)), "edges")
        after = scratch.save(tidy(hooked(half, False)), "edges")
        scratch.drop(half)
        scratch.drop(e)
        e = after
        # Stars: every node has one edge, and no centre has an edge to a lesser node.
        if e.groupBy("u").count().filter("count > 1").isEmpty() and e.join(e.select("v").toDF("u"), "u", "left_semi").isEmpty():
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))
