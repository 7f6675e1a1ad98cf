"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Every text is cut into fixed-size blocks of bytes. The distinct blocks are sorted by their
fingerprints and named by their ranks, which depend on the texts alone and not on how rows
are partitioned; a text becomes a sequence of those integers. Then adjacent pairs of integers
are named in the same way, again and again, until each document has one integer: two
documents have the same one exactly if their texts are the same.

Scale: block text is shuffled once, behind a map-side distinct, so that any number of
copies of a block costs one row per task. Occurrences carry only a 128-bit fingerprint
of their block; the naming step checks that no two different blocks share one (and
draws new fingerprints if they do), so names do not rest on hashing. All later steps
move integers. Ranks are counted inside ranges of the hash, each of bounded size, and added
to the prefix sums of a small table of range sizes. What is joined on hot names is a table
written before, so that AQE splits the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, drop_ids, small

BLOCK_BYTES = 8192


def _blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    b = docs.withColumn("__b", F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    n = F.greatest(F.lit(1), F.ceil(F.length("__b") / F.lit(block_bytes))).cast("int")
    return b.withColumn("__n", n).withColumn(
        "__blocks", F.expr(f"transform(sequence(0, __n - 1), i -> substring(__b, i * {block_bytes} + 1, {block_bytes}))")
    )


#: Ranks are counted in one task for about so many names.
NAMES_PER_RANGE = 200_000


def _numbered(distinct: DataFrame, *keys: str, scratch: Scratch) -> DataFrame:
    """keys and `name`: the rank of each of the distinct rows by hash and then the keys."""
    d = scratch.save(distinct.select(*keys, F.xxhash64(*keys).alias("h")), "distinct")
    ranges = max(1, d.count() // NAMES_PER_RANGE)
    # Equal ranges of the signed hash, in its order.
    d = d.withColumn("range", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * ranges).cast("long"))
    sizes = d.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = scratch.save(sizes.select("range", before.alias("before")), "ranges")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", *keys))
    return d.withColumn("rank", rank).join(small(sizes), "range").select(*keys, (F.col("before") + F.col("rank")).alias("name"))


def block_identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None
) -> DataFrame:
    """(rid, id, sha, level, name): one row per row of docs; (level, name) is the same
    for two rows exactly if their texts are. Null texts count as empty."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    seed = 0
    while True:
        prints = F.transform("__blocks", lambda b: F.struct(F.xxhash64(b).alias("h1"), F.xxhash64(F.lit(seed), b).alias("h2")))
        rows = scratch.save(
            _blocks(docs, "__text", block_bytes).select(
                F.monotonically_increasing_id().alias("rid"),
                F.col("__id").alias("id"),
                F.sha2(F.col("__b"), 256).alias("sha"),
                prints.alias("prints"),
            ),
            "rows",
        )
        # The grouping key is the block itself; its fingerprints follow from it.
        distinct = (
            _blocks(docs, "__text", block_bytes)
            .select(F.explode("__blocks").alias("block"))
            .groupBy("block")
            .agg(F.count(F.lit(1)).alias("c"))
            .select(F.xxhash64("block").alias("h1"), F.xxhash64(F.lit(seed), "block").alias("h2"))
        )
        names = scratch.save(_numbered(distinct, "h1", "h2", scratch=scratch), "block-names")
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        seed += 1

    longest = rows.agg(F.max(F.size("prints"))).first()[0] or 1
    level = rows.select("rid", F.size("prints").alias("n"), F.posexplode("prints").alias("pos", "p"))
    level = level.select("rid", "n", "pos", "p.h1", "p.h2").join(names, ["h1", "h2"]).select("rid", "n", "pos", "name")
    if longest > 1:
        level = scratch.save(level, "level")
    done, r, length = [level.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")], 0, longest
    while length > 1:
        r, length = r + 1, (length + 1) // 2
        last = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = (
            level.filter("n > 1")
            .groupBy("rid", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos2"))
            .agg(last(0).alias("a"), F.coalesce(last(1), F.lit(-1)).alias("b"))
        )
        pairs = scratch.save(pairs, "pairs")
        names = scratch.save(_numbered(pairs.select("a", "b").distinct(), "a", "b", scratch=scratch), "pair-names")
        level = scratch.save(
            pairs.join(names, ["a", "b"]).select("rid", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), F.col("pos2").alias("pos"), "name"), "level"
        )
        scratch.drop(pairs, names)
        done.append(level.filter("n = 1").select("rid", F.lit(r).alias("level"), "name"))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return rows.select("rid", "id", "sha").join(out, "rid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts (null counts as empty) the row with the largest id stays. Repeated
    rows with that same id tie: exactly one of them is kept, the others have their own
    id as keep_id and kept = false. Null ids come last; a group of null ids alone has
    keep_id null and one kept row. No rows in, none out; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    ids = scratch.save(block_identities(docs, id_col, text_col, block_bytes, scratch), "identities")
    best = ids.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "rid")).alias("best")
    )
    best = scratch.save(best, "best")
    return ids.join(best, ["level", "name"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long"),
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of equal texts; columns as given."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    groups = scratch.save(exact_groups(docs, id_col, text_col), "groups")
    rows, ids = groups.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    if rows > ids:
        # Ids that repeat or are null do not name a row: the text's digest joins the key.
        key = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
        first = Window.partitionBy("__sha", "__id").orderBy(F.lit(1))
        kept = groups.filter("kept").select(F.col(id_col).alias("__keep"), F.col("text_sha256").alias("__sha"))
        marked = docs.withColumn("__sha", key).withColumn("__id", F.col(id_col)).join(kept, "__sha")
        marked = marked.filter(F.col("__id").eqNullSafe(F.col("__keep")))
        return marked.withColumn("__r", F.row_number().over(first)).filter("__r = 1").select(*docs.columns)
    return drop_ids(docs, groups.filter("NOT kept").select(id_col), id_col)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
