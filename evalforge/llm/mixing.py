"""Mixing sources to target weights by systematic sampling, in DataFrame operations.

Each source gets a target number of words; a document of a source expects
target / source size copies. Along a fixed order of the source's documents these
expected copies are summed, one random offset per source is added, and the document
is emitted once for each integer that its stretch of the sum crosses.

The order runs through size classes and, inside a class, by a hash of the id, so that
every class is sampled evenly and the words taken come near the target.

Scale: a source may hold a third of all rows, so no window runs over a source. Rows are
counted per (source, size class, hash bucket) with a map-side combine; the prefix sum
over these buckets is on the small table of counts; ranks inside a bucket are a window
over that bucket alone, and the number of buckets grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, small

#: Source weights by code point order of the source, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
MAX_COPIES = 3
ROWS_PER_BUCKET = 2000


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none."""
    # Words are what the squeezed and trimmed text has between spaces. Lambda variables hold
    # it, else it would be made anew for each use.
    squeezed = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))
    spaces = lambda t: F.length(t) - F.length(F.translate(t, " ", ""))
    return F.transform(F.array(squeezed), lambda t: F.when(t == "", 0).otherwise(spaces(t) + 1))[0].cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> also target. Sources share the total by weight; one that
    would pass max_copies times its size stops there and the excess is shared again.

    With sources ordered by size / weight those that stop are a prefix, so the final
    share per unit of weight is the first at which the next source stays below its cap.
    The table has one row per source; it is the only thing summed in one task.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("words_left", F.col("total") - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(after))
    below = F.col("weight") * F.col("words_left") <= max_copies * F.col("source_size") * F.col("weight_left")
    s = s.withColumn("i", F.row_number().over(order)).withColumn("below", below)
    first = F.min(F.when(F.col("below"), F.struct("i", "words_left", "weight_left"))).over(Window.partitionBy())
    s = s.withColumn("first", first)
    share = (F.col("weight") * F.col("first.words_left")).cast("double") / F.col("first.weight_left")
    target = F.when(F.col("i") >= F.col("first.i"), share).otherwise((max_copies * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", key_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, copies, key_cols.

    Null or empty texts have size 0 and take 0 words; null is a source of its own. A
    total of 0 gives targets and takes of 0. Repeated ids are rows like any other, in an
    order of their size, and rows without an id are placed by their text; reruns give the
    same result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *key_cols,
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))).alias("h"),
    )
    rows = scratch.save(
        rows.withColumn("cls", F.floor(12 * F.log(F.col("size") + 1)).cast("int")), "rows"
    )
    n = rows.count()
    buckets = max(1, n // ROWS_PER_BUCKET)
    # Hash buckets in the order of the hash: its first 8 hex digits, scaled.
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long"))
    counts = rows.groupBy("source", "cls", "bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("words"))
    counts = scratch.save(counts, "counts")
    targets = scratch.save(source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size"))), "targets")
    by = Window.partitionBy("source", "cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_cls = Window.partitionBy("source").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("source", "cls").agg(F.sum("c").alias("cc")).withColumn("below_cls", F.coalesce(F.sum("cc").over(by_cls), F.lit(0)))
    before = counts.withColumn("below", F.coalesce(F.sum("c").over(by), F.lit(0))).alias("a")
    before = before.join(classes.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.cls") == F.col("b.cls")))
    before = before.join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select(
        F.col("a.source").alias("s"), F.col("a.cls").alias("k"), F.col("a.bucket").alias("b"), (F.col("below") + F.col("below_cls")).alias("before"), "source_size", "target"
    )
    rank = F.row_number().over(Window.partitionBy("source", "cls", "bucket").orderBy("h", "id", "size"))
    ranked = rows.withColumn("rank", rank)
    ranked = ranked.join(
        before, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("k")) & (F.col("bucket") == F.col("b"))
    )
    place = F.col("before") + F.col("rank")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    copies = (F.floor(place * each + offset) - F.floor((place - 1) * each + offset)).cast("long")
    return ranked.withColumn("copies", F.least(F.lit(MAX_COPIES), copies)).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *key_cols
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is emitted, numbered by `copy`, which
    takes the place of a column of that name. Where ids are null or repeat, rows are saved
    with keys of their own, so each is emitted as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mixed")
    key, columns = id_col, [c for c in docs.columns if c != "copy"]
    if not docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        key = "__row"
        docs = scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    took = mix(docs, id_col, key_cols=() if key == id_col else (key,), **options).filter("copies > 0").select(key, F.col("copies").alias("__copies"))
    took = scratch.save(took, "copies")
    out = docs.join(small(took), key)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*columns, "copy")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(text) AS t FROM documents),
k AS (SELECT *, floor(12 * ln(size + 1))::INT AS cls, md5(coalesce(doc_id::VARCHAR, t, '')) AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER w AS i,
        (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS words_left,
        (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left
      FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT min(i) AS i FROM o WHERE weight * words_left <= 3 * source_size * weight_left),
t AS (SELECT o.source, o.source_size,
        CASE WHEN o.i >= f.i THEN (o.weight * g.words_left)::DOUBLE / g.weight_left ELSE (3 * o.source_size)::DOUBLE END AS target
      FROM o, f, o g WHERE g.i = f.i),
r AS (SELECT k.*, t.source_size, t.target,
        row_number() OVER (PARTITION BY k.source ORDER BY cls, h, doc_id, size) AS place,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
        ('0x' || substr(md5('mix|' || coalesce(k.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  least(3, (floor(place * each + off) - floor((place - 1) * each + off))::BIGINT) AS copies,
  least(3, (floor(place * each + off) - floor((place - 1) * each + off))::BIGINT) * size::BIGINT AS taken
FROM r
"""
