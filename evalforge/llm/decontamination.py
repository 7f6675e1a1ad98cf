"""Benchmark decontamination by size-partitioned MinHash containment search, in
DataFrame operations only.

An item is contained in a document if the document holds at least a share (0.8) of the
item's distinct word 5-grams. One min-wise hash orders all shingles. Items are partitioned by
their number of shingles into bands of powers of two; the MinHash sketch of an item with n
shingles is its n - ceil(share * n) + 1 minima, so its size follows the item's. A document
that holds the share of the shingles misses too few of them to miss the whole sketch, so
looking up the document's hash values among the sketches loses no pair, however long the
document; and a document is looked up only in bands whose smallest requirement its own size
can meet. Candidates are verified on the exact shingles.

(Comparing MinHash signatures of whole documents, banded as usual, cannot give right
results here: a 50-word item in a 20,000-word document has a Jaccard similarity of 0.002.)

Scale: documents are streamed once past the sketches, without a shuffle; only distinct
candidate pairs move. Hash values above the largest minimum of all sketches are not looked up.
Sketches are broadcast while their table stays within a bound of bytes, else hash values are
joined by a shuffle. The text of candidates alone is read again, and each candidate pair is
verified by itself: a shingle that very many items hold is joined with none of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, drop_ids, row_key, small

N = 5
SHARE = 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


HASHED, EXACT = "xxhash64({s})", "array_join({s}, ' ')"


def _grams(w: str, n: int, make: str) -> Column:
    """make(slice) of each n consecutive words of column w; of all words together if there
    are fewer. A lambda variable holds the words, else they would be split anew for each."""
    places = f"sequence(1, greatest(1, size(v) - {n - 1}))"
    grams = f"CASE WHEN size(v) = 0 THEN array() ELSE transform({places}, i -> {make.format(s=f'slice(v, i, {n})')}) END"
    return F.expr(f"transform(array({w}), v -> {grams})[0]")


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", n: int = N, share: float = SHARE, max_broadcast: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id_col, item_col, n_item, n_shared, containment) of each document and item with
    containment >= share, once per pair of ids.

    Null or empty texts (and texts without letters or digits) have no shingles and match
    nothing. A text of fewer than n words is one shingle. Rows of documents that repeat an id
    are judged each by itself, and the best counts; rows of items that repeat one are taken
    together. Null ids of documents are reported as null ids. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "contained")
    per_cent = round(share * 100)
    need = lambda c: F.ceil(c * per_cent / F.lit(100)).cast("long")

    # Shingles of each item; rows that repeat an id add to it. A shingle is hashed as its words.
    it = items.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w"))
    it = it.select("item", F.explode(_grams("w", n, EXACT)).alias("gram")).distinct()
    it = it.groupBy("item").agg(F.collect_list(F.struct(F.xxhash64(F.split("gram", " ")).alias("h"), "gram")).alias("os"))
    it = it.withColumn("os", F.sort_array("os")).withColumn("n_item", F.size("os").cast("long")).withColumn("need", need(F.col("n_item")))
    sizes = scratch.save(it.withColumn("band", F.floor(F.log2("n_item")).cast("int")), "items")
    # The least that any item of the band asks for; documents below it skip the band.
    band = sizes.groupBy("band").agg(F.min("need").alias("least"))  # a row for each power of two
    sketch = F.slice("os", F.lit(1), (F.col("n_item") - F.col("need") + 1).cast("int"))
    sketch = scratch.save(sizes.join(F.broadcast(band), "band").select(F.explode(sketch).alias("o"), "item", "least").select("o.h", "item", "least"), "minima")
    last = sketch.agg(F.max("h")).first()[0]

    probe = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    # No sketch holds a hash value above `last`.
    held = f"filter(h, x -> x <= {last if last is not None else -(2**63 - 1)}L)"
    probe = probe.select("id", (F.size("w") - (n - 1)).alias("m"), _grams("w", n, HASHED).alias("h")).select("id", "m", F.explode(F.expr(held)).alias("h"))
    hits = probe.join(small(sketch, max_bytes=max_broadcast), "h").filter(F.greatest(F.lit(1), "m") >= F.col("least"))
    pairs = scratch.save(hits.select("id", "item").distinct(), "candidates")

    ids = scratch.save(pairs.select(F.col("id").alias("cid")).distinct(), "candidate-ids")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    texts = texts.join(small(ids, max_bytes=max_broadcast), F.col("id").eqNullSafe(F.col("cid")), "left_semi")
    grams = texts.select("id", words(F.col("t")).alias("w")).select("id", _grams("w", n, EXACT).alias("grams"))
    asked = sizes.select(F.col("item").alias("sitem"), F.transform("os", lambda o: o["gram"]).alias("asked"))
    both = grams.join(pairs.select(F.col("id").alias("pid"), "item"), F.col("id").eqNullSafe(F.col("pid")))
    both = both.join(small(sizes, asked, max_broadcast), F.col("item").eqNullSafe(F.col("sitem")))
    shared = both.select("id", "item", F.size(F.array_intersect("grams", "asked")).cast("long").alias("n_shared"))
    found = shared.groupBy("id", "item").agg(F.max("n_shared").alias("n_shared"))
    size = sizes.select(F.col("item").alias("sitem"), "n_item", "need")
    found = found.join(size, F.col("item").eqNullSafe(F.col("sitem"))).filter(F.col("n_shared") >= F.col("need"))
    return found.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared",
        (F.col("n_shared").cast("double") / F.col("n_item")).alias("containment"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that contain an item. Rows are judged each by itself, also where ids are null or
    repeat; columns as given."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    rows, key = row_key(docs, id_col, scratch)
    found = scratch.save(contained_items(rows, items, key, **options).select(key).distinct(), "found")
    return drop_ids(rows, found, key).select(*docs.columns)


def _sql_grams(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS gram
  FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})"""


ORACLE = f"""
WITH d AS ({_sql_grams('documents', 'doc_id')}),
b AS ({_sql_grams('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (gram) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment
FROM s JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
