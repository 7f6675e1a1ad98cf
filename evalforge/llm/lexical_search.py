"""Ranked lexical search: the k best documents of every item by an integer BM25, with dual trees.

Every shard of items becomes a tree: items in an order that puts those with the same common terms side
by side, nodes of FANOUT of them, nodes of those, and so on; a node holds each term's largest weight
below it. Documents are handled in batches, each a tree of the same kind whose nodes hold each
term's largest saturated frequency. The sum of products over the terms of two nodes bounds the score of every
pair below them. A pair of nodes is followed only where that bound reaches the weakest k-th score of
the node's items (as found so far, so ties survive); at the leaves the sum is the score itself.

Scale: documents are read once a shard and reduced to the items' terms; document frequencies are counted
with a map-side combine, and what reaches the driver is a shard: items whose terms take about SHARD_BYTES
(one longer item at most makes it longer), their weights, and a score for each. Items are spread over
as many shards as their terms need, by hash. A first pass over one document of SEED gives thresholds that are
already close, so that a task emits little. A task keeps k rows an item, whatever it reads; ranks are
windows of at most k rows a task and item. Texts are never grouped or collected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 10
FANOUT = 8
SHARD_BYTES = 4 << 20
#: Documents of a tree, and products that are added up at once.
BATCH_DOCS = 4096
PRODUCTS = 1 << 22
SEED = 64
#: Bytes of terms stay, upper-case ASCII letters are lowered, all else is a separator.
_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of `[0-9A-Za-z]` and of characters beyond ASCII, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class ItemTree:
    """Items of a shard: the nodes of every level that hold each term, and the terms' weights."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, fanout: int = FANOUT):
        # Terms are numbered by falling document frequency, so neighbours share the commonest.
        self.order = sorted(range(len(items)), key=lambda i: (items[i].tolist(), i))
        self.weights, self.fanout, self.levels = weights, fanout, []
        node = np.repeat(np.arange(len(items)), [len(items[i]) for i in self.order])
        term = np.concatenate([items[i] for i in self.order]) if items else np.zeros(0, np.int64)
        n = len(items)
        while True:
            both = np.unique(term * max(n, 1) + node)
            start = np.searchsorted(both // max(n, 1), np.arange(len(weights) + 1))
            self.levels.append((n, start, both % max(n, 1)))
            if n <= fanout:
                break
            node, n = node // fanout, -(-n // fanout)

    def weakest(self, bound: np.ndarray, level: int) -> np.ndarray:
        """The least of the items' thresholds below each node."""
        for _ in range(level):
            bound = np.minimum.reduceat(bound, np.arange(0, len(bound), self.fanout))
        return bound


def doc_levels(doc: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, n_terms: int, depth: int, fanout: int) -> list[tuple]:
    """(nodes, node, term, largest value) of each level of the documents' tree, leaves first."""
    out = [(n, doc, term, value)]
    for _ in range(depth - 1):
        n, doc = -(-n // fanout), doc // fanout
        key = doc * n_terms + term
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        value = np.maximum.reduceat(value[order], first) if len(key) else value
        doc, term = key[first] // n_terms, key[first] % n_terms
        out.append((n, doc, term, value))
    return out


def bounds(level: tuple, items: tuple, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sums of products of nodes of documents (rows) and of items; rows that are not wanted stay 0."""
    n, node, term, value = level
    m, start, holders = items
    take = wanted[node]
    node, term, value = node[take], term[take], value[take]
    out = np.zeros(n * m, np.int64)
    counts = start[term + 1] - start[term]
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(term):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PRODUCTS, "right")))
        c = counts[lo:hi]
        total = int(c.sum())
        place = np.repeat(start[term[lo:hi]] - (np.cumsum(c) - c), c) + np.arange(total)
        cell = np.repeat(node[lo:hi] * m, c) + holders[place]
        add = np.repeat(weights[term[lo:hi]] * value[lo:hi], c)
        # Sums stay far below 2^53, so that doubles add them exactly.
        at = node[lo] * m if lo < len(node) and np.all(node[lo:hi] >= node[lo]) else 0
        part = np.bincount(cell - at, add.astype(float)).astype(np.int64)
        out[at : at + len(part)] += part
        lo = hi
    return out.reshape(n, m)


def dual_search(levels: list[tuple], tree: ItemTree, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(document, item place, score) of all pairs whose score reaches the item's threshold, and how many pairs of
    nodes were followed at each level, from the top."""
    depth, fanout, alive, followed = len(tree.levels), tree.fanout, None, []
    for at in reversed(range(depth)):
        n, m = levels[at][0], tree.levels[at][0]
        if alive is None:
            alive = np.ones((n, m), bool)
        else:
            alive = np.repeat(np.repeat(alive, fanout, 0)[:n], fanout, 1)[:, :m]
        score = bounds(levels[at], tree.levels[at], tree.weights, alive.any(axis=1))
        alive &= score >= tree.weakest(threshold, at)
        followed.append(int(alive.sum()))
    doc, item = np.nonzero(alive)
    return doc, item, score[doc, item], followed


class Best:
    """The k best documents of each item of a tree."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.floor, self.k = np.maximum(thresholds, 1), k
        self.rows = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64)]  # item, score, unknown, id, key

    def add(self, *new: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, new, strict=True)]
        item, score, unknown, doc, key = rows
        order = np.lexsort((key, doc, unknown, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.rows = [x[order][place < self.k] for x in rows]
        last = place == self.k - 1
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[order][last])


class Searcher:
    """What tasks know of a shard, and their work."""

    def __init__(self, tree: ItemTree, n_docs: int, n_terms: int, k: int, batch_docs: int = BATCH_DOCS):
        self.tree, self.n_docs, self.n_terms, self.k, self.batch_docs = tree, n_docs, n_terms, k, batch_docs

    def values(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 10 + (90 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def batch(self, p: pd.DataFrame, number: np.ndarray, best: Best) -> None:
        """Documents p (key, id, unknown, n, terms, tfs); number: from terms as stored to the tree's."""
        size = np.fromiter(map(len, p["terms"]), np.int64, len(p))
        p, size = p[size > 0], size[size > 0]
        if not len(p):
            return
        term, tf = number[np.concatenate(p["terms"].tolist())], np.concatenate(p["tfs"].tolist()).astype(np.int64)
        value = self.values(tf, np.repeat(p["n"].to_numpy(np.int64), size))
        # Documents side by side that share their commonest term and are of a length.
        common = np.minimum.reduceat(term, np.cumsum(size) - size)
        order = np.lexsort((p["n"], common))
        place = np.empty(len(p), np.int64)
        place[order] = np.arange(len(p))
        doc = np.repeat(place, size)
        by_doc = np.argsort(doc, kind="stable")
        levels = doc_levels(doc[by_doc], term[by_doc], value[by_doc], len(p), len(self.tree.weights), len(self.tree.levels), self.tree.fanout)
        d, item, score, _ = dual_search(levels, self.tree, best.floor)
        own = order[d]
        best.add(item, score, p["unknown"].to_numpy(bool)[own], p["id"].to_numpy(np.int64)[own], p["key"].to_numpy(np.int64)[own])

    def run(self, parts: Iterator[pd.DataFrame], number: np.ndarray, thresholds: np.ndarray) -> Iterator[pd.DataFrame]:
        best = Best(thresholds, self.k)
        for part in parts:
            for lo in range(0, len(part), self.batch_docs):
                self.batch(part.iloc[lo : lo + self.batch_docs], number, best)
        yield pd.DataFrame(dict(zip(("place", "score", "unknown", "id", "key"), best.rows, strict=True)))


FOUND = "place long, score long, unknown boolean, id long, key long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), "unknown", "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_shard(rows: DataFrame, shard: list, scratch: Scratch, k: int, batch_docs: int, fanout: int) -> tuple[DataFrame, list[int]]:
    """(place, rank, score, unknown, id) for the items of a shard [(key, terms)], and the items' keys by place."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in shard for t in ts}))}
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def reduced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value.get
        for p in parts:
            n, own, tfs = [], [], []
            for text in p["text"]:
                words = terms(text)
                counts = [(i, c) for w, c in Counter(words).items() if (i := number(w)) is not None]
                n.append(len(words))
                own.append([i for i, _ in counts])
                tfs.append([c for _, c in counts])
            yield p[["key", "id", "unknown"]].assign(n=n, terms=own, tfs=tfs)

    docs = scratch.save(rows.mapInPandas(reduced, "key long, id long, unknown boolean, n long, terms array<int>, tfs array<int>").filter("n > 0"), "documents")
    n_docs, n_terms = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in docs.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    by_df = np.lexsort((np.arange(len(df)), -df))
    number = np.empty(len(df), np.int64)
    number[by_df] = np.arange(len(df))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df[by_df]], np.int64)
    tree = ItemTree([np.sort(number[[vocabulary[t] for t in ts]]) for _, ts in shard], weights, fanout)
    search, none = Searcher(tree, n_docs, max(n_terms, 1), k, batch_docs), np.zeros(len(shard), np.int64)
    kit = rows.sparkSession.sparkContext.broadcast((search, number))
    first = docs.filter(F.pmod(F.xxhash64("key"), F.lit(SEED)) == 0).mapInPandas(lambda parts: kit.value[0].run(parts, kit.value[1], none), FOUND)
    thresholds = none.copy()
    for r in _ranked(first, k).filter(F.col("rank") == k).select("place", "score").collect():
        thresholds[r["place"]] = r["score"]
    found = docs.mapInPandas(lambda parts: kit.value[0].run(parts, kit.value[1], thresholds), FOUND)
    return _ranked(found, k), [shard[i][0] for i in tree.order]


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = K, shard_bytes: int = SHARD_BYTES, batch_docs: int = BATCH_DOCS, fanout: int = FANOUT,
) -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of highest score above 0 of each row of items.

    Null and empty texts, and texts without a term, have none: such items get no rows and such
    documents count nowhere. Repeated rows of items are ranked each by itself, repeated rows of documents are
    documents of their own. Ties go to the smaller id of the document, null ids last. Ids of items may be null.
    Texts are read whole, however long. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[["key", "id", "unknown"]].assign(terms=[sorted(set(terms(t))) for t in p["text"]])

    def row(df: DataFrame, name: str, text: str) -> DataFrame:
        # Ids travel with a mark for null: pandas would make doubles of them.
        return df.select(F.monotonically_increasing_id().alias("key"), F.coalesce(F.col(name).cast("long"), F.lit(0)).alias("id"), F.col(name).isNull().alias("unknown"), F.col(text).alias("text"))

    asked = row(items, item_col, item_text).mapInPandas(split, "key long, id long, unknown boolean, terms array<binary>")
    asked = scratch.save(asked.filter(F.size("terms") > 0), "items")
    total = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 8))).first()[0] or 0
    shards, out = max(1, math.ceil(total / shard_bytes)), []
    real = lambda name: F.when(~F.col("unknown"), F.col("id")).alias(name)
    for s in range(shards):
        shard = [(r["key"], [bytes(t) for t in r["terms"]]) for r in asked.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == s).orderBy("key").collect()]
        found, keys = _search_shard(row(docs, id_col, text_col), shard, scratch, k, batch_docs, fanout)
        names = spark.createDataFrame(list(enumerate(keys)), "place long, item_key long")
        out.append(found.join(names, "place").select("item_key", "rank", real(id_col), "score"))
    named = asked.select(F.col("key").alias("item_key"), real(item_col))
    found = reduce(DataFrame.union, out).join(named, "item_key")
    return found.select(item_col, F.col("rank").cast("int").alias("rank"), id_col, "score")


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM d),
m AS (SELECT doc_id, 10 + (90 * n * big_n) // l AS m FROM d, a),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""
