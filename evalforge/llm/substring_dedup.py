"""Removal of passages of 50 or more words that an earlier document also holds.

The named method would broadcast suffix automata of all reference shards. When the
reference is the corpus itself that is every document against every shard: quadratic
work, and automata of 130 million words to ship. What is kept of it is its result - for
each place of a document, whether the next 50 words also start in an earlier document -
computed from content-defined pieces instead:

1. Each window of 50 words has an anchor, the word 12-gram in it with the least hash. The
   anchor depends on the window's words alone, so equal windows have equal anchors.
   Consecutive windows with one anchor form a piece (39 windows at most).
2. Pieces are grouped by anchor. An anchor of one document only is dropped. An anchor
   that has one piece throughout is settled by the least document of the piece.
3. Of other anchors each different piece is opened once: its windows are grouped by their
   fingerprint, and the least document of each is handed back to all copies of the piece.

Pieces and windows are told apart by fingerprints of 128 bits: two independent polynomial
hashes of their words' 64-bit hashes.

Scale: about one row of 24 bytes for 20 words is shuffled. Grouped minima are combined on
the map side, written, and handed back by plain joins that AQE splits, so a passage that a
third of the documents share is no hot task. Texts are shuffled twice, to meet their pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, mix
from .ngram_join import pieces as text_runs

WINDOW, GRAM = 50, 12
#: Windows by anchor reach over so many grams; a piece has no more windows than that.
REACH = WINDOW - GRAM + 1
#: The bases of the two fingerprints, odd; and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
#: Bits for a place beside a hash; longer runs are searched in parts.
PLACE_BITS = 24


class Windows:
    """Fingerprints of word ranges of some texts, by prefix sums modulo 2^64."""

    def __init__(self, texts: list[bytes | None], cache: WordHashes):
        words = [(t or b"").split() for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        n = int(self.starts[-1])
        h = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, n)
        self.up, self.sums = [], []
        for base, inverse in zip(_BASES, _INVERSES, strict=True):
            powers = np.ones(n + 1, np.uint64)
            powers[1:] = np.uint64(base)
            self.up.append(np.multiply.accumulate(powers))
            powers[1:] = np.uint64(inverse)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(h ^ np.uint64(base >> 7)) * np.multiply.accumulate(powers)[:n])]))

    def of(self, start: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        return mix((self.sums[which][start + length] - self.sums[which][start]) * self.up[which][start])

    def anchors(self, grams: np.ndarray) -> np.ndarray:
        """For each window the place of the leftmost gram with the least hash (its upper bits)."""
        windows, low = len(grams) - REACH + 1, np.uint64(PLACE_BITS)
        out, step = [], (1 << PLACE_BITS) - REACH
        for at in range(0, windows, step):
            part = grams[at : at + step + REACH - 1]
            key = (part >> low << low) | np.arange(len(part), dtype=np.uint64)
            blocks = np.concatenate([key, np.full(-len(key) % REACH, np.uint64(2**64 - 1))]).reshape(-1, REACH)
            ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            behind = np.minimum.accumulate(blocks, axis=1).ravel()
            n = len(part) - REACH + 1
            least = np.minimum(ahead[:n], behind[REACH - 1 : REACH - 1 + n])
            out.append((least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + at)
        return np.concatenate(out)

    def pieces(self) -> tuple[np.ndarray, ...]:
        """(text, first window's word, windows, fingerprint of the anchor, both of the piece)."""
        n = int(self.starts[-1])
        none = np.zeros(0, np.int64)
        if n < WINDOW:
            return none, none, none, *[none.view(np.uint64)] * 3
        grams = self.of(np.arange(n - GRAM + 1), GRAM)
        anchor, windows = self.anchors(grams), n - WINDOW + 1
        text = np.repeat(np.arange(len(self.counts)), self.counts)[:windows]
        inside = np.arange(windows) + WINDOW <= self.starts[text + 1]
        new = np.ones(windows, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, windows))
        keep = inside[first]
        first, size = first[keep], size[keep]
        return text[first], first, size, grams[anchor[first]], self.of(first, size + WINDOW - 1), self.of(first, size + WINDOW - 1, 1)


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _find_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for b in batches:
        ids, prints = b.column("id"), b.column("print")
        for at, part in text_runs(b):
            w = Windows(part, cache)
            text, first, size, anchor, piece, other = w.pieces()
            rows = pa.array(text + at)
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), prints.take(rows), pa.array((first - w.starts[text]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(other.view(np.int64))],
                ["id", "print", "start", "windows", "anchor", "piece", "piece2"],
            )


def _open_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for b in batches:
        ids, opened = b.column("id"), b.column("opened")
        for at, part in text_runs(b):
            w = Windows(part, cache)
            row, start, size, piece, other = [], [], [], [], []
            for i in range(len(part)):
                for x in opened[at + i].as_py():
                    row.append(i)
                    start.append(x["start"])
                    size.append(x["windows"])
                    piece.append(x["piece"])
                    other.append(x["piece2"])
            row, start, size, piece, other = (np.array(x, np.int64) for x in (row, start, size, piece, other))
            which = np.repeat(np.arange(len(row)), size)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            prints = [pa.array(w.of(w.starts[row[which]] + start[which] + offset, WINDOW, k).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row[which] + at)), pa.array(piece[which]), pa.array(other[which]), pa.array(offset.astype(np.int32)), *prints],
                ["id", "piece", "piece2", "offset", "window", "window2"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(_texts(b), b.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, np.int32)
                for s in spans:
                    for offset in np.flatnonzero(np.array([s["mask"] >> k & 1 for k in range(REACH)])):
                        gone[s["start"] + offset] += 1
                        gone[s["start"] + offset + WINDOW] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                words = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, print, spans) of documents with windows to remove: an array of (start, mask),
    bit k of the mask telling that the window at word start + k starts in an earlier one."""
    kind = docs.schema["id"].dataType.simpleString()
    p = scratch.save(docs.mapInArrow(_find_pieces, f"id {kind}, print long, start int, windows int, anchor long, piece long, piece2 long"), "pieces")
    # What is handed back by a key that may be hot is written first, so that Spark can split the key.
    ends = [f(c).alias(f.__name__ + c) for c in ("id", "piece", "piece2") for f in (F.min, F.max)]
    anchors = p.groupBy("anchor").agg(*ends).filter("minid < maxid")
    anchors = scratch.save(anchors.select("anchor", F.col("minid").alias("least"), F.expr("minpiece <> maxpiece OR minpiece2 <> maxpiece2").alias("mixed")), "anchors")
    met = scratch.save(p.join(anchors, "anchor").select("id", "print", "start", "windows", "piece", "piece2", "least", "mixed"), "met")
    scratch.drop(p, anchors)
    whole = met.filter("NOT mixed AND least < id").select(
        "id", "print", "start", (F.expr("shiftleft(1L, windows)") - F.lit(1)).alias("mask")
    )

    # Each different piece is opened in its least document.
    different = met.filter("mixed AND id IS NOT NULL").groupBy("piece", "piece2").agg(F.min(F.struct("id", "print", "start", "windows")).alias("m"))
    different = scratch.save(different, "different")
    opened = different.groupBy(F.col("m.id").alias("oid"), F.col("m.print").alias("oprint")).agg(
        F.collect_list(F.struct(F.col("m.start").alias("start"), F.col("m.windows").alias("windows"), "piece", "piece2")).alias("opened")
    )
    at = (F.col("id") == F.col("oid")) & (F.col("print") == F.col("oprint"))
    windows = scratch.save(
        docs.join(opened, at).select("id", "text", "opened").mapInArrow(_open_pieces, f"id {kind}, piece long, piece2 long, offset int, window long, window2 long"), "windows"
    )
    first = windows.groupBy("window", "window2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    first = scratch.save(first.select("window", "window2", "first"), "first")
    firsts = windows.join(first, ["window", "window2"]).groupBy("piece", "piece2").agg(F.collect_set(F.struct("offset", "first")).alias("firsts"))
    # Windows that start in one different piece only still come before that piece's copies.
    known = different.select("piece", "piece2", F.col("m.id").alias("own")).join(firsts, ["piece", "piece2"], "left")
    known = scratch.save(known, "known")
    scratch.drop(windows, first, different)
    copies = met.filter("mixed").join(known, ["piece", "piece2"])
    early = F.aggregate(
        F.coalesce("firsts", F.array().cast("array<struct<offset:int,first:" + kind + ">>")), F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(F.when(x["first"] < F.col("id"), F.pow(F.lit(2.0), x["offset"]).cast("long")).otherwise(F.lit(0).cast("long"))),
    )
    mask = F.when(F.col("own") < F.col("id"), F.expr("shiftleft(1L, windows)") - F.lit(1)).otherwise(early)
    part = copies.select("id", "print", "start", mask.alias("mask")).filter("mask <> 0")
    spans = whole.union(part).groupBy("id", "print").agg(F.collect_set(F.struct("start", "mask")).alias("spans"))
    return spans.select(F.col("id").alias("sid"), F.col("print").alias("sprint"), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_text.

    Words are runs without ASCII white space, unchanged. A word goes if a window of 50
    words that covers it also starts in a document with a smaller id; windows are judged
    on the input. The kept words are joined by one space. Null and empty texts have no
    words. Null ids come before and after no document. Rows that repeat an id are judged
    each by its own text. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("print"))
    spans = repeated_spans(d, scratch)
    marked = d.join(spans, (F.col("id") == F.col("sid")) & (F.col("print") == F.col("sprint")), "left").select("id", "text", "spans")
    kind = d.schema["id"].dataType.simpleString()
    return marked.mapInArrow(_cut, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
r AS (SELECT doc_id, list(i) AS gone FROM h JOIN f USING (h) WHERE first < doc_id GROUP BY doc_id),
g AS (SELECT doc_id, list_distinct(flatten(list_transform(gone, lambda i: generate_series(i, i + 49)))) AS gone FROM r),
x AS (SELECT w.doc_id, w.w, CASE WHEN g.gone IS NULL THEN w.w ELSE
        list_filter(list_transform(w.w, lambda x, i: CASE WHEN list_contains(g.gone, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS k
      FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM x
"""
