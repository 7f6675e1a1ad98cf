"""Exact Jaccard self-join of word n-gram sets by the partition pigeonhole.

Sets are put in size bands. Two sets that reach the similarity differ in at most H
elements, H following from the band. The universe of elements is hashed into groups, so
many that e + 1 groups at least hold no more than h differences. A group is matched in one
of two ways: it is cut into h + k segments and every subset of k of them gives a signature,
for at least k segments are free of differences; or, where h = 1, its elements and its
elements less one give signatures. So two sets that reach the similarity share a signature
in at least e + 1 groups.

Signatures of no element at all would be shared by any two sets. A set with at most e groups
of which that is so leaves these signatures out and still meets every partner; the few others
keep them. What remains, e + 1 less the number of such groups, is the number of shared
signatures below which a set has no partner in the band: nearly all chance meetings end
there, before any text is fetched. h, k, e and the way of matching are chosen for each band
by cost, from its number of sets and mean size over the whole corpus.

Sets that share a signature are candidates; they are verified exactly, the links word by word.

Scale: equal sets are collapsed before anything is indexed. A signature met by one set only is
dropped in the stage that receives it; rows of a signature that a task has seen in two sets
already are known to be shared and are dealt at random, so that a signature which very many
sets share is no hot key. Groups are not expanded to all pairs: in each bucket every set x is
compared with one pivot p: the member that shares most signatures with others or, where that
is like the best pivot of its own buckets, the latter, so that a family of near copies has few
pivots. Let dx be the number of elements in which x differs from p. Two sets x and y of the
bucket differ in dx + dy - 2 o elements if these differences have o elements in common. So if
dx + dy is small enough they link for sure, and else they link only if the differences overlap
much: an exact prefix filter on the differences, those that p lacks first, finds such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations
from math import ceil, comb, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M1, Scratch, WordHashes, drop_ids, keep_ids, mix, released, row_key, small
from .graph import components

#: A chance meeting of two sets costs about as much as so many signature rows.
VERIFY_COST = 50
#: Bands of sizes grow by this factor.
BAND_RATIO = 1.5
#: Ways to match a group: (h, k) by subsets of k of its h + k segments; k = 0: within one deletion.
KINDS = [(1, 0), *((h, k) for h in range(7) for k in range(1, 5) if comb(h + k, k) <= 210)]
#: Signatures seen in so many sets of a piece are remembered as shared, up to HOT_SIGNATURES of them.
HOT_SETS, HOT_SIGNATURES = 16, 200_000


def pieces(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of the batch's texts with their starts, of about `limit` bytes each: no more are Python objects at once."""
    texts = batch.column("text").cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        stop = min(len(texts), int(np.searchsorted(ends, done + limit)) + 1)
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop


def shingle_sets(texts: list[bytes | None], n: int, cache: WordHashes, seed: int = 0) -> list[np.ndarray]:
    """The distinct 64-bit hashes of word n-grams of each text, sorted: A-Z lower-cased,
    words are runs without ASCII white space (bytes.lower and bytes.split do just that)."""
    words = [(t or b"").lower().split() for t in texts]
    counts = [len(w) for w in words]
    h = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, sum(counts)) ^ np.uint64(seed)
    g = mix(h)
    for k in range(1, n):
        if len(g) > 1:
            g = mix(g[:-1] + h[k:])
        else:
            g = g[:0]
    out, at = [], 0
    for c in counts:
        if c >= n:
            out.append(np.unique(g[at : at + c - n + 1]))
        elif c:
            short = mix(h[at : at + c])
            for k in range(1, c):
                short = mix(short[:-1] + h[at + k : at + c])
            out.append(short ^ np.uint64(c))
        else:
            out.append(h[:0])
        at += c
    return out


def word_grams(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@dataclass
class Scheme:
    """How the sets of a band are matched; see the head of this file."""

    groups: int
    h: int
    k: int
    spare: int
    subsets: np.ndarray
    tags: np.ndarray


class Bands:
    """Size bands for a similarity of per_cent / 100, and their schemes."""

    def __init__(self, per_cent: int, largest: int, stats: dict[int, tuple[int, float]] | None = None, ratio: float = BAND_RATIO):
        self.low, self.per_cent = [1], per_cent
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * ratio)))
        self.starts = np.array(self.low)
        self.schemes: dict[int, Scheme | None] = {}
        self.stats = stats or {}

    def of(self, size: int) -> range:
        """Bands of the sets, this or smaller ones, that a set of the size can link with."""
        least = -(-size * self.per_cent // 100)
        return range(int(np.searchsorted(self.starts, least, "right")) - 1, int(np.searchsorted(self.starts, size, "right")))

    def differences(self, band: int) -> int:
        high = self.low[band + 1] - 1
        return (high + high * 100 // self.per_cent) * (100 - self.per_cent) // (100 + self.per_cent)

    def scheme(self, band: int) -> Scheme | None:
        """The cheapest scheme of the band; None if its sets link with equal ones only."""
        if band not in self.schemes:
            self.schemes[band] = self._cheapest(band) if self.differences(band) else None
        return self.schemes[band]

    def _cheapest(self, band: int) -> Scheme:
        limit, low = self.differences(band), self.low[band]
        n, mean = self.stats.get(band, (1, low))
        best = None
        for h, k in KINDS:
            each = comb(h + k, k) if k else 1 + mean * (h + 1) / (limit + h + 1)
            for spare in (0, None):
                groups, e = limit // (h + 1) + 1, 0
                share = lambda: k / ((h + k) * groups) if k else 1 / groups  # noqa: B023, E731
                bare = lambda: (1 - share()) ** low + (0 if k else low * share() * (1 - share()) ** (low - 1))  # noqa: B023, E731
                while spare is None:  # as many spare groups as nearly all sets of the band need
                    groups = limit // (h + 1) + 1 + e
                    expected = min(1.0, (comb(h + k, k) if k else 1) * bare()) * groups
                    more = ceil(expected + 2 * sqrt(expected)) + 1
                    if more <= e or e > 3 * limit + 40:
                        break
                    e = more
                if spare is None and e > 3 * limit + 40:
                    continue
                rows = groups * (comb(h + k, k) if k else each)
                cost = rows + (VERIFY_COST * rows * bare() * min(1.0, n * bare()) if e == 0 else 0)
                if best is None or cost < best[0]:
                    best = cost, groups, h, k, e
        _, groups, h, k, e = best
        subsets = np.array(list(combinations(range(h + k), k or 1)))
        tags = mix((np.uint64(band) << np.uint64(32)) + np.arange(groups * len(subsets), dtype=np.uint64)).reshape(groups, -1)
        return Scheme(groups, h, k, e, subsets, tags)

    def signatures(self, elements: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """For each band: the signatures, the band, and how many of them a set must share to
        have a partner in the band."""
        place = mix(elements ^ M1)
        value = mix(place)
        place >>= np.uint64(32)
        out = []
        for band in self.of(len(elements)):
            if not (s := self.scheme(band)):
                continue
            width = s.h + s.k if s.k else 1
            segments = s.groups * width
            seg = ((place * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(segments, np.uint64)
            np.add.at(total, seg, value)
            count = np.bincount(seg, minlength=segments)
            if s.k:
                total, count = total.reshape(-1, width)[:, s.subsets], count.reshape(-1, width)[:, s.subsets].sum(2)
                sig = mix(total[:, :, 0])
                for i in range(1, s.k):
                    sig = mix(sig + total[:, :, i])
                sig, some = mix(sig ^ s.tags).ravel(), (count > 0).ravel()
                bare = int((count == 0).any(1).sum())
            else:
                tag = s.tags[:, 0]
                sig = np.concatenate([mix(mix(total) ^ tag), mix(mix(total[seg] - value) ^ tag[seg])])
                some = np.concatenate([count > 0, count[seg] > 1])
                bare = int((count < 2).sum())
            if bare <= s.spare:
                out.append((sig[some], band, s.spare + 1 - bare))
            else:
                out.append((np.unique(sig), band, 1))
        return out


def _set_id(elements: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    a = mix(elements)
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(mix(a ^ M1).sum(dtype=np.uint64).astype(np.int64))


def _compared(pairs: DataFrame, texts: DataFrame, n: int, per_cent: int) -> DataFrame:
    """The pairs (u, v), with the sizes su and sv of their sets, the number d of elements in
    which they differ, whether they link, and the first of these elements: those that v
    lacks, then those that u lacks, by hash."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pivot, of_pivot = WordHashes(), None, None
        for b in batches:
            pa.default_memory_pool().release_unused()
            us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
            tu, tv = (b.column(c).cast(pa.binary()) for c in ("tu", "tv"))
            su, sv, d, linked, first = [], [], [], [], []
            for i, v in enumerate(vs):
                if v != pivot or of_pivot is None:
                    pivot, of_pivot = v, shingle_sets([tv[i].as_py()], n, cache)[0]
                own = shingle_sets([tu[i].as_py()], n, cache)[0]
                both = np.intersect1d(own, of_pivot, assume_unique=True)
                x, y, k = len(own), len(of_pivot), len(both)
                reach = (x + x * 100 // per_cent) * (100 - per_cent) // (100 + per_cent) + 1
                new = np.setdiff1d(own, both, assume_unique=True)[:reach]
                old = np.setdiff1d(of_pivot, both, assume_unique=True)[: reach - len(new)]
                if 100 * k >= per_cent * (x + y - k):  # word by word
                    k = min(k, len(word_grams(tu[i].as_py(), n) & word_grams(tv[i].as_py(), n)))
                su.append(x)
                sv.append(y)
                d.append(x + y - 2 * k)
                linked.append(100 * k >= per_cent * (x + y - k))
                first.append(np.concatenate([new, old]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (us, vs, su, sv, d)), pa.array(linked, pa.bool_()), pa.array(first, pa.list_(pa.int64()))],
                ["u", "v", "su", "sv", "d", "linked", "first"],
            )

    t = lambda k: texts.select(F.col("set").alias(k), F.col("text").alias("t" + k))
    joined = pairs.join(t("u"), "u").join(t("v"), "v").select("u", "v", "tu", "tv")
    return joined.mapInArrow(released(compare), "u long, v long, su long, sv long, d long, linked boolean, first array<long>")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id.

    Two documents link if the Jaccard similarity of their sets of word n-grams reaches the
    similarity; component_id is the least id reachable by links. A text of fewer than n
    words is one shingle. Null and empty texts have no shingles, link with nothing and are
    their own component. Rows that repeat an id and text are one set. Null ids take no
    part in the minimum; a component of null ids alone has component_id null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    per_cent = round(similarity * 100)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    seed = 0
    while True:

        def describe(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for b in batches:
                pa.default_memory_pool().release_unused()
                size, one, two = [], [], []
                for _, part in pieces(b):
                    for s in shingle_sets(part, n, cache):
                        size.append(len(s))
                        x, y = _set_id(s ^ np.uint64(seed)) if len(s) else (None, None)
                        one.append(x)
                        two.append(y)
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.int64()) for x in (size, one, two))], ["id", "size", "set", "check"])

        id_type = docs.schema["id"].dataType.simpleString()
        meta = scratch.save(docs.mapInArrow(released(describe), f"id {id_type}, size long, set long, check long"), "meta")
        # An id names a text if all its rows have one set; sets without such an id are named
        # by their digest alone.
        of_id = meta.filter("id IS NOT NULL").groupBy("id").agg(F.min("set").alias("a"), F.max("set").alias("b"), F.max(F.col("size") == 0).alias("empty"))
        unclear = scratch.save(of_id.filter("a <> b OR (a IS NOT NULL AND empty)").select("id"), "unclear")
        marked = small(unclear, unclear.withColumn("unclear", F.lit(True)))
        keyed = meta.filter("size > 0").join(marked, "id", "left").withColumn("key", F.when(F.col("unclear").isNull(), F.col("id")))
        sets = scratch.save(
            keyed.groupBy("set").agg(F.min("id").alias("first"), F.min("key").alias("key"), F.first("size").alias("size"), F.min("check").alias("c1"), F.max("check").alias("c2")),
            "sets",
        )
        if sets.filter("c1 <> c2").isEmpty():  # no two different sets have one name
            break
        seed += 1

    largest = sets.agg(F.max("size")).first()[0] or 0
    bands = Bands(per_cent, largest)
    edges = F.array(*[F.lit(x) for x in bands.low[:-1]])
    band = F.size(F.filter(edges, lambda x: x <= F.col("size"))) - 1
    stats = sets.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("c"), F.avg("size").alias("mean")).collect()  # one row per band
    bands.stats = {r["band"]: (r["c"], r["mean"]) for r in stats}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hot = WordHashes(), np.zeros(0, np.uint64)
        for b in batches:
            pa.default_memory_pool().release_unused()
            for _, part in pieces(b):
                found, seen = [], set()
                for s in shingle_sets(part, n, cache):
                    if len(s) and (name := _set_id(s ^ np.uint64(seed))[0]) not in seen:
                        seen.add(name)
                        found += [(*x, name) for x in bands.signatures(s)]
                if not found:
                    continue
                sigs = np.concatenate([f[0] for f in found])
                of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                names = np.array([f[3] for f in found], np.int64)[of]
                marks = np.array([f[2] << 6 | f[1] for f in found], np.int32)[of]
                # The third and later sets of a signature, and all of those remembered, are dealt by the set.
                order = np.argsort(sigs, kind="stable")
                new = np.flatnonzero(np.diff(sigs[order], prepend=~sigs[order[:1]]) != 0)
                times = np.diff(np.append(new, len(order)))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(new, times)
                known = (rank > 1) | np.isin(sigs, hot)
                salt = np.where(known, 1 + (names & 0xFFF), 0).astype(np.int32)
                if len(hot) < HOT_SIGNATURES:
                    hot = np.union1d(hot, sigs[order[new[times >= HOT_SETS]]])
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(names), pa.array(marks), pa.array(salt)], ["sig", "set", "mark", "salt"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            for at, part in pieces(b):
                ids = [_set_id(s ^ np.uint64(seed))[0] if len(s) else None for s in shingle_sets(part, n, cache)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column("text").slice(at, len(part))], ["set", "text"])

    # Copies of a set are not indexed: ids other than the one that names the set.
    copies = keyed.filter("key IS NOT NULL").join(sets.select("set", F.col("key").alias("of_set")), "set").filter("key <> of_set").select("id").distinct()
    named = drop_ids(docs.filter("id IS NOT NULL"), scratch.save(copies.union(unclear).distinct(), "copies"), "id")
    nameless = scratch.save(sets.filter("key IS NULL").select("set"), "nameless")
    unnamed = docs.filter("id IS NULL").union(keep_ids(docs, unclear, "id")).mapInArrow(released(digest), "set long, text string")
    unnamed = scratch.save(unnamed.join(small(nameless), "set", "left_semi").dropDuplicates(["set"]), "unnamed")
    rows = named.select("text").union(unnamed.select("text"))
    by_sig = Window.partitionBy("sig", "salt").orderBy("set")
    signed = rows.mapInArrow(released(index), "sig long, set long, mark int, salt int")
    signed = signed.withColumn("before", F.lag("set").over(by_sig)).withColumn("after", F.lead("set").over(by_sig))
    met = scratch.save(signed.filter("salt > 0 OR before <> set OR after <> set").select("sig", "set", "mark"), "met")
    # Sets that share fewer signatures of a band than any partner there would need.
    likely = scratch.save(met.groupBy("set", "mark").count().filter("count >= shiftright(mark, 6)").select("set", "mark"), "likely")
    shared = scratch.save(met.join(small(likely), ["set", "mark"]).select("sig", "set"), "shared")
    scratch.drop(met, likely)

    nodes = scratch.save(shared.select("set").distinct().join(sets.select("set", "key"), "set"), "nodes")
    own = nodes.filter("key IS NOT NULL").select("set", F.col("key").alias("id"))
    texts = named.join(small(nodes, own), "id").select("set", "text")
    texts = texts.union(unnamed.join(nodes, "set", "left_semi").select("set", "text"))
    texts = scratch.save(texts.dropDuplicates(["set"]), "texts")

    # Pivots: in each bucket the set that shares most signatures with others. What is joined
    # by a key that may be hot is written first, so that Spark can split the key.
    counts = scratch.save(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("c")), "counts")
    score = scratch.save(shared.join(counts, "sig").groupBy("set").agg(F.sum("c").alias("score")), "score")
    pivot = shared.join(score, "set").groupBy("sig").agg(F.max(F.struct("score", "set")).alias("p")).select("sig", F.col("p.set").alias("v"), "p.score")
    pivot = scratch.save(pivot, "pivots")
    pairs = shared.join(pivot, "sig").filter(F.col("set") != F.col("v")).select(F.col("set").alias("u"), "v", "score").distinct()
    pairs = scratch.save(pairs, "pairs")
    scratch.drop(shared, counts, score, pivot)

    # A bucket may be compared with any set. Buckets of one family have many pivots: one that is
    # like the best pivot it meets itself leaves its buckets to that.
    ups = pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").groupBy("u").agg(F.max(F.struct("score", "v")).alias("p"))
    ups = scratch.save(ups.select("u", F.col("p.v").alias("v")), "best-pivots")
    ups = scratch.save(_compared(ups, texts, n, per_cent).filter("3 * d <= su + sv").select("u", "v"), "ups")  # a similarity of one half
    up = ups
    for _ in range(2):
        up = up.join(up.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left").select("u", F.coalesce("w", "v").alias("v"))
    up = scratch.save(up, "references")
    led = pairs.join(small(up, up.select(F.col("u").alias("v"), F.col("v").alias("w"))), "v", "left").select("u", F.coalesce("w", "v").alias("v")).union(up)
    pairs = scratch.save(led.filter("u <> v").distinct(), "pairs")
    stars = scratch.save(_compared(pairs, texts, n, per_cent), "stars")

    # Sets that differ so little from one pivot that they link without a comparison.
    most = lambda x, y: F.expr(f"({x} + {y}) * {100 - per_cent} div {100 + per_cent}")
    nearest = scratch.save(stars.groupBy("v", F.col("su").alias("sy")).agg(F.min(F.struct("d", "u")).alias("y")), "nearest")
    sure = stars.filter(~F.col("linked") & (F.col("d") <= most("su", f"su * 100 div {per_cent}"))).join(nearest, "v")
    sure = sure.filter((F.col("u") != F.col("y.u")) & (F.col("d") + F.col("y.d") <= most("su", "sy"))).select("u", F.col("y.u").alias("v"))
    scratch.drop(pairs)
    links = scratch.save(stars.filter("linked").select("u", "v").union(sure), "links")
    roots = scratch.save(components(links, scratch), "roots")

    # Pairs around one pivot, still in different components, whose differences overlap.
    placed = stars.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    several = placed.groupBy("v").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("v")
    several = scratch.save(several, "several")
    firsts = placed.join(several, "v").select("v", "u", "su", "d", "root", F.posexplode("first").alias("at", "element"))
    firsts = scratch.save(firsts, "differences")
    a, b = (firsts.select("v", "element", *[F.col(c).alias(c + k) for c in ("u", "su", "d", "root", "at")]) for k in "ab")
    h = most("sua", "sub")
    enough = 2 * F.least(F.col("da") - F.col("ata"), F.col("db") - F.col("atb")) >= F.col("da") + F.col("db") - h
    fits = (F.col("sua") * 100 >= F.col("sub") * per_cent) & (F.col("sub") * 100 >= F.col("sua") * per_cent) & (F.abs(F.col("da") - F.col("db")) <= h)
    pairs = a.join(b, ["v", "element"]).filter((F.col("ua") < F.col("ub")) & (F.col("roota") != F.col("rootb")) & fits & enough)
    pairs = pairs.select(F.col("ua").alias("u"), F.col("ub").alias("v")).distinct()
    found = _compared(pairs, texts, n, per_cent).filter("linked").select("u", "v")
    found = found.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = scratch.save(components(found, scratch), "roots")

    placed = sets.select("set", "first").join(roots.withColumnRenamed("node", "set"), "set", "left")
    placed = placed.withColumn("root", F.coalesce("root", "set"))
    least = scratch.save(placed.groupBy("root").agg(F.min("first").alias("component")), "components")
    of_set = placed.join(least, "root").select("set", "component")
    return meta.join(of_set, "set", "left").select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group: the one with the least id. Where ids are null or repeat, rows are linked
    each by itself; a null id comes after all others, and one of rows that share the least id stays. Columns as given."""
    scratch = Scratch(docs.sparkSession, "one-per-group")
    rows, key = row_key(docs, id_col, scratch)
    groups = scratch.save(similar_groups(rows, key, text_col, **options), "groups")
    if key == id_col:
        gone = groups.groupBy(key).agg(F.min(F.col("component_id")).alias("c")).filter(F.col("c") < F.col(key)).select(key)
    else:
        linked = groups.filter(F.col("component_id").isNotNull()).select(key, "component_id")
        rank = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col(key).alias("row"))
        ranked = scratch.save(linked.join(rows.select(key, id_col), key).select("component_id", rank.alias("r")), "ranked")
        first = scratch.save(ranked.groupBy("component_id").agg(F.min("r").alias("first")), "first")
        gone = ranked.join(small(first), "component_id").filter("r.row <> first.row").select(F.col("r.row").alias(key))
    return drop_ids(rows, gone, key).select(*docs.columns)


#: The contract of op5: word 3-grams, similarity 0.9. Quadratic in DuckDB, so it is for small tables.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""
