"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a character model of words: the next character given
the five before it inside the word, with absolute discounting. What a class has seen
rarely or never it takes from shared backoff counts: the number of different words of the
whole corpus, labelled or not, that hold the shorter context and character. So an
expression that neither class knows well has the same likelihood under both and decides
nothing, while parts of words that only toxic documents use do.

A document is compared by its length-normalised log-likelihood ratio: the mean over its
words, and the largest means over stretches of 16 words, so that a few toxic expressions
in a long document are still seen. A logistic curve fitted on labelled rows turns these
into a score; its rows are scored by models of the other half of the labelled rows.

Counts cover all documents and all labelled rows for learning. The curve alone is fitted
on a bounded sample (CURVE_ROWS rows of each class, by hash of the id).

Scale: words are counted per task before they are shuffled, then once per distinct word
cut into character n-grams. The counts are a table keyed by 64-bit hashes of the n-grams,
which grows with the input, and the log-likelihood ratio of each n-gram is made from it by
joins. The n-grams found in most documents, at most MAX_GRAMS, are sent to the tasks. Words
that hold any other get their ratio by a join with the table, and so do the documents that
hold such words: none of these n-grams is in many documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, Scratch, drop_ids, mix, released, row_key, small

ORDER, BACKOFF_ORDER = 6, 4
#: Most n-grams whose ratios are sent to the tasks; the others are joined.
MAX_GRAMS = 4_000_000
DISCOUNT = 0.75
#: Code points: each has a chance to come next.
CHARACTERS = 0x110000
STRETCH = 16
CURVE_ROWS = 10_000
#: Counts by class and half of the labelled rows.
COUNTS = ("t0", "t1", "o0", "o1")
_WORDS_AT_ONCE = 20_000
#: Rows whose texts a task turns into Python strings at once, and words that it remembers.
_ROWS_AT_ONCE = 128
_REMEMBERED = 60_000
#: Ratios of an n-gram or word: by both halves of the labelled rows, by the first, by the second.
RATIOS = {"r": (0, 1), "r0": (0,), "r1": (1,)}


#: Characters that do not count at the ends of a word.
EDGES = ".,;:!?\"'()[]"


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _grams(words: list[str], whole: bool = False) -> dict[str, np.ndarray]:
    """For every character of the words and their ends: the word's place in the list, and
    the 64-bit keys of its context and of context with character, of both orders, and itself.
    whole: only the place and the key of the longer context with the character."""
    pad = ORDER - 1
    codes = np.frombuffer("".join("^" * pad + w + "$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) + (word + 1) * pad
    out = {"word": word}
    key = lambda h: mix(h).view(np.int64)
    x = codes[at]
    for order, name in ((BACKOFF_ORDER, "b"), (ORDER, ""))[whole:]:
        # A polynomial in the characters, most recent first, is scrambled once.
        h = codes[at - 1]
        for k in range(2, order):
            h = h * M1 + codes[at - k]
        if not whole:
            out["c" + name] = key(h * M1 + np.uint64(order))
        out["e" + name] = key((h * M1 + x + np.uint64(1 << 32)) * M1 + np.uint64(order))
    out["x"] = x.view(np.int64)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, so that few texts are Python strings at a time."""
    for b in batches:
        for i in range(0, b.num_rows, _ROWS_AT_ONCE):
            yield b.slice(i, _ROWS_AT_ONCE)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class and half, and all documents, that hold a word, summed within the task."""
    docs: Counter[str] = Counter()
    of_slot: list[Counter[str]] = [Counter() for _ in COUNTS]

    def flush() -> pa.RecordBatch:
        cols = [pa.array([c.get(w, 0) for w in docs], pa.int64()) for c in of_slot]
        out = pa.RecordBatch.from_arrays([pa.array(docs.keys(), pa.string()), *cols, pa.array(docs.values(), pa.int64())], ["word", *COUNTS, "docs"])
        for c in (docs, *of_slot):
            c.clear()
        return out

    for b in _slices(batches):
        for text, slot in zip(b.column("text").to_pylist(), b.column("slot").to_pylist(), strict=True):
            words = set(_words(text))
            docs.update(words)
            if slot is not None:
                of_slot[slot].update(words)
            if len(docs) > _REMEMBERED:
                yield flush()
    yield flush()


def _gram_rows(words: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """The distinct 6-grams of the words: their keys, sums of the words' counts, and words."""
    g = _grams(words)
    e, first, place = np.unique(g["e"], return_index=True, return_inverse=True)
    sums = [np.bincount(place, counts[g["word"], k], len(e)).astype(np.int64) for k in range(counts.shape[1])]
    cols = [e, *(g[k][first] for k in _KEYS), *sums, np.bincount(place, minlength=len(e))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["e", *_KEYS, *COUNTS, "docs", "n"])


_KEYS = ("c", "eb", "cb", "x")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: list[str] = []
    counts: list[np.ndarray] = []
    for b in batches:
        words += b.column("word").to_pylist()
        counts.append(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (*COUNTS, "docs")], 1))
        if len(words) >= _WORDS_AT_ONCE:
            yield _gram_rows(words, np.concatenate(counts))
            words, counts = [], []
    if words:
        yield _gram_rows(words, np.concatenate(counts))


def gram_table(words: DataFrame) -> DataFrame:
    """The counts of every 6-gram of a table of words (word, COUNTS, docs)."""
    spec = ", ".join(f"{c} long" for c in (*COUNTS, "docs"))
    grams = words.mapInArrow(released(_count_grams), f"e long, {', '.join(f'{k} long' for k in _KEYS)}, {spec}, n long")
    # A word of punctuation alone has one 6-gram, which no word counts.
    none = {k: int(v[0]) for k, v in _grams([""]).items() if k != "word"} | dict.fromkeys((*COUNTS, "n"), 0) | {"docs": 1 << 40}
    grams = grams.union(words.sparkSession.createDataFrame([tuple(none[c] for c in grams.columns)], grams.schema))
    return grams.groupBy("e").agg(*[F.first(k).alias(k) for k in _KEYS], *[F.sum(c).alias(c) for c in (*COUNTS, "docs", "n")])


def log_likelihoods(events: DataFrame, scratch: Scratch) -> DataFrame:
    """e, docs and, for each 6-gram of the table of counts, the logarithm of the probability of
    its last character after the others, by class and choice of halves: interpolated Kneser-Ney.
    Of the counts c of the class, DISCOUNT is taken from each that is not 0; what is taken from a
    context goes to its characters in proportion to the shared probability, which is made in the
    same way from the continuation counts of the shorter context, and ends in single characters."""
    single = scratch.save(events.groupBy("x").agg(F.sum("n").alias("nx")), "characters")  # one row per character in use
    total = events.agg(F.sum("n")).first()[0]
    shared = events.groupBy("eb").agg(F.first("cb").alias("cb"), F.first("x").alias("x"), F.sum("n").alias("t"))
    around = shared.groupBy("cb").agg(F.sum("t").alias("tot"), F.count(F.when(F.col("t") > 0, 1)).alias("kinds"))
    one = (F.col("nx") + 1.0) / F.lit(float(total + CHARACTERS))
    taken = F.greatest(F.col("t") - DISCOUNT, F.lit(0.0))
    p = F.when(F.col("tot") > 0, (taken + DISCOUNT * F.col("kinds") * one) / F.col("tot")).otherwise(one)
    shared = shared.join(around, "cb").join(small(single), "x").select("eb", p.alias("shared"))
    # Totals of each context and the number of its characters that a class holds, in the halves together and each.
    of = lambda pre, cls, halves: sum((F.col(f"{pre}{cls}{h}") for h in halves), F.lit(0))
    each = [(name, cls, halves) for name, halves in RATIOS.items() for cls in "to"]
    contexts = events.groupBy("c").agg(
        *[F.sum(k).alias(f"tot_{k}") for k in COUNTS], *[F.count(F.when(of("", cls, halves) > 0, 1)).alias(f"kinds_{name}{cls}") for name, cls, halves in each]
    )
    logs = {}
    for name, cls, halves in each:
        c, tot = of("", cls, halves), of("tot_", cls, halves)
        own = (F.greatest(c - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{name}{cls}") * F.col("shared")) / tot
        logs[name, cls] = F.ln(F.when(tot > 0, own).otherwise(F.col("shared")))
    out = [p.alias(f"ln_{name}{cls}") for (name, cls), p in logs.items()]
    return events.join(contexts, "c").join(shared, "eb").select("e", "docs", *out)


def _gram_ratios(events: DataFrame, scratch: Scratch) -> DataFrame:
    """e, docs and the log-likelihood ratios RATIOS of each 6-gram of the table of counts."""
    return log_likelihoods(events, scratch).select("e", "docs", *[(F.col(f"ln_{r}t") - F.col(f"ln_{r}o")).alias(r) for r in RATIOS])


class Head:
    """Ratios of the 6-grams that are sent to the tasks."""

    def __init__(self, rows: pa.Table):
        keys = rows.column("e").to_numpy()
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.column_stack([rows.column(r).to_numpy() for r in RATIOS]).astype(np.float32)[order]

    def positions(self, words: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """The words' 6-grams, their ratios (0 for those not held), and which are held."""
        g = _grams(words, True)
        e, place = np.unique(g["e"], return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, e), len(self.keys) - 1)
        held = self.keys[at] == e
        return g, np.where(held[:, None], self.values[at], 0)[place], held[place]

    def ratios(self, words: list[str], column: int) -> np.ndarray:
        """The words' ratios, not a number for those with a 6-gram that is not held."""
        g, values, held = self.positions(words)
        return np.bincount(g["word"], np.where(held, values[:, column], np.nan), len(words))


def _features(sums: np.ndarray, n: int) -> list[float]:
    """From the sums of ratios over the stretches of a text of n words."""
    if not n:
        return [0.0, 0.0, 0.0]
    top = np.sort(sums)[::-1] / STRETCH
    return [float(sums.sum() / n), float(top[0]), float(top[1]) if len(top) > 1 else 0.0]


class Ratios(dict):
    """Remembered ratios of words for one choice of halves; bounded. Words not met while half of the bound was
    filled are forgotten."""

    def __init__(self, head: Head, column: int):
        self.head, self.column, self.before = head, column, {}

    def learn(self, texts: list[list[str]]) -> None:
        if len(self) > _REMEMBERED // 2:
            self.before = dict(self)
            self.clear()
        new = set().union(*texts).difference(self)
        known = new.intersection(self.before)
        self.update((w, self.before[w]) for w in known)
        new = list(new.difference(known))
        for i in range(0, len(new), _WORDS_AT_ONCE):
            part = new[i : i + _WORDS_AT_ONCE]
            bare = [w.strip(EDGES) for w in part]
            distinct = list(set(bare))
            ratios = dict(zip(distinct, self.head.ratios(distinct, self.column).tolist(), strict=True))
            self.update(zip(part, map(ratios.__getitem__, bare), strict=True))


#: The column of RATIOS for rows of each half, by the model of the other half; last, by both.
_COLUMNS = (2, 1, 0)
_FEATURES = [f"f{k}" for k in range(3)]


def _summed(rows: DataFrame, head, by_half: bool, finish: bool) -> DataFrame:
    """id, label and: if finish is set, the features of each text; else the column of
    ratios, the words' number, the sums over stretches of the ratios of words known to the
    head, and the other words with their stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Ratios(head.value, c) for c in _COLUMNS]
        for b in batches:
            out, missing = [], []
            for piece in _slices(iter([b])):
                part, which = list(map(_words, piece.column("text").to_pylist())), [h if by_half else 2 for h in piece.column("half").to_pylist()]
                for k in set(which):
                    known[k].learn([t for t, h in zip(part, which, strict=True) if h == k])
                for t, h in zip(part, which, strict=True):
                    r = np.fromiter(map(known[h].__getitem__, t), np.float64, len(t))
                    lost = np.flatnonzero(np.isnan(r)).tolist()
                    r[lost] = 0
                    sums = np.concatenate([r, np.zeros(-len(r) % STRETCH)]).reshape(-1, STRETCH).sum(axis=1)
                    out.append(_features(sums, len(t)) if finish else (_COLUMNS[h], len(t), sums))
                    missing.append([{"stretch": j // STRETCH, "word": t[j].strip(EDGES)} for j in lost])
            if finish:
                cols = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * len(_FEATURES)
            else:
                cols = list(zip(*out)) if out else [()] * 3
                kinds = pa.int32(), pa.int32(), pa.list_(pa.float64())
                cols = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                cols.append(pa.array(missing, pa.list_(pa.struct([("stretch", pa.int32()), ("word", pa.string())]))))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), *cols], ["id", "label", *names])

    names = _FEATURES if finish else ["which", "size", "sums", "missing"]
    more = ", ".join(f"{f} double" for f in _FEATURES) if finish else "which int, size int, sums array<double>, missing array<struct<stretch: int, word: string>>"
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "label", "half", "text").mapInArrow(released(run), f"id {kind}, label int, {more}")


def _tail_words(words: DataFrame, tail: DataFrame, head) -> DataFrame:
    """word and the ratios RATIOS of the words that hold a 6-gram of the tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("word").to_pylist()
            g, values, held = head.value.positions(given)
            sums = np.stack([np.bincount(g["word"], values[:, k], len(given)) for k in range(len(RATIOS))], 1)
            lost = g["word"][~held]
            # The head's part of a word's ratio goes with the first 6-gram that is not held.
            own = np.where((np.diff(lost, prepend=-1) != 0)[:, None], sums[lost], 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([given[j] for j in lost], pa.string()), pa.array(g["e"][~held]), *map(pa.array, own.T.copy())], ["word", "e", *(f"h{r}" for r in RATIOS)]
            )

    rows = words.select("word").mapInArrow(released(run), "word string, e long, " + ", ".join(f"h{r} double" for r in RATIOS))
    return rows.join(tail.drop("docs"), "e").groupBy("word").agg(*[F.sum(F.col(r) + F.col(f"h{r}")).alias(r) for r in RATIOS])


def _featured(rows: DataFrame, head, by_half: bool, tail_words: DataFrame | None, scratch: Scratch) -> DataFrame:
    """id, label and the features of each text. by_half: by the model of the other half."""
    if tail_words is None:
        return _summed(rows, head, by_half, True)
    part = scratch.save(_summed(rows, head, by_half, False).withColumn("row", F.monotonically_increasing_id()), "sums")
    lost = part.select("row", "which", F.inline("missing")).join(tail_words, "word")
    ratio = F.element_at(F.array(*RATIOS), F.col("which") + 1)
    adds = lost.groupBy("row").agg(F.collect_list(F.struct("stretch", ratio.alias("r"))).alias("adds"))
    whole = part.select("row", "id", "label", "size", "sums").join(adds, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, sums, more in zip(*(b.column(c).to_pylist() for c in ("size", "sums", "adds")), strict=True):
                sums = np.array(sums, float)
                for a in more or ():
                    sums[a["stretch"]] += a["r"]
                out.append(_features(sums, n))
            cols = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * len(_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), *cols], ["id", "label", *_FEATURES])

    kind = rows.schema["id"].dataType.simpleString()
    return whole.mapInArrow(released(run), f"id {kind}, label int, " + ", ".join(f"{f} double" for f in _FEATURES))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and coefficients of a ridge logistic regression (Newton's method)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_grams: int = MAX_GRAMS,
    key_col: str | None = None,
) -> DataFrame:
    """One row per row of docs: id_col, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Labels of ids whose crc32 (of the id as text) is 0 modulo 5 are held out and never
    learnt from. Null and empty texts get the score of a document without evidence. An id
    labelled twice counts as toxic if any label says so; null labels are none. Without
    labels of both classes the score is the share of toxic ones (0 if there are none).
    Rows that repeat are scored alike; extra columns are ignored. With key_col, a column that
    names rows, the result is (key_col, score, predicted).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    crc = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rest = F.pmod(crc, F.lit(5))
    lab = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).cast("int").alias("label"))
    lab = scratch.save(lab.filter(F.pmod(F.crc32(F.col("lid").cast("string")), F.lit(5)) != 0), "labels")
    by_class = {r["label"]: r["count"] for r in lab.groupBy("label").count().collect()}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not (by_class.get(0) and by_class.get(1)):
        base = float(by_class.get(1, 0) > 0)
        found = [F.lit(base).alias("score"), F.lit(int(base >= 0.5)).alias("predicted")]
        return docs.select(key_col, *found) if key_col else rows.select(F.col("id").alias(id_col), (rest == 0).alias("held_out"), *found)

    half = F.when(rest > 2, 1).otherwise(0)
    known = rows.join(small(lab), F.col("id") == F.col("lid"), "left")
    known = known.withColumn("half", half)
    slot = F.when(F.col("label").isNotNull(), F.when(F.col("label") == 1, 0).otherwise(2) + F.col("half"))
    spec = ", ".join(f"{c} long" for c in (*COUNTS, "docs"))
    words = known.select("text", slot.alias("slot")).mapInArrow(released(_count_words), f"word string, {spec}")
    words = words.withColumn("word", F.btrim("word", F.lit(EDGES))).filter("word <> ''")
    words = scratch.save(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "docs")]), "words")
    grams = scratch.save(gram_table(words), "grams")
    ratios = scratch.save(_gram_ratios(grams, scratch), "ratios")

    if ratios.count() > max_grams:  # the levels of frequency that fit into the head
        level = F.floor(8 * F.log2("docs"))
        least, room = None, max_grams
        for r in ratios.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows
            if least is not None and r["count"] > room:
                break
            least, room = r["level"], room - r["count"]
        top, tail = ratios.filter(level >= least), ratios.filter(level < least)
    else:
        top, tail = ratios, None
    head = spark.sparkContext.broadcast(Head(top.select("e", *RATIOS).toArrow()))  # <= max_grams rows
    tail_words = None if tail is None else scratch.save(_tail_words(words, tail, head), "tail-words")
    scratch.drop(words, grams)
    chosen = None
    for label in (0, 1):
        some = lab.filter(F.col("label") == label).orderBy(F.xxhash64("lid"), "lid").limit(CURVE_ROWS)
        chosen = some if chosen is None else chosen.union(some)
    chosen = scratch.save(chosen, "curve-rows")
    sample = rows.join(F.broadcast(chosen), F.col("id") == F.col("lid")).withColumn("half", half)
    got = _featured(sample.filter(rest != 0), head, True, tail_words, scratch)
    # Ids may repeat: the rows come in a fixed order, so that the bound falls on the same ones.
    got = got.orderBy(F.xxhash64("id"), "label", *_FEATURES).limit(4 * CURVE_ROWS).select("label", *_FEATURES).toArrow().to_pandas()
    if got["label"].nunique() < 2:
        k = len(_FEATURES)
        mean, scale, w = np.zeros(k), np.ones(k), np.append(np.zeros(k), -10.0 if not len(got) or got["label"].max() == 0 else 10.0)
    else:
        share = got["label"].map(lambda x: by_class[x] / max(1, (got["label"] == x).sum())).to_numpy()
        mean, scale, w = _curve(got[_FEATURES].to_numpy(), got["label"].to_numpy(float), share / share.mean())
    asked = docs.select(F.col(key_col or id_col).alias("id"), F.col(text_col).alias("text"))
    out = _featured(asked.withColumn("label", F.lit(0)).withColumn("half", F.lit(0)), head, False, tail_words, scratch)
    z = F.lit(float(w[-1]))
    for k in range(len(_FEATURES)):
        z = z + (F.col(f"f{k}") - float(mean[k])) / float(scale[k]) * float(w[k])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    held_out = [] if key_col else [(rest == 0).alias("held_out")]
    return out.withColumn("score", score).select(F.col("id").alias(key_col or id_col), *held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows predicted toxic, each judged by its own text, also where ids are null or repeat;
    columns as given."""
    scratch = Scratch(docs.sparkSession, "keep-clean")
    rows, key = row_key(docs, id_col, scratch)
    scores = toxicity_scores(rows, labels, id_col, key_col=key, **options)
    bad = scratch.save(scores.filter("predicted = 1").select(key), "toxic")
    return drop_ids(rows, bad, key).select(*docs.columns)
