"""Language identification in two levels: first the family, then one-versus-one linear
support vector machines between the languages of that family.

Features are hashed letter bigrams and trigrams of the whole text (4096 dimensions,
square roots of counts, unit length). All machines are linear with squared hinge loss,
fitted by dual coordinate descent on a bounded sample of labelled rows: about SAMPLE rows
in all, shared evenly by the languages, chosen by a hash of the id. So the driver holds
at most about 64 MB of features, and the model that tasks get is 16 kB a pair of languages.

Scale: one pass for the sample, one for the predictions; nothing is shuffled but counts
per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM_BITS = 12
SAMPLE = 4000
UNKNOWN = "und"
#: Families of language codes. A code not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, langs in families.items() if lang in langs), lang)


@cache
def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def featurize(text: str | None) -> np.ndarray | None:
    """The feature vector of a text; None without any letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[np.minimum(codes, 0xFFFF)]
    if (high := codes > 0xFFFF).any():
        kinds, which = np.unique(codes[high], return_inverse=True)
        is_letter = is_letter.copy()
        is_letter[high] = np.array([chr(c).isalpha() for c in kinds])[which]
    if not is_letter.any():
        return None
    c = np.where(is_letter, codes, np.uint32(32))
    c = np.concatenate([np.array([32], np.uint32), c, np.array([32], np.uint32)])
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    h = np.concatenate([two, three])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = np.sqrt(np.bincount(h >> np.uint32(32 - DIM_BITS), minlength=1 << DIM_BITS)).astype(np.float32)
    return x / np.linalg.norm(x)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (and bias last) of a linear machine with squared hinge loss; y is +-1."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float64)
    norms, alpha, w = (x * x).sum(1) + 0.5 / c, np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c) / norms[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


class Machines:
    """One-versus-one machines between some classes."""

    def __init__(self, classes: list[str], x: np.ndarray, labels: np.ndarray):
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        weights = []
        for a, b in self.pairs:
            of = np.isin(labels, [classes[a], classes[b]])
            weights.append(svm(x[of], np.where(labels[of] == classes[a], 1.0, -1.0)))
        self.weights = np.array(weights, np.float32) if weights else np.zeros((0, x.shape[1] + 1), np.float32)

    def __call__(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most votes (then the larger sum of margins), and a confidence."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            votes[a if m > 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(self.classes)), key=lambda k: (votes[k], sums[k]))
        least = min(m if a == best else -m for (a, b), m in zip(self.pairs, margins.tolist(), strict=True) if best in (a, b))
        return self.classes[best], 1 / (1 + float(np.exp(-np.clip(4 * least, -30, 30))))


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: np.ndarray, families: dict[str, tuple[str, ...]]):
        fams = np.array([family_of(v, families) for v in langs])
        self.top = Machines(sorted(set(fams)), x, fams)
        self.within = {f: Machines(sorted(set(langs[fams == f])), x[fams == f], langs[fams == f]) for f in self.top.classes}

    def __call__(self, text: str | None) -> tuple[str, float]:
        if (x := featurize(text)) is None:
            return UNKNOWN, 0.0
        family, sure = self.top(x)
        lang, also = self.within[family](x)
        return lang, sure * also


def predict_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, families: dict[str, tuple[str, ...]] = FAMILIES
) -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score (0 to 1).

    Rows whose crc32 (of the id as text) is 2 modulo 4 are held out and never learnt from;
    rows with a null language or without a letter neither. Null texts and texts without a
    letter get "und" with score 0, as do all texts if nothing can be learnt. Null ids are
    not held out. Repeated rows are predicted alike; extra columns are ignored.
    """
    spark = docs.sparkSession
    held_out = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(4)) == 2
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.filter(~held_out & F.col("lang").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    each = max(20, sample // max(1, len(counts)))
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    share = F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0.0))
    place = F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(1 << 30)) / float(1 << 30)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, x.tobytes()) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if (x := featurize(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], ["lang", "x"])

    got = known.filter(place < share).select("lang", "text").mapInArrow(vectors, "lang string, x binary").toArrow().to_pandas()
    model = None
    if len(got):
        got = got.sort_values(["lang", "x"])
        model = Hierarchy(np.stack([np.frombuffer(v, np.float32) for v in got["x"]]), got["lang"].to_numpy(str), families)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value(t) if shared.value else (UNKNOWN, 0.0) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["id", "lang_pred", "score"])

    out = rows.select("id", "text").mapInArrow(predict, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out.alias("held_out"), "lang_pred", "score")
