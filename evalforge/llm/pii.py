"""Personal data in texts, found by base patterns and by weak supervision.

Base spans (e-mail, IP address, card, phone) follow fixed rules and always stay. Further
candidates (secrets, social security numbers, bank accounts, phones in local form) are
voted on by labelers: the shape by regular expression, gazetteers of prefixes and country
codes, and context words before the span. No labels exist, so expectation-maximisation
estimates how reliable each labeler is from how the votes agree over the whole corpus. Its
posteriors are the labels on which a logistic span classifier is trained; this does not see
the votes but the span (kind, length, share of digits, case, variety) and what stands around
it (characters and words on both sides), and its spans are added.

Scale: texts are read once, in place. What is gathered are counts of patterns, a pattern
being the votes on a candidate and its features, all of few values: their number is bounded
by these (VOTES ** LABELERS times the values of FEATURES a kind), not by the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ssn", "iban", "phone_local")
KINDS = BASE + ADDED

# Base patterns: fixed values of the contract.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@=:]")
_DIGIT = re.compile(r"[0-9]")

_SECRET = re.compile(r"""\b(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?([A-Za-z0-9+/_=.-]{6,})""", re.I)
_LONG = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")

# Gazetteers.
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "glpat-")
_COUNTRIES = set("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_FOR = {
    "secret": ("password", "passwd", "token", "secret", "key", "credential", "login", "pwd", "auth"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "phone_local": ("call", "phone", "tel", "mobile", "fax", "cell", "contact"),
}
_AGAINST = ("isbn", "version", "order", "invoice", "commit", "build", "sha", "serial", "model", "http", "www", "figure", "page")
LABELERS, VOTES = 5, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping within a kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def _votes(text: str, start: int, end: int, kind: str) -> str:
    """The votes of the labelers on a candidate, as digits: 0 against, 1 none, 2 for."""
    s, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    if kind == "secret":
        shape = 2 if digits >= 2 and letters >= 2 and len(s) >= 12 else 0 if not digits or not letters else 1
        known = 2 if s.startswith(_PREFIXES) else 1
    elif kind == "ssn":
        shape = 0 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 2
        known = 1
    elif kind == "iban":
        moved = s[4:] + s[:4]
        shape = 2 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else 0
        known = 2 if s[:2] in _COUNTRIES else 0
    else:
        plain = [c for c in s if c.isdigit()]
        shape = 2 if plain[0] not in "01" and plain[3] not in "01" else 0
        known = 2 if "".join(plain[:3]) in ("800", "888", "877") else 1
    near = 2 if any(w in before for w in _FOR[kind]) else 1
    against = 0 if any(w in before for w in _AGAINST) else 1
    variety = 2 if len(set(s)) >= min(8, len(s) // 2) else 0
    return f"{shape}{known}{near}{against}{variety}"


#: Features of a candidate and how many values each has.
FEATURES = {"length": 6, "digits": 5, "case": 4, "variety": 4, "before": 6, "after": 6, "word": 3}


def _beside(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c in "=:" else 3 if c in "\"'`" else 4 if c.isalnum() else 5


def _features(text: str, start: int, end: int) -> str:
    """The values of FEATURES, as digits."""
    s, n = text[start:end], end - start
    digits, upper, lower = sum(c.isdigit() for c in s), any(c.isupper() for c in s), any(c.islower() for c in s)
    word = text[max(0, start - 40) : start].rstrip(" \t\"'`")
    named = 0 if not word else 2 if word[-1] in "=:" else 1
    values = (
        sum(n > x for x in (8, 12, 20, 32, 64)), 0 if not digits else min(4, 1 + 4 * digits // n), 2 * upper + lower,
        sum(len(set(s)) > x for x in (4, 8, 12)), _beside(text[start - 1 : start] if start else ""), _beside(text[end : end + 1]), named,
    )
    return "".join(map(str, values))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pattern: kind, votes and features) of candidates that touch no base span nor each other."""
    found = [(*m.span(1), "secret") for m in _SECRET.finditer(text)] if "=" in text or ":" in text else []
    if _DIGIT.search(text):
        found += [(*m.span(), "secret") for m in _LONG.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
        for kind, pattern in (("ssn", _SSN), ("iban", _IBAN), ("phone_local", _LOCAL_PHONE)):
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    out, last, k = [], 0, 0
    by_start = sorted((s, e) for s, e, _ in base)
    reach = 0
    for s, e, kind in sorted(found, key=lambda c: (c[0], -c[1], KINDS.index(c[2]))):
        while k < len(by_start) and by_start[k][0] < e:
            reach = max(reach, by_start[k][1])
            k += 1
        if s >= last and s >= reach:
            out.append((s, e, kind, f"{kind}:{_votes(text, s, e, kind)}:{_features(text, s, e)}"))
            last = e
    return out


def reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each pattern (kind:votes) being personal data, by expectation-
    maximisation over labelers that are independent given the truth."""
    votes = np.array([[int(v) for v in p.split(":")[1]] for p in patterns])
    # Start from the balance of votes.
    belief = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1)))
    for _ in range(rounds):
        log = np.zeros((len(patterns), 2))
        for y, weight in ((0, counts * (1 - belief)), (1, counts * belief)):
            log[:, y] = np.log(weight.sum() + 1)
            for k in range(LABELERS):
                # A prior that labelers are better than chance keeps the classes in place.
                prior = np.array([1.0, 2.0, 4.0]) if y else np.array([4.0, 2.0, 1.0])
                seen = np.bincount(votes[:, k], weight, VOTES) + prior
                log[:, y] += np.log(seen / seen.sum())[votes[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
    return belief


def _encoded(patterns: list[str]) -> np.ndarray:
    """One row per pattern: the kind and, for each kind, each feature's value, one-hot."""
    rows = []
    for p in patterns:
        kind, _, values = p.split(":")
        row = [1.0]
        for k in ADDED:
            row += [float(k == kind)] + [float(k == kind and int(v) == x) for v, n in zip(values, FEATURES.values(), strict=True) for x in range(n)]
        rows.append(row)
    return np.array(rows)


def span_classifier(patterns: list[str], counts: np.ndarray) -> dict[str, float]:
    """Probability by pattern of a logistic classifier of span features, trained on the
    posteriors of the votes (patterns that share features are one case with all their weight)."""
    if not patterns:
        return {}
    x, y, n = _encoded(patterns), reliabilities(patterns, counts), np.log1p(counts)
    x = x[:, x.any(0)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (n * (p - y)) + 0.05 * w)
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, base and added, arrays of (start, end, kind) in code
    points, end exclusive, by start and then kind.

    Null and empty texts have no spans. A base match that fails its check is dropped and not
    tried again. Repeated rows are searched each; they count each in the vote patterns.
    Without candidates nothing is added. Null ids and extra columns do no harm.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    span, cand = "array<struct<start:int,end:int,kind:string>>", "array<struct<start:int,end:int,kind:string,pattern:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("kind", pa.string())]
        for b in batches:
            base, more = [], []
            for text in b.column("text").to_pylist():
                found = base_spans(text) if text and _ANY.search(text) else []
                base.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in found])
                extra = candidates(text, found) if text and _ANY.search(text) else []
                more.append([dict(zip(("start", "end", "kind", "pattern"), s, strict=True)) for s in extra])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(base, pa.list_(pa.struct(fields))), pa.array(more, pa.list_(pa.struct([*fields, pa.field("pattern", pa.string())])))], ["id", "base", "more"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = scratch.save(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base {span}, more {cand}"), "candidates")
    counted = rows.select(F.explode("more.pattern").alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect()  # bounded by the votes
    chance = span_classifier([r[0] for r in counted], np.array([float(r[1]) for r in counted]))
    accepted = F.array(*[F.lit(p) for p, c in chance.items() if c >= 0.5]).cast("array<string>")
    added = F.transform(F.filter("more", lambda c: F.array_contains(accepted, c["pattern"])), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return rows.select(F.col("id").alias(id_col), "base", added.alias("added"))


def digests(docs: DataFrame) -> DataFrame:
    found = personal_data(docs)
    order = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
            lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]),
        ),
        ",",
    )
    kinds = lambda spans: F.transform(spans, lambda s: s["kind"])
    n = [(F.size(spans) - F.size(F.array_remove(kinds(spans), k))).cast("long").alias(f"n_{k}") for spans, of in (("base", BASE), ("added", ADDED)) for k in of]
    n.append((F.size("base") + F.size("added")).cast("long").alias("n_spans"))
    base, more = n[: len(BASE)], n[len(BASE) :]
    return found.select("doc_id", *base, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), *more)
