"""The ten operators against brute force, on small texts with nulls, empties, ties, repeats,
clashing extra columns and empty tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalforge.llm import decontamination, exact_dedup, html_extract, language_id, mixing, ngram_join, pii, substring_dedup, toxicity, warc
from evalforge.llm.common import Scratch

SPEC = "doc_id long, text string, lang string, source string, n_chars long, id string, name string, word string"


def words(seed: int, n: int) -> list[str]:
    return [f"w{int(hashlib.md5(f'{seed}|{i}'.encode()).hexdigest(), 16) % 997}" for i in range(n)]


def corpus() -> list[tuple]:
    base = words(1, 120)
    edited = list(base)
    edited[60] = "changed"
    twice = list(edited)
    twice[10] = "again"
    passage = words(7, 60)
    texts = [
        None, "", "   \n\t ", "one", "One", "two words", " ".join(base), " ".join(base), " ".join(edited), " ".join(twice),
        " ".join(words(2, 30) + passage + words(3, 30)), " ".join(passage), " ".join(words(4, 10) + passage), " ".join(base[:50]), " ".join(base[:49]),
        "x" * 30000, "é ü " * 300, " ".join(words(5, 6000)), " ".join(words(5, 6000)[:5990] + ["tail"]), " ".join(["same"] * 200), "A b c d",
    ]
    rows = [(3 * i + 2, t, "en", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, "s1"), rows[6], rows[8]]
    return [(*r, 1, "e", "n", "w") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SPEC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SPEC)


def rows_of(df, *cols) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [(x is not None, str(x)) for x in r])


def text_words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_groups(docs, block_bytes=64).collect()
    data = corpus()
    assert len(got) == len(data)
    for r in got:
        same = [(d[0], d[1] or "") for d in data if hashlib.sha256((d[1] or "").encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(same)
        assert r["keep_id"] == max((i for i, _ in same if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len({d[1] or "" for d in data})
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({d[1] or "" for d in data})
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_block_names_do_not_depend_on_block_size(docs):
    a, b = (exact_dedup.exact_groups(docs, block_bytes=n) for n in (7, 8192))
    assert rows_of(a, "doc_id", "keep_id", "group_size") == rows_of(b, "doc_id", "keep_id", "group_size")


def test_block_names_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "NAMES_PER_RANGE", 40)
    df = spark.createDataFrame([(i, " ".join(words(i % 90, 30))) for i in range(300)], "doc_id long, text string")
    a, b = (exact_dedup.block_identities(d, block_bytes=16) for d in (df.repartition(2), df.repartition(7)))
    assert rows_of(a, "id", "level", "name") == rows_of(b, "id", "level", "name")
    assert a.select("level", "name").distinct().count() == 90
    names = exact_dedup._numbered(df.select(F.crc32("text").alias("c")).distinct(), "c", scratch=Scratch(spark, "t"))
    assert sorted(r["name"] for r in names.collect()) == list(range(1, 91))


def sets_of(n: int) -> dict[int, set]:
    out: dict[int, set] = {}
    for d in corpus():
        w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in text_words(d[1])]
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        if d[0] is not None:
            out[d[0]] = s
    return out


@pytest.mark.parametrize(("n", "similarity"), [(3, 0.9), (5, 0.8)])
def test_ngram_join(docs, empty, n, similarity):
    sets = sets_of(n)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        u = len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= round(100 * similarity) * u:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = ngram_join.similar_groups(docs, n=n, similarity=similarity)
    assert got.count() == len(corpus())
    for r in got.filter("doc_id IS NOT NULL").collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    kept = ngram_join.one_per_group(docs, n=n, similarity=similarity).filter("doc_id IS NOT NULL")
    assert {r["doc_id"] for r in kept.collect()} == {find(i) for i in sets}
    assert ngram_join.similar_groups(empty).count() == 0


def test_ngram_join_of_many_near_copies(spark):
    base = words(11, 200)
    texts = []
    for i in range(150):
        w = list(base)
        for k in range(i % 12):
            w[int(hashlib.md5(f"{i}|{k}".encode()).hexdigest(), 16) % 200] = f"edit{i}x{k}"
        texts.append(w)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in texts]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(150), 2):
        if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(df, n=3, similarity=0.9).collect()}
    assert got == {i: find(i) for i in range(150)}


@pytest.mark.parametrize("kind", [None, (1, 0), (0, 1), (2, 3)])
def test_every_link_shares_the_signatures_it_needs(kind, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    if kind:  # each way of matching alone, else what the cost model chooses
        monkeypatch.setattr(ngram_join, "KINDS", [kind])
    bands = ngram_join.Bands(90, 500, {b: (10**6, 1.2 * 1.5**b) for b in range(40)})
    seen = 0
    for size in (10, 12, 19, 31, 60, 144, 300):
        for lost in range(8):
            for _ in range(12):
                x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                d = int(len(x) * 20 / 190)
                cut = min(d, lost)
                y = np.unique(np.concatenate([x[cut:], rng.integers(0, 2**63, d - cut).astype(np.uint64)]))
                both = len(np.intersect1d(x, y))
                if 100 * both < 90 * (len(x) + len(y) - both) or np.array_equal(x, y):
                    continue
                a, b = ({band: (set(s.tolist()), need) for s, band, need in bands.signatures(v)} for v in (x, y))
                band = int(np.searchsorted(bands.starts, min(len(x), len(y)), "right")) - 1
                shared = len(a[band][0] & b[band][0])
                assert shared >= max(1, a[band][1], b[band][1])
                seen += 1
    assert seen > 300


def test_substring_dedup(docs, empty):
    data = corpus()
    first: dict[tuple, int] = {}
    for d in data:
        w = text_words(d[1])
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if d[0] is not None:
                first[key] = min(first.get(key, d[0]), d[0])
    want = []
    for d in data:
        w, gone = text_words(d[1]), set()
        for i in range(len(w) - 49):
            if d[0] is not None and first[tuple(w[i : i + 50])] < d[0]:
                gone |= set(range(i, i + 50))
        want.append((d[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = rows_of(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(want, key=lambda r: [(x is not None, str(x)) for x in r])
    assert sum(r[2] for r in got) > 300
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_pieces_do_not_depend_on_runs_of_texts(monkeypatch):
    texts = [" ".join(f"w{i * j % 89}" for i in range(70 * j)) for j in range(1, 9)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"id": list(range(10)), "print": list(range(10)), "text": pa.array(texts, pa.string())})
    want = [r for b in substring_dedup._find_pieces(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(substring_dedup, "text_runs", lambda b: ngram_join.pieces(b, 1000))
    got = list(substring_dedup._find_pieces(iter([batch])))
    assert len(got) > 3 and [r for b in got for r in b.to_pylist()] == want and len(want) > 8


@pytest.mark.parametrize("bits", [24, 7])
def test_anchors_of_long_runs(bits, monkeypatch):
    import numpy as np

    monkeypatch.setattr(substring_dedup, "PLACE_BITS", bits)
    w = substring_dedup.Windows([b" ".join(b"w%d" % (i * i % 97) for i in range(900))], substring_dedup.WordHashes())
    grams = w.of(np.arange(900 - substring_dedup.GRAM + 1), substring_dedup.GRAM)
    cut = [int(g) >> bits for g in grams]
    want = [min(range(i, i + substring_dedup.REACH), key=lambda k: (cut[k], k)) for i in range(len(grams) - substring_dedup.REACH + 1)]
    assert w.anchors(grams).tolist() == want


def test_mixing(docs, empty, spark):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus())
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    sizes = {d[0]: len(text_words(d[1])) for d in corpus()}
    assert all(r["size"] == sizes[r["doc_id"]] for r in got)
    assert rows_of(mixing.mix(docs), "doc_id", "taken", "target") == rows_of(mixing.mix(docs.repartition(5)), "doc_id", "taken", "target")
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    by = mixing.mix(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.sum("size").alias("n")).collect()
    assert sum(r["g"] for r in by) == pytest.approx(sum(r["n"] for r in by))
    assert all(abs(r["t"] - r["g"]) < 0.02 * r["g"] for r in by)
    copies = mixing.mixed(many)
    assert copies.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["t"] for r in by)
    assert mixing.mix(empty).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert t["a"] == 30 and t[None] == 15
    assert t["b"] + t["c"] == pytest.approx(2015 - 45) and t["b"] == pytest.approx(2 * t["c"])


def test_decontamination(docs, empty, spark):
    item = " ".join(words(7, 60)[5:45])
    near = " ".join(["other", *words(7, 60)[6:45]])
    items = spark.createDataFrame([(1, item, "x"), (2, near, "x"), (3, None, "x"), (4, "", "x"), (5, "Two  WORDS!", "x"), (1, item, "x")], "item_id long, text string, lang string")
    got = decontamination.contained_items(docs, items)
    data, want = corpus(), set()
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\W_]+", (t or "").lower())) else set()
    for d in data:
        for i, t in ((1, item), (2, near), (5, "two words")):
            g = grams(t)
            if 100 * len(g & grams(d[1])) >= 80 * len(g):
                want.add((d[0], i, len(g), len(g & grams(d[1]))))
    assert {tuple(r)[:4] for r in got.collect()} == want and len(want) >= 6
    clean = decontamination.decontaminated(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {d[0] for d in data} - {w[0] for w in want}
    assert decontamination.contained_items(empty, items).count() == 0
    assert decontamination.contained_items(docs, items.limit(0)).count() == 0


PAGE = """<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; more</h1><p>First, with <a href=x>a link</a>, and
 enough text.<p>Second &#8212; para&nbsp;here, long enough.<div class="ad">Buy, now, this, thing, today</div></article><aside>side, bar, text, is, here</aside>
<div id=comments><p>A reader, says, something, long, about it, all.</p></div><footer>f, f, f</footer>"""


def test_html(spark):
    pages = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "", "", 5), (None, "u", "<p>just <b>text", 5), (1, "u", PAGE, 5), (4, "u", "<a<b <p>&am", 5), (5, "u", "<div>" * 3000 + "deep, text here", 5)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text int")).collect()}
    want = "Head & more\n\nFirst, with a link, and enough text.\n\nSecond — para here, long enough."
    assert got[1] == (want, len(want))
    assert got[2] == got[3] == ("", 0)
    assert got[None][0] == "just text" and got[5][0] == "deep, text here"


@pytest.mark.parametrize("depth", [5, 600, 5000])
def test_html_of_any_depth(depth):
    deep = lambda s: "<div>" * depth + s + "</div>" * depth
    text = "<p>This, then, is the text of the article.</p>"
    assert html_extract.main_text(deep("<nav>A menu, that, nobody, wants to read</nav>") + text) == "This, then, is the text of the article."
    after = "<p>This comes, as it were, after the article.</p>"
    assert html_extract.main_text(f"<article>{deep(text)}</article>{after}") == "This, then, is the text of the article."
    assert html_extract.main_text(deep(f"<footer>{text}</footer>") + after) == "This comes, as it were, after the article."


def test_html_names_do_not_outweigh_the_text():
    long = "One, two, three, four and more words to read. " * 12
    p = f"<p>{long}</p>"
    for name in ("content has-sidebar", "no-sidebar", "overflow-hidden", "story comments-open", "sidebar"):
        assert html_extract.main_text(f'<div class="{name}">{p}{p}</div>') == "\n\n".join([long.strip()] * 2)
    inside = html_extract.main_text(f'<div class="post"><h2 class="section-header">Head</h2><p class="notice-text">{long}</p>{p}<div class="share-bar">Tell, all, your friends about this</div></div>')
    assert inside == "\n\n".join(["Head", long.strip(), long.strip()])
    assert html_extract.main_text(f'<div class="post">{p}</div><div id="comments">{p * 3}</div><div class="cookie-notice">{p}</div>') == long.strip()


def test_html_is_linear_and_takes_empty_tables(spark):
    import time

    for page in ("<div>" * 60_000 + "x", "<b>" * 60_000 + "</i>" * 60_000, "<h1>" * 60_000 + "<p>" * 60_000, "<li>" * 60_000, "<ul><li>" * 60_000, "<b><div>" * 999 + "<i>" * 60_000 + "</b>" * 60_000, "<p>word, " * 100_000):
        t = time.time()
        html_extract.main_text(page)
        assert time.time() - t < 20
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc(spark):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 50_000), (6, "u", "other"), (None, "u", "same"), (6, "u", "other")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, size int").repartition(2)
    scratch = Scratch(spark, "test-warc")
    files = scratch.save(warc.write(df, scratch.path()))
    for split in (300, 4 << 20):
        got = warc.read(files, split_bytes=split).collect()
        assert len(got) == len(pages) and all(r["intact"] for r in got)
    best = {h: max(p[0] for p in pages if (p[2] or "") == h and p[0]) for h in {p[2] or "" for p in pages}}
    by = {(p[0], p[2] or "") for p in pages}
    for r in got:
        html = next(h for i, h in by if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == best[html] else ("revisit", best[html]))
        assert r["record_type"] == "revisit" or r["payload"].decode() == html
    assert warc.read(Scratch(spark, "t").save(warc.write(df.limit(0), scratch.path()))).count() == 0


def test_warc_of_long_records(spark):
    import random

    noise = random.Random(4)
    big = "".join(chr(noise.randrange(0x4E00, 0x9FFF)) for _ in range(1_200_000))  # beyond CHUNK even when packed
    magic = "\x1f\x8b\x08 WARC/1.1 " * 3000
    df = spark.createDataFrame([(1, "http://a", big), (2, "http://b", magic), (3, None, "<p>"), (4, "http://c", big)], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r for r in warc.round_trip(spark, df).collect()}
    assert len(got) == 4 and all(r["intact"] for r in got.values())
    assert got[1]["payload_bytes"] == len(big.encode()) and (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 4)
    assert got[2]["payload_digest"] == base64.b32encode(hashlib.sha1(magic.encode()).digest()).decode()
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_pii(spark, docs, empty):
    text = "é mail a.b@c.de.uk, x@y 1.2.3.4 999.1.1.1 then 4111 1111-1111 1111 and 4111111111111112 call +1 (555) 123-4567 password=f7c8b4419544ffc2cf end"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (1, text, 0)], "doc_id long, text string, base int")
    r = next(x for x in pii.digests(df).collect() if x["doc_id"] == 1)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    base = [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE]
    assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
    kind, start, end = next(s for s in r["spans"].split(",") if s.startswith("secret")).split(":")
    assert text[int(start) : int(end)] == "f7c8b4419544ffc2cf"
    assert pii.digests(docs).count() == len(corpus()) and pii.digests(empty).count() == 0


def test_long_secrets_are_whole(spark):
    long, bare = "a1B2" * 60, "x9Y_" * 40
    rows = [(0, f'password = "{long}" and', 0), (1, f"see {bare} there", 0)] + [(2 + i, f"token={hashlib.md5(str(i).encode()).hexdigest()}", 0) for i in range(30)]
    got = {r["doc_id"]: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()}
    assert got[0]["spans"] == f"secret:12:{12 + len(long)}" and got[0]["n_secret"] == got[0]["n_spans"] == 1
    found = pii.candidates(rows[1][1], [])
    assert [f[:3] for f in found] == [(4, 4 + len(bare), "secret")]
    assert all(got[2 + i]["n_secret"] == 1 for i in range(30))


def test_votes_are_weighed_by_reliability():
    """Made-up votes: three labelers are right nine times in ten, two guess; the posteriors find the truth."""
    import random

    random.seed(9)
    counts: dict[str, list] = {}
    for _ in range(6000):
        truth = random.random() < 0.5
        good = [2 * truth if random.random() < 0.9 else 2 - 2 * truth for _ in range(3)]
        p = "secret:" + "".join(map(str, good + [random.choice((0, 1, 2)) for _ in range(2)])) + ":0000000"
        counts.setdefault(p, [0, 0])[truth] += 1
    patterns = sorted(counts)
    belief = pii.reliabilities(patterns, __import__("numpy").array([float(sum(counts[p])) for p in patterns]))
    right = sum(counts[p][int(b > 0.5)] for p, b in zip(patterns, belief, strict=True))
    assert right >= 0.96 * 6000


def test_cards_follow_the_pattern():
    import random

    random.seed(6)
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    seen = 0
    for _ in range(4000):
        t = "".join(random.choice("0123456789" * 3 + " -a+") for _ in range(50))
        want = []
        for m in card.finditer(t):
            d = [int(c) for c in m[0] if c.isdigit()]
            twice = [sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))]
            if 12 <= len(d) <= 19 and sum(twice) % 10 == 0:
                want.append((m.start(), m.end(), "card"))
        seen += len(want)
        assert [s for s in pii.base_spans(t) if s[2] == "card"] == want
    assert seen > 50


def test_base_spans_follow_the_patterns():
    import random

    random.seed(5)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(3000):
        t = "".join(random.choice("a@@..12 9+-(é") for _ in range(60))
        want = [(m.start(), m.end(), "email") for m in email.finditer(t)]
        want += [(m.start(), m.end(), "ip") for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), m.end(), "phone") for m in phone.finditer(t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
        got = [s for s in pii.base_spans(t) if s[2] != "card"]
        assert sorted(got) == sorted(want), t


def test_language(spark, sf, docs, empty):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.predict_languages(d.withColumn("id", F.lit("x"))).join(d.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_languages(docs).collect()}
    assert odd[2] == odd[5] == odd[8] == "und" and odd[11] == "en"
    assert {r["lang_pred"] for r in language_id.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.predict_languages(empty).count() == 0


def test_toxicity(spark, empty):
    bad = ["idiotic", "trashy", "scummy", "moronic"]
    data = []
    for i in range(1200):
        w = words(i, 40 + i % 50)
        if i % 4 == 0:
            w[5] = w[20] = bad[i // 4 % 4]
        data.append((i, " ".join(w), 1))
    df = spark.createDataFrame([*data, (None, None, 1), (5000, "", 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 1200)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(df, labels)
    got = out.filter("held_out AND doc_id < 1200").collect()
    right = sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)
    assert right >= 0.95 * len(got) and out.count() == 1202
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert toxicity.toxicity_scores(df, labels.filter("toxic = 0")).filter("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.keep_clean(df, labels).columns == df.columns


def test_toxicity_counts_each_gram(spark):
    """As many counts as there are n-grams, and the same scores when few of them are sent to the tasks."""
    given = [hashlib.md5(str(i).encode()).hexdigest() for i in range(20000)]
    g = toxicity._grams(given)
    for order, c, e in ((6, "c", "e"), (4, "cb", "eb")):
        padded = ["^" * (order - 1) + w + "$" for w in given]
        assert len(set(g[e].tolist())) == len({p[i : i + order] for p in padded for i in range(len(p) - order + 1)})
        assert len(set(g[c].tolist())) == len({p[i : i + order - 1] for p in padded for i in range(len(p) - order + 1)})
    data = [(i, " ".join(words(i, 40 + i % 50) + ["-", "..."] + ["scummy" if i % 4 == 0 else "fine", f"é{i}x"]), 1) for i in range(300)]
    df = spark.createDataFrame([*data, data[3], (None, None, 1), (5000, "", 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    whole, joined = ([tuple(r) for r in toxicity.toxicity_scores(df, labels, **o).orderBy("doc_id", "score").collect()] for o in ({}, {"max_grams": 60}))
    assert len(whole) == 303 and {r[2] for r in whole if r[0] == 4} != {r[2] for r in whole if r[0] == 5}
    assert [(r[0], r[1], r[3]) for r in whole] == [(r[0], r[1], r[3]) for r in joined]
    assert max(abs(a[2] - b[2]) for a, b in zip(whole, joined, strict=True)) < 1e-4


def test_toxicity_is_an_interpolated_kneser_ney(spark):
    """The probabilities equal those of plain dictionaries, and those of each context sum to one."""
    from collections import Counter, defaultdict
    from math import exp

    given = [("scum", 3, 1, 0, 0), ("scummy", 0, 2, 1, 0), ("sum", 0, 0, 4, 5), ("some", 1, 0, 9, 2), ("x", 0, 0, 0, 1), ("summer", 0, 0, 0, 0), ("ée", 0, 1, 1, 1)]
    table = spark.createDataFrame([(*w, sum(w[1:])) for w in given], "word string, t0 long, t1 long, o0 long, o1 long, docs long")
    scratch = Scratch(spark, "test-kn")
    got = {r["e"]: r for r in toxicity.log_likelihoods(scratch.save(toxicity.gram_table(table)), scratch).collect()}
    own, types, chars = defaultdict(Counter), defaultdict(Counter), Counter()
    pick = {"r": (0, 1), "r0": (0,), "r1": (1,)}
    for w, *counts in given:
        p = "^" * 5 + w + "$"
        for i in range(5, len(p)):
            types[p[i - 3 : i]][p[i]] += 1
            chars[p[i]] += 1
            for name, halves in pick.items():
                for k, cls in enumerate("to"):
                    own[name, cls, p[i - 5 : i]][p[i]] += sum(counts[2 * k + h] for h in halves)
    total = sum(chars.values()) + toxicity.CHARACTERS
    one = lambda x: (chars[x] + 1) / total

    def mixed(counts, x, below):
        tot = sum(counts.values())
        return (max(counts[x] - 0.75, 0) + 0.75 * sum(c > 0 for c in counts.values()) * below) / tot if tot else below

    chance = lambda name, cls, ctx, x: mixed(own[name, cls, ctx], x, mixed(types[ctx[2:]], x, one(x)))
    seen = 0
    for w, *_ in given:
        p, g = "^" * 5 + w + "$", toxicity._grams([w])
        for j, e in enumerate(g["e"].tolist()):
            ctx, x = p[j : j + 5], p[j + 5]
            for name in pick:
                for cls in "to":
                    assert exp(got[e][f"ln_{name}{cls}"]) == pytest.approx(chance(name, cls, ctx, x))
                    rest = (toxicity.CHARACTERS - len(chars)) * chance(name, cls, ctx, "~")
                    assert sum(chance(name, cls, ctx, c) for c in chars) + rest == pytest.approx(1)
                    seen += 1
    assert seen > 150


def test_ngram_join_rows_without_a_name_of_their_own(spark):
    """Texts that null or shared ids hold link like any other."""
    base = words(11, 150)
    change = lambda *at: " ".join("changed" if i in at else w for i, w in enumerate(base))
    far = words(12, 150)
    near = " ".join([*far[:-1], "other"])
    rows = [(None, change()), (1, change(3)), (2, change(140)), (7, " ".join(far)), (7, "nothing like it"), (7, None), (5, near), (None, "alone here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_groups(df, n=3, similarity=0.9).collect()
    assert len(got) == len(rows)
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(
        map(str, [(None, 148, 1), (1, 148, 1), (2, 148, 1), (7, 148, 5), (7, 1, 7), (7, 0, 7), (5, 148, 5), (None, 1, None), (None, 0, None)])
    )


def test_mixed_emits_each_row(spark):
    """As many copies as the mix takes, of rows with null and shared ids too."""
    rows = [(i if i % 3 else None if i % 2 else 9, " ".join(words(i, 5 + i)), f"s{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((str(r["doc_id"]), r["size"]) for r in mixing.mix(df).collect() for _ in range(r["copies"]))
    got = mixing.mixed(df)
    assert got.columns == ["doc_id", "text", "source", "copy"]
    assert sorted((str(r["doc_id"]), len(r["text"].split())) for r in got.collect()) == want
