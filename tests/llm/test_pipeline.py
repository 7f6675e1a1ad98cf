"""The corpus pipeline, stage by stage, against plain Python on the rows each stage got."""

from __future__ import annotations

import re

import corpus_pipeline
from evalforge.llm import toxicity
from evalforge.llm.common import Scratch, table


def test_stages(spark, sf):
    scratch = Scratch(spark, "test-pipeline")
    docs, seen = table(spark, sf, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.save(stage(spark, docs, sf), name)
        seen[name] = (before, docs)
        assert docs.columns == columns or name == "source_mix"

    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    start, clean = map(texts, seen["toxicity"])
    bad = {r["doc_id"] for r in toxicity.toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).filter("predicted = 1").collect()}
    assert clean.keys() == start.keys() - bad

    before, after = map(texts, seen["exact_dedup"])
    assert after.keys() == {max(i for i in before if before[i] == t) for t in set(before.values())}

    before, after = map(texts, seen["ngram_join"])
    sets = {}
    for i, t in before.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after.keys() == {find(i) for i in ids}

    before, after = map(texts, seen["decontamination"])
    grams = lambda t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\W_]+", (t or "").lower())) else set()
    items = [grams(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert after.keys() == {i for i, t in before.items() if not any(g and 100 * len(g & grams(t)) >= 80 * len(g) for g in items)}

    before, after = seen["source_mix"]
    assert after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert set(texts(after)) <= set(texts(before))
