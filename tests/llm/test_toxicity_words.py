"""Ratios of words are looked up once while they are in use, whatever marks surround them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from evalforge.llm import toxicity


class Asked(toxicity.Head):
    """A head that holds every 6-gram, and the words that it was asked for."""

    def __init__(self):
        self.words = []

    def ratios(self, words, column):
        self.words += words
        return np.array([float(len(w)) for w in words])


def test_words_in_use_are_not_asked_for_again(monkeypatch):
    monkeypatch.setattr(toxicity, "_REMEMBERED", 20)
    head = Asked()
    known = toxicity.Ratios(head, 0)
    for k in range(30):
        texts = [["often", "often,", "(often)"], [f"rare{k}", f"rare{k}."]]
        known.learn(texts)
        assert [[known[w] for w in t] for t in texts] == [[5.0] * 3, [float(len(f"rare{k}"))] * 2]
        assert len(known) + len(known.before) <= 2 * (20 // 2 + 5)
    assert head.words.count("often") == 1 and len(head.words) == 31


def test_ratios_of_grams_that_repeat():
    g = toxicity._grams(["abab", "ab", ""])
    whole = toxicity._grams(["abab", "ab", ""], True)
    assert sorted(whole) == ["e", "word", "x"] and (whole["e"] == g["e"]).all()
    keys = np.unique(g["e"])[1:]
    head = toxicity.Head(pa.table({"e": keys, **{r: np.arange(len(keys)) + k * 0.5 for k, r in enumerate(toxicity.RATIOS)}}))
    values = {int(k): float(i) for i, k in enumerate(keys)}
    want = [sum(values.get(int(e), np.nan) for e in g["e"][g["word"] == w]) for w in range(3)]
    np.testing.assert_array_equal(head.ratios(["abab", "ab", ""], 0), want)


def test_counts_of_words_by_slot(monkeypatch):
    monkeypatch.setattr(toxicity, "_REMEMBERED", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a", "b c d", None, "A e", "a"]), pa.array([0, None, 1, 3, 0], pa.int32())], ["text", "slot"])
    total: dict[str, list[int]] = {}
    for b in toxicity._count_words(iter([batch])):
        for w, *c in zip(*[x.to_pylist() for x in b.columns], strict=True):
            total[w] = [p + q for p, q in zip(total.get(w, [0] * 5), c, strict=True)]
    assert total == {"a": [2, 0, 0, 1, 3], "b": [1, 0, 0, 0, 2], "c": [0, 0, 0, 0, 1], "d": [0, 0, 0, 0, 1], "e": [0, 0, 0, 1, 1]}
