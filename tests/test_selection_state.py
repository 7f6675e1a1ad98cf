"""Selections write vectors once: passes write keys and distances, and pairs of blocks are read, not sent."""

from __future__ import annotations

import numpy as np

from evalforge.operators import selections, stored
from evalforge.operators.distances import block_distances
from evalforge.operators.selections import Geometry

from .test_core import vectors
from .test_designs import order, plain_kennard_stone


def test_vectors_are_written_twice_however_many_passes(spark, monkeypatch):
    written, own = [], selections.materialise
    for module in (selections, stored):
        monkeypatch.setattr(module, "materialise", lambda df: written.append(df.columns) or own(df))
    monkeypatch.setattr(selections, "PAIR_BLOCK", 16)
    monkeypatch.setattr(stored, "FILE_ROWS", 20)
    monkeypatch.setattr(selections, "STEP_VALUES", 64)
    x = np.random.default_rng(3).normal(size=(130, 8))
    d = np.round(block_distances("euclidean", x, x), selections.PLACES)
    got = order(selections.kennard_stone(vectors(spark, x.tolist()).repartition(3), 60, Geometry("euclidean"), batch_rows=12))
    assert got == plain_kennard_stone(d, 60)
    passes = [c for c in written if "near" in c]
    assert len(passes) > 3 and sum("x" in c for c in written) <= 3


def test_pairs_next_to_the_farthest(spark, monkeypatch):
    """Many pairs of one distance, to the ninth place: the least of them."""
    monkeypatch.setattr(selections, "PAIR_BLOCK", 16)
    r = np.random.default_rng(5).normal(size=(60, 6))
    x = np.concatenate([r, -r]) / np.linalg.norm(np.concatenate([r, -r]), axis=1)[:, None] + 3
    df = vectors(spark, x.tolist()).repartition(4)
    assert selections.farthest_pair(df, Geometry("euclidean"))[:2] == (0, 60)
    assert selections.farthest_pair(df, Geometry("euclidean", x_scale=7.0))[:2] == (0, 60)
