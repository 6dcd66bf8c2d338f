"""The language model is trained on every position, and its sums hold for large scores."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language_model as L


def test_every_position_has_its_turn(monkeypatch):
    """Over the rounds each training position is taken once where they are many, and in each where they are few."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, L.UNITS + L.ENDINGS, n).astype("<u2").tobytes() for n in rng.integers(1, 200, 400)]
    two, one, w, _ = L._positions(texts)
    want = Counter(zip(two.tolist(), one.tolist(), w.tolist(), strict=True))
    rounds = len(L.RATES)

    def taken():
        got, blocks = Counter(), []
        for k in range(rounds):
            seen = []
            for block in L._blocks((texts[a : a + 20] for a in range(0, len(texts), 20)), k, np.zeros(L.UNITS), np.random.default_rng(k), seen):
                got.update(zip(*(x.tolist() for x in block), strict=True))
                blocks.append(len(block[2]))
            assert sum(seen) == len(w)
        return got, blocks

    got, blocks = taken()
    assert got == Counter({x: rounds * n for x, n in want.items()}) and blocks == [len(w)] * rounds
    monkeypatch.setattr(L, "ENOUGH", 500)
    monkeypatch.setattr(L, "BLOCK", 2000)
    got, blocks = taken()
    assert got == want and len(blocks) > 2 * rounds and max(blocks) < 2000 + 20 * 200


def test_all_positions_of_a_block_are_taken(monkeypatch):
    rng = np.random.default_rng(4)
    n = 100_000
    block = tuple(rng.integers(0, L.UNITS, n) for _ in range(3))
    m = L.Model(np.ones(L.UNITS), np.arange(L.UNITS) % L.CLASSES)
    used = []
    gradient = m.gradient
    monkeypatch.setattr(m, "gradient", lambda two, one, w, noise, told: used.append(len(w)) or gradient(two, one, w, noise, told))
    m.fit(iter([block, tuple(x[:3000] for x in block)]), 0.01, 1)
    assert sum(used) == n + 3000 and len(used) >= L.LEAST_STEPS


def test_sums_of_large_scores():
    scores = np.array([[500.0, 500.0, 0.0], [-500.0, -501.0, -502.0], [0.0, 1.0, 2.0]], np.float32)
    assert L.Model._log_sums(scores) == pytest.approx([500 + np.log(2), -500 + np.log(1 + np.exp(-1) + np.exp(-2)), np.log(1 + np.e + np.e**2)], rel=1e-5)
