"""Paths and evidence of sentence alignment, by loops and by arrays."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quirework.llm import alignment


def document(rng, n, m, words=8):
    vocabulary = [f"{c}{k}" for k in range(40) for c in "ab"]
    side = lambda size, c: [" ".join([*(w for w in rng.sample(vocabulary, words) if w[0] == c), str(rng.randrange(10, 90))]) + "." for _ in range(size)]
    known = {f"a{k}": {f"b{k}": 0.9, f"b{(k * 7) % 40}": 0.4} for k in range(40)}
    return side(n, "a"), side(m, "b"), alignment.Words(known, {f"a{k}": 1 + k % 3 for k in range(40)}, {f"b{k}": 1 + k % 4 for k in range(40)})


def cost(pairing, beads):
    return sum(alignment.PRIORS[1, 0] if 0 in (a, b) else pairing.cost[a, b][i, j] for i, j, a, b in beads)


@pytest.mark.parametrize("seed", range(6))
def test_rows_find_as_cheap_a_path(seed, monkeypatch):
    rng = random.Random(seed)
    left, right, known = document(rng, rng.randrange(1, 30), rng.randrange(1, 30))
    pairing = alignment.Pairing(left, right, 1.0, known if seed % 2 else None)
    one = pairing.path()
    monkeypatch.setattr(alignment, "WIDE", 0)
    two = pairing.path()
    assert cost(pairing, one) == pytest.approx(cost(pairing, two))
    assert two[0][:2] == (0, 0) and sum(b[2] for b in two) == len(left) and sum(b[3] for b in two) == len(right)


@pytest.mark.parametrize("seed", range(4))
def test_similarity_is_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(alignment, "STEP", rng.choice([1, 50, 4_000_000]))
    left, right, known = document(rng, rng.randrange(2, 9), rng.randrange(2, 9))
    pairing = alignment.Pairing(left, right, 1.0, known)
    tokens_l, tokens_r = [alignment.tokens(s) for s in left], [alignment.tokens(s) for s in right]
    score = lambda u, v: 1.0 if u == v and u[0].isdigit() else known.scores.get(u, {}).get(v, 0.0)
    weight_l, weight_r = (lambda w: alignment._weight(w, known.left)), (lambda w: alignment._weight(w, known.right))
    heavy = lambda own: {w for w in own if w[0].isdigit() and alignment._weight(w, {}) == alignment.NUMBER_WEIGHT}
    for i, a in enumerate(tokens_l):
        for j, b in enumerate(tokens_r):
            ahead = sum(weight_l(u) * max((score(u, v) for v in b), default=0) for u in a) / sum(map(weight_l, a))
            behind = sum(weight_r(v) * max((score(u, v) for u in a), default=0) for v in b) / sum(map(weight_r, b))
            differ = heavy(a) and heavy(b) and not heavy(a) & heavy(b)
            assert pairing.similar[1, 1][i, j] == pytest.approx(0.5 * (ahead + behind) - alignment.NUMBERS_DIFFER * bool(differ))


def test_a_long_document_takes_little_memory():
    left, right, known = document(random.Random(3), 1500, 1500)
    pairing = alignment.Pairing(left, right, 1.0, known)
    assert all(v.dtype == np.float32 for v in pairing.cost.values())
    assert len(pairing.pairs()) > 100


def test_sentences_without_words():
    pairing = alignment.Pairing(["!.", "a1 12."], ["?.", "b1 12.", "."], 1.0, alignment.Words({"a1": {"b1": 1.0}}, {}, {}))
    assert (1, 1) in pairing.pairs()
