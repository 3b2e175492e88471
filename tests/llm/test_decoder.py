"""Candidates of the decoder of scanned text, none cut, and the words it doubts."""

from __future__ import annotations

import math
import random

import pytest

from quirework.llm import ocr

ONE = math.log(1 / 400)


def test_context_picks_a_rare_candidate():
    words = {"le": 1000, **{f"m{c}t": 900 - 100 * k for k, c in enumerate("abcdefgh")}}
    decoder = ocr.Decoder(ocr.Model(words, {("le", "mht"): 190}, 10_000, {(c, "z"): ONE for c in "abcdefgh"}))
    assert len(decoder.candidates("mzt")) == 8
    assert decoder.decode(["le", "mzt"]) == [(1, 1, ("mht",))]


def test_a_word_that_fits_one_neighbour_is_doubted():
    words = {"le": 1000, "fou": 900, "tou": 3, "qui": 1000}
    decoder = ocr.Decoder(ocr.Model(words, {("le", "fou"): 800, ("fou", "qui"): 500, ("tou", "qui"): 2}, 10_000, {("f", "t"): ONE}))
    assert decoder.decode(["le", "tou", "qui"]) == [(1, 1, ("fou",))]
    assert decoder.decode(["le", "fou", "qui"]) == []


def test_two_confusions_are_brute_force():
    rng = random.Random(6)
    confusions = {("a", "0"): ONE, ("b", "a"): ONE, ("0", "b"): ONE, ("ab", "1"): ONE, ("1", "ba"): ONE}

    def edits(w):
        return {w[:i] + a + w[i + len(b) :] for a, b in confusions for i in range(len(w)) if w.startswith(b, i)}

    for _ in range(300):
        words = {"".join(rng.choice("ab01") for _ in range(rng.randrange(1, 6))): 5 for _ in range(40)}
        w = "".join(rng.choice("ab01") for _ in range(3))
        once = edits(w) - {w}
        twice = {v for x in edits(w) for v in edits(x)} - once - {w}
        found = dict(ocr.Decoder(ocr.Model(words, {}, 200, confusions)).candidates(w))
        assert found == {v: pytest.approx(ONE) for v in once & words.keys()} | {v: pytest.approx(2 * ONE) for v in twice & words.keys()}
