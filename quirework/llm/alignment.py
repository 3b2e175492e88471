"""Sentence alignment of two language versions of a document.

Length-based dynamic programming: the difference of two sentence lengths, scaled by its deviation, is normal; the best
path over one-to-one, omission, merge and split beads is the alignment. A first pass uses lengths alone. Its one-to-one
beads, over all documents, teach which words go together; the second and third pass add that evidence to each bead's
cost. What these passes leave unpaired on both sides may stand elsewhere: it is paired by the same bead costs without
regard to order. A bead whose words speak against it is no pair.

The word table keeps pairs from a share of all pairs on, so it has at most 1 / share entries at any size.

Rows with a null or empty side have no pairs; sides may be swapped, and sides that are unrelated give none. Rows are
aligned independently; repeated rows repeat their pairs under their own key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.confusables import needs_form, one_form
from quirework.llm.subjects import ARABIC_PREFIX
from quirework.sources.tables import cut, spread, table

END = re.compile(r"[.?؟](?=\s|$)")
TOKEN = re.compile(r"[^\W\d_]+|[\d٠-٩]+(?:[.,/\-][\d٠-٩]+)*")
ARABIC = re.compile(r"[؀-ۿ]")
DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")
#: Least share of all word pairs, and least number of beads, that a pair in the word table has.
LEAST_SHARE = 2e-6
LEAST_BEADS = 3
#: Prior costs, in nats, of the beads (left sentences, right sentences).
PRIORS = {(1, 1): 0.1, (1, 0): 3.2, (0, 1): 3.2, (2, 1): 3.4, (1, 2): 3.4}
#: Variance of a length difference for each character, and the weight of word evidence.
VARIANCE = 6.8
WORD_WEIGHT = 14.0
#: Similarity of words at which the evidence turns, in a path and for what is paired out of order.
EVEN = 0.40
APART = 0.46
#: Weight of a number in a sentence, against the information of a word, which is at most WORD_MOST.
NUMBER_WEIGHT = 6.0
WORD_MOST = 5.0
#: What similarity loses if both sides have numbers and none in common.
NUMBERS_DIFFER = 0.35


def sentences(text: str | None) -> list[str]:
    """Sentences end at a mark followed by white space or the end; what follows the last mark is one too."""
    out, start = [], 0
    for m in END.finditer(text or ""):
        if text[start : m.end()].strip():
            out.append(text[start : m.end()].strip())
        start = m.end()
    if (text or "")[start:].strip():
        out.append(text[start:].strip())
    return out


def tokens(sentence: str) -> list[str]:
    """Distinct words and numbers, in one form."""
    found: dict[str, None] = {}
    for t in TOKEN.findall(one_form(sentence) if needs_form(sentence) else sentence):
        if t[0].isdigit():
            t = t.translate(DIGITS)
            if "/" in t or "-" in t or re.fullmatch(r"\d+(\.\d+)+", t) and not re.fullmatch(r"\d{1,3}(\.\d{3})+", t):
                for part in re.split(r"[/.\-]", t):
                    found[part.lstrip("0") or "0"] = None
                continue
            t = re.sub(r",0+$", "", t).replace(".", "")
            found[t.lstrip("0") or "0"] = None
        else:
            found[ARABIC_PREFIX.sub("", t.lower())] = None
    return list(found)


def is_arabic(text: str) -> bool:
    return 2 * len(ARABIC.findall(text)) > sum(map(str.isalpha, text))


_GRID = np.linspace(0, 8, 801)
_TAIL = np.array([-math.log(max(math.erfc(x / math.sqrt(2)), 1e-12)) for x in _GRID])


def length_cost(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """Cost of lengths (a by rows, b by columns) belonging together: the normal tail of their scaled difference."""
    a, b = np.maximum(a, 1)[:, None], np.maximum(b, 1)[None, :]
    return np.interp(np.abs(b - a * ratio) / np.sqrt((a + b / ratio) / 2 * VARIANCE * ratio), _GRID, _TAIL)


@dataclass(frozen=True)
class Words:
    """How closely words of both sides go together, and the weight of each word in a sentence."""

    scores: dict[str, dict[str, float]]
    left: dict[str, float]
    right: dict[str, float]


def _weight(word: str, known: dict[str, float]) -> float:
    if word[0].isdigit():
        return NUMBER_WEIGHT if len(word) > 1 and not (len(word) == 2 and word < "13") else 1.5
    return known.get(word, 1.0)


#: Cells (left by right sentences) from which numbers are kept in single precision, and from which paths are found row by row in arrays.
LARGE = 250_000
WIDE = 2_500
#: Cells (words by tokens) looked at in one step.
STEP = 4_000_000


def _places(sides: list[list[str]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The distinct words of some sentences by number; the number of each token, a mark (the number after the last word) at the end of
    each sentence; where each sentence begins."""
    numbers: dict[str, int] = {}
    flat = []
    for own in sides:
        flat += [numbers.setdefault(w, len(numbers)) for w in own]
        flat.append(-1)
    tokens_ = np.array(flat, dtype=np.int64)
    tokens_[tokens_ < 0] = len(numbers)
    return numbers, tokens_, np.cumsum([0, *(len(own) + 1 for own in sides[:-1])])


def _incidence(sides: list[list[str]], numbers: dict[str, int], weight: dict[str, float], kind: type) -> np.ndarray:
    """Weights of the words of each sentence."""
    out = np.zeros((len(sides), len(numbers) + 1), kind)
    for row, own in zip(out, sides, strict=True):
        for w in own:
            row[numbers[w]] = weight[w]
    return out


def _best(scores: np.ndarray, tokens_: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word (rows of scores) its best match in each sentence of the other side."""
    out = np.empty((len(scores), len(starts)), scores.dtype)
    ends = np.append(starts[1:], len(tokens_))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP // max(len(scores), 1), "right")))
        part = scores[:, tokens_[starts[first] : ends[last - 1]]]
        out[:, first:last] = np.maximum.reduceat(part, starts[first:last] - starts[first], axis=1)
        first = last
    return out


def _marks(sides: list[list[str]], numbers: dict[str, int]) -> np.ndarray:
    """Which of some words each sentence has."""
    out = np.zeros((len(sides), len(numbers)), np.float32)
    for row, own in zip(out, sides, strict=True):
        row[[numbers[w] for w in own if w in numbers]] = 1
    return out


#: What a path may do: left and right sentences of a bead.
STEPS = ((1, 0), (0, 1), (1, 1), (2, 1), (1, 2))


class Pairing:
    """One document's sentences, with the evidence for each bead in matrices by left and right sentence.

    Words meet in a matrix of distinct words, so a document of n by m sentences takes memory for n by m numbers, not for each word."""

    def __init__(self, left: list[str], right: list[str], ratio: float, words: Words | None):
        self.n, self.m = n, m = len(left), len(right)
        size_l, size_r = np.array([len(s) for s in left], float), np.array([len(s) for s in right], float)
        kind = np.float32 if n * m > LARGE else np.float64
        lengths = {
            (1, 1): lambda: length_cost(size_l, size_r, ratio).astype(kind),
            (2, 1): lambda: length_cost(size_l[:-1] + size_l[1:], size_r, ratio).astype(kind),
            (1, 2): lambda: length_cost(size_l, size_r[:-1] + size_r[1:], ratio).astype(kind),
        }
        if words is None:
            self.cost = {k: PRIORS[k] + v() for k, v in lengths.items()}
            return
        left_words, right_words = [tokens(s) for s in left], [tokens(s) for s in right]
        number_l, token_l, start_l = _places(left_words)
        number_r, token_r, start_r = _places(right_words)
        weight_l, weight_r = {w: _weight(w, words.left) for w in number_l}, {w: _weight(w, words.right) for w in number_r}
        # words without any match in the document only weigh
        matched: list[tuple[int, int, float]] = []
        for w, k in number_l.items():
            known = words.scores.get(w)
            if known:
                matched += [(k, number_r[x], v) for x, v in known.items() if x in number_r] if len(known) < len(number_r) else [(k, number_r[x], known[x]) for x in number_r if x in known]
            if w in number_r and w[0].isdigit():
                matched.append((k, number_r[w], 1.0))
        rows, columns = sorted({k for k, _, _ in matched}), sorted({q for _, q, _ in matched})
        at_row, at_column = np.full(len(number_l) + 1, len(rows)), np.full(len(number_r) + 1, len(columns))
        at_row[rows], at_column[columns] = np.arange(len(rows)), np.arange(len(columns))
        scores = np.zeros((len(rows) + 1, len(columns) + 1), kind)
        for k, q, v in matched:
            if v > scores[at_row[k], at_column[q]]:
                scores[at_row[k], at_column[q]] = v
        own_l, own_r = _incidence(left_words, number_l, weight_l, kind), _incidence(right_words, number_r, weight_r, kind)
        total_l, total_r = np.maximum(own_l.sum(1), 1e-9)[:, None], np.maximum(own_r.sum(1), 1e-9)[None, :]
        own_l, own_r = np.hstack([own_l[:, rows], np.zeros((n, 1), kind)]), np.hstack([own_r[:, columns], np.zeros((m, 1), kind)])
        ahead, behind = _best(scores, at_column[token_r], start_r), _best(scores.T, at_row[token_l], start_l).T
        part_l, part_r = own_l @ ahead, behind @ own_r.T
        part_l /= total_l
        part_r /= total_r
        both_l = own_l @ np.maximum(ahead[:, :-1], ahead[:, 1:]) / total_l
        both_r = np.maximum(behind[:-1], behind[1:]) @ own_r.T / total_r
        two_l, two_r = total_l[:-1] + total_l[1:], total_r[:, :-1] + total_r[:, 1:]
        self.similar = {
            (1, 1): 0.5 * (part_l + part_r),
            (2, 1): 0.5 * ((part_l[:-1] * total_l[:-1] + part_l[1:] * total_l[1:]) / two_l + both_r),
            (1, 2): 0.5 * (both_l + (part_r[:, :-1] * total_r[:, :-1] + part_r[:, 1:] * total_r[:, 1:]) / two_r),
        }
        # a sentence that adds nothing to a merge or split doesn't belong to it
        self.idle = {(2, 1): np.maximum(0, EVEN - np.minimum(part_l[:-1], part_l[1:])), (1, 2): np.maximum(0, EVEN - np.minimum(part_r[:, :-1], part_r[:, 1:]))}
        # numbers survive translation: sentences that both have some, and none in common, are hardly a pair
        heavy = {w: k for k, w in enumerate(w for w in number_l.keys() | number_r.keys() if w[0].isdigit() and _weight(w, {}) == NUMBER_WEIGHT)}
        if heavy:
            mark_l, mark_r = _marks(left_words, heavy), _marks(right_words, heavy)
            has_l, has_r, shared = mark_l.any(1)[:, None], mark_r.any(1)[None, :], mark_l @ mark_r.T > 0
            self.similar[1, 1] -= NUMBERS_DIFFER * (has_l & has_r & ~shared)
            self.similar[2, 1] -= NUMBERS_DIFFER * ((has_l[:-1] | has_l[1:]) & has_r & ~(shared[:-1] | shared[1:]))
            self.similar[1, 2] -= NUMBERS_DIFFER * (has_l & (has_r[:, :-1] | has_r[:, 1:]) & ~(shared[:, :-1] | shared[:, 1:]))
        self.cost = {}
        for k, v in lengths.items():
            self.cost[k] = 0.3 * np.minimum(v(), 8.0) - WORD_WEIGHT * self.similar[k]
            self.cost[k] += PRIORS[k] + WORD_WEIGHT * EVEN
            if k in self.idle:
                self.cost[k] += WORD_WEIGHT * self.idle[k]

    def path(self) -> list[tuple[int, int, int, int]]:
        """The beads (i, j, left sentences, right sentences) of the cheapest path."""
        steps = self._steps_by_rows() if self.n * self.m > WIDE else self._steps()
        i, j, beads = self.n, self.m, []
        while i or j:
            a, b = STEPS[steps[i][j]]
            i, j = i - a, j - b
            beads.append((i, j, a, b))
        return beads[::-1]

    def _steps(self) -> list[list[int]]:
        """The last step (a number in STEPS) of the cheapest path to each cell."""
        n, m = self.n, self.m
        one, two, twin = (self.cost[k].tolist() for k in ((1, 1), (2, 1), (1, 2)))
        skip = PRIORS[1, 0]
        best = [[math.inf] * (m + 1) for _ in range(n + 1)]
        back = [[0] * (m + 1) for _ in range(n + 1)]
        best[0][0] = 0.0
        for i in range(n + 1):
            for j in range(m + 1):
                if not i and not j:
                    continue
                c, step = math.inf, 0
                if i and (x := best[i - 1][j] + skip) < c:
                    c, step = x, 0
                if j and (x := best[i][j - 1] + skip) < c:
                    c, step = x, 1
                if i and j and (x := best[i - 1][j - 1] + one[i - 1][j - 1]) < c:
                    c, step = x, 2
                if i > 1 and j and (x := best[i - 2][j - 1] + two[i - 2][j - 1]) < c:
                    c, step = x, 3
                if i and j > 1 and (x := best[i - 1][j - 2] + twin[i - 1][j - 2]) < c:
                    c, step = x, 4
                best[i][j], back[i][j] = c, step
        return back

    def _steps_by_rows(self) -> np.ndarray:
        """The same, a row at a time: what comes from the rows above first, then omissions along the row by a running minimum."""
        n, m = self.n, self.m
        skip = PRIORS[1, 0]
        along = skip * np.arange(m + 1)
        back = np.ones((n + 1, m + 1), np.int8)
        above2, above = np.full(m + 1, np.inf), along.copy()
        for i in range(1, n + 1):
            options = np.full((5, m + 1), np.inf)
            options[0] = above + skip
            options[2, 1:] = above[:-1] + self.cost[1, 1][i - 1]
            if i > 1:
                options[3, 1:] = above2[:-1] + self.cost[2, 1][i - 2]
            if m > 1:
                options[4, 2:] = above[:-2] + self.cost[1, 2][i - 1]
            step = options.argmin(0)
            best = options[step, np.arange(m + 1)]
            row = np.minimum.accumulate(best - along) + along
            back[i] = np.where(row < best - 1e-9, 1, step)
            above2, above = above, np.minimum(row, best)
        return back

    def pairs(self) -> list[tuple[int, int]]:
        """Pairs of the path whose words don't speak against them, then pairs of what stands elsewhere."""
        out, left, right = [], set(range(self.n)), set(range(self.m))
        for i, j, a, b in self.path():
            if a and b and self.similar[a, b][i, j] >= EVEN:
                out += [(x, y) for x in range(i, i + a) for y in range(j, j + b)]
                left -= set(range(i, i + a))
                right -= set(range(j, j + b))
        moved = []
        rows, columns = np.zeros(self.n + 1, bool), np.zeros(self.m + 1, bool)
        rows[list(left)], columns[list(right)] = True, True
        for (a, b), similar in self.similar.items():
            free = (rows[: similar.shape[0]] & rows[a - 1 : similar.shape[0] + a - 1])[:, None] & (columns[: similar.shape[1]] & columns[b - 1 : similar.shape[1] + b - 1])[None, :]
            worth = similar - self.idle[a, b] if (a, b) in self.idle else similar
            moved += [(float(worth[i, j]), i, j, a, b) for i, j in np.argwhere(free & (worth >= APART)).tolist()]
        for _, i, j, a, b in sorted(moved, key=lambda x: (-x[0], x[1], x[2])):
            own_l, own_r = set(range(i, i + a)), set(range(j, j + b))
            if own_l <= left and own_r <= right:
                out += [(x, y) for x in own_l for y in own_r]
                left -= own_l
                right -= own_r
        return sorted(out)


def _prepared(left: str | None, right: str | None) -> tuple[list[str], list[str], bool] | None:
    if not left or not right or not left.strip() or not right.strip():
        return None
    swapped = is_arabic(left) and not is_arabic(right)
    a, b = sentences(left), sentences(right)
    return (b, a, True) if swapped else (a, b, False)


def length_ratio(splits: DataFrame) -> float:
    """Arabic characters for each character of the other side, over all documents with one Arabic side."""
    arabic = lambda c: F.regexp_count(c, F.lit(r"[\x{600}-\x{6FF}]")) * 2 > F.regexp_count(c, F.lit(r"\p{L}"))
    l, r = F.col("text_left"), F.col("text_right")
    row = splits.select(
        F.sum(F.when(~arabic(l) & arabic(r), F.length(l)).when(arabic(l) & ~arabic(r), F.length(r))).alias("other"),
        F.sum(F.when(~arabic(l) & arabic(r), F.length(r)).when(arabic(l) & ~arabic(r), F.length(l))).alias("arabic"),
    ).first()
    return float(row["arabic"] / row["other"]) if row["other"] and row["arabic"] else 0.8


def one_to_one(splits: DataFrame, ratio: float, words: Words | None) -> DataFrame:
    """(a, b): the words of both sentences of each one-to-one bead."""
    shared = splits.sparkSession.sparkContext.broadcast(words)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch["text_left"], batch["text_right"], strict=True):
                if (sides := _prepared(left, right)) is None:
                    continue
                pairing = Pairing(sides[0], sides[1], ratio, known)
                for i, j, x, y in pairing.path():
                    if x == y == 1 and (known is None or pairing.similar[1, 1][i, j] >= EVEN):
                        a.append(tokens(sides[0][i]))
                        b.append(tokens(sides[1][j]))
            yield pd.DataFrame({"a": a, "b": b})

    return splits.select("text_left", "text_right").mapInPandas(align, "a array<string>, b array<string>")


def word_table(beads: DataFrame, least: float = LEAST_SHARE) -> Words:
    """How closely words go together: the correlation of their presence over all beads."""
    beads = cut(beads)
    ones = beads.select(F.explode("a").alias("w"), F.lit(0).alias("side")).unionByName(beads.select(F.explode("b").alias("w"), F.lit(1).alias("side")))
    single = ones.groupBy("side", "w").agg(F.count("*").alias("n"))
    both = beads.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    total = beads.agg(F.sum(F.size("a").cast("double") * F.size("b")).alias("pairs"), F.count("*").cast("double").alias("beads")).first()
    kept = both.where(F.col("n_ab") >= max(LEAST_BEADS, least * (total["pairs"] or 0.0)))
    n, n_a, n_b = F.lit(total["beads"]), F.col("n_a").cast("double"), F.col("n_b").cast("double")
    phi = (n * F.col("n_ab") - n_a * n_b) / F.sqrt(n_a * n_b * F.greatest(n - n_a, F.lit(1.0)) * F.greatest(n - n_b, F.lit(1.0)))
    own = (
        kept.join(single.where("side = 0").select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a")
        .join(single.where("side = 1").select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b")
        .select("a", "b", "n_a", "n_b", phi.alias("phi"))
    )
    scores: dict[str, dict[str, float]] = {}
    left: dict[str, float] = {}
    right: dict[str, float] = {}
    for r in own.where("phi >= 0.08").limit(int(1 / least) + 1).collect():
        scores.setdefault(r["a"], {})[r["b"]] = min(1.0, 1.6 * r["phi"] ** 0.8)
        left[r["a"]] = min(WORD_MOST, max(0.1, math.log(total["beads"] / r["n_a"])))
        right[r["b"]] = min(WORD_MOST, max(0.1, math.log(total["beads"] / r["n_b"])))
    return Words(scores, left, right)


def aligned(splits: DataFrame, key: str = "split_id") -> DataFrame:
    """(key, left_no, right_no) of each pair of sentences that translate each other or a part."""
    splits = spread(splits.select(key, "text_left", "text_right"))
    ratio = length_ratio(splits)
    words = word_table(one_to_one(splits, ratio, None))
    words = word_table(one_to_one(splits, ratio, words))
    shared = splits.sparkSession.sparkContext.broadcast(words)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for row, left, right in zip(batch[key], batch["text_left"], batch["text_right"], strict=True):
                if (sides := _prepared(left, right)) is None:
                    continue
                for i, j in Pairing(sides[0], sides[1], ratio, known).pairs():
                    out.append((row, j, i) if sides[2] else (row, i, j))
            yield pd.DataFrame(out, columns=[key, "left_no", "right_no"]).astype({"left_no": "int32", "right_no": "int32"})

    return splits.select(key, "text_left", "text_right").mapInPandas(align, f"{key} bigint, left_no int, right_no int")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sentences of a row that translate each other."""
    return aligned(table(spark, folder, "bilingual_splits"))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
