"""Repair of text from scanned pages.

Lines of the page frame go, words broken at line ends are joined, and misread words are put right by a noisy channel: the
probability that a word was written, by an n-gram model of the corpus, times the probability that it was read as it
stands, by a table of character confusions. A Viterbi search takes the likeliest words of each run of text; its lattice
also has words read with a blank inside and two words read as one.

The n-gram model counts the pages that were not scanned (all of them; all pages where none is said to be unscanned).
It keeps words and pairs of words from a share of all words on, so it has at most 1 / share of each at any size. The confusion
probabilities start from fixed pairs and are counted over all words of scanned pages that the model doesn't know.

mean_confidence is a weak guide here and only shifts the prior of a misreading, within bounds; null or odd values shift
nothing. A null text has no lines, an empty one a single empty line. Pages are repaired whole and independently.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import frames
from quirework.sources.tables import cut, spread, table

#: Least share of all words that a word, or a pair of words, of the model has; and its least number.
LEAST_SHARE = 2e-6
LEAST_COUNT = 2
#: Prior of a misreading in a word, and the strength of single words behind pairs.
MISREAD = 0.02
BACKING = 20.0

#: What is written, and what it is read as.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("é", "6"), ("b", "6"), ("g", "9"), ("e", "c"), ("c", "e"), ("i", "l"), ("l", "i"), ("t", "f"), ("f", "t"),
    ("g", "q"), ("q", "g"), ("v", "y"), ("y", "v"), ("c", "("), ("a", "ɑ"), ("u", "ii"), ("n", "ri"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("w", "vv"),
    ("rn", "m"), ("cl", "d"), ("ri", "n"), ("li", "h"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("o", "c"), ("m", "in"), ("in", "m"),
    ("ي", "ى"), ("ى", "ي"), ("ش", "س"), ("س", "ش"), ("ز", "ر"), ("ر", "ز"), ("ف", "ق"), ("ق", "ف"), ("ب", "ت"), ("ت", "ب"), ("ت", "ث"), ("ث", "ت"), ("ب", "ن"), ("ن", "ب"),
    ("ن", "ت"), ("ت", "ن"), ("ي", "ب"), ("ط", "ظ"), ("ظ", "ط"), ("ع", "غ"), ("غ", "ع"), ("ص", "ض"), ("ض", "ص"), ("ح", "خ"), ("خ", "ح"), ("ح", "ج"), ("ج", "ح"), ("ج", "خ"), ("د", "ذ"), ("ذ", "د"), ("ة", "ه"),
    ("ه", "ة"), ("أ", "ا"), ("إ", "ا"), ("ا", "أ"),
]

BREAKS = "-‐‑–¬­"
OUTER = "«»\"“”()[]{},.;:؛،?!؟…–—-‐¬­'’/•*"
NUMBER = re.compile(r"^[\d٠-٩.,/\-–:°%]+$")
#: A run of text without blanks; an apostrophe ends a word.
CHUNK = re.compile(r"[^\s'’]+['’]?")
HYPHEN_END = re.compile(rf"([^\W\d_][\w~^]*)[{BREAKS}]\s*$")
MARKS = re.compile(r"[~^.,;:(_|!*]")
INSIDE = re.compile(r"[^\W\d_]{2}[~^(,.;|][^\W_]|[^\W_][~^(,.;|][^\W\d_]{2}")
LETTER = re.compile(r"[^\W\d_]")


def core(chunk: str) -> str:
    """A word as the model counts it."""
    w = chunk.strip(OUTER).lower()
    return "#" if w and NUMBER.match(w) else w


@dataclass
class Word:
    """A word of running text and where its letters stand: (line, letters) pieces."""

    text: str
    pieces: list[tuple[int, int]]


def running(lines: list[str], frame: list[bool], known: dict[str, int] | None = None) -> tuple[list[Word], list[int], list[int]]:
    """The words of the text lines in order, words broken at line ends joined; the lines that end in such a word; the
    lines with a blank after a word's own hyphen.

    known: counts of words, by which a hyphen at a line end belongs to the word or not.
    """
    known = known or {}
    blanks: list[int] = []
    body = [k for k, f in enumerate(frame) if not f and lines[k].strip()]
    words: list[Word] = []
    broken: list[int] = []
    carry: tuple[str, int] | None = None
    for at, k in enumerate(body):
        line = lines[k]
        chunks = CHUNK.findall(line)
        if carry is not None and chunks:
            head, k0 = carry
            tail = core(chunks[0])
            whole, hyphened = core(head + tail), core(head + "-" + tail)
            if known.get(whole, 0) >= known.get(hyphened, 0):
                broken.append(k0)
                words.append(Word(whole, [(k0, len(head)), (k, len(tail))]))
            else:
                words.append(Word(hyphened, [(k0, len(head) + 1), (k, len(tail))]))
            chunks = chunks[1:]
        carry = None
        following = lines[body[at + 1]].lstrip() if at + 1 < len(body) else ""
        if chunks and HYPHEN_END.search(line) and re.match(r"\w", following):
            carry = (core(chunks[-1]), k)
            chunks = chunks[:-1]
        skip = False
        for c, d in zip(chunks, [*chunks[1:], ""], strict=False):
            if skip:
                skip = False
                continue
            w = core(c)
            if c[-1] == "-" and d and known and core(c + d) in known:
                w, skip = core(c + d), True
                blanks.append(k)
            if w:
                words.append(Word(w, [(k, len(w))]))
    if carry is not None:
        words.append(Word(carry[0], [(carry[1], len(carry[0]))]))
    return words, broken, blanks


@dataclass(frozen=True)
class Model:
    """Counts of words and pairs, and log probabilities of confusions by (written, read)."""

    words: dict[str, int]
    pairs: dict[tuple[str, str], int]
    total: int
    confusions: dict[tuple[str, str], float]


class Decoder:
    """Noisy-channel decoding with one model; candidates of a word are kept."""

    def __init__(self, model: Model):
        self.m = model
        self.seen: dict[str, list[tuple[str, float]]] = {}
        self.holes: dict[str, list[str]] = defaultdict(list)
        for w in model.words:
            if len(w) > 3 and w != "#":
                for i in range(len(w)):
                    self.holes[w[:i] + w[i + 1 :]].append(w)
        self.heads = {w[:i] for w in model.words for i in range(1, len(w) + 1)}
        self.tails = {w[i:] for w in model.words for i in range(len(w))}
        by_read: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for (a, b), p in model.confusions.items():
            by_read[b].append((a, p))
        self.by_read = dict(by_read)
        self.unknown = -math.log(max(model.total, 1))
        self.unusual = math.log(2e-5)
        self.mark = math.log(2e-3)
        self.blank = math.log(1e-3)

    def _window(self, v: str) -> tuple[int, int]:
        """Where a replaced piece may lie for a known word to come out: it ends at the first or later, and begins at the second or before."""
        high, low = 0, len(v)
        while high < len(v) and v[: high + 1] in self.heads:
            high += 1
        while low > 0 and v[low - 1 :] in self.tails:
            low -= 1
        return low, high

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """Words of the model that may have been read as w, with the log probability of that."""
        found = self.seen.get(w)
        if found is not None:
            return found
        best: dict[str, float] = {}

        def add(v: str, p: float) -> None:
            if v != w and v in self.m.words and p > best.get(v, -1e9):
                best[v] = p

        starts = [(w, 0.0)]
        clean = MARKS.sub("", w)
        if clean and clean != w:
            add(clean, self.mark)
            starts.append((clean, self.mark))
            for mm in MARKS.finditer(w):  # a mark may also stand for a letter
                starts.append((MARKS.sub("", w[: mm.start()]) + mm.group() + MARKS.sub("", w[mm.end() :]), self.mark if len(MARKS.findall(w)) > 1 else 0.0))
        for start, cost in starts:
            once = []
            for b, options in self.by_read.items():
                at = start.find(b)
                while at >= 0:
                    for a, p in options:
                        v = start[:at] + a + start[at + len(b) :]
                        add(v, cost + p)
                        once.append((v, cost + p))
                    at = start.find(b, at + 1)
            for v, p in once:  # a second confusion, only where the rest begins and ends like a known word
                low, high = self._window(v)
                for b, options in self.by_read.items():
                    at = v.find(b, max(0, low - len(b)))
                    while 0 <= at <= high:
                        for a, q in options:
                            add(v[:at] + a + v[at + len(b) :], p + q)
                        at = v.find(b, at + 1)
            if len(start) > 3 and w not in self.m.words:
                for hole in {start} | {start[:i] + start[i + 1 :] for i in range(len(start))}:
                    for v in self.holes.get(hole, ()):
                        add(v, cost + self.unusual)
                    if hole != start:
                        add(hole, cost + self.unusual)
        found = sorted(best.items(), key=lambda x: (-x[1] - math.log(self.m.words[x[0]]), x[0]))
        if len(self.seen) < 2_000_000:
            self.seen[w] = found
        return found

    def log_word(self, before: str, w: str) -> float:
        c = self.m.words.get(w)
        if c is None:
            # an unknown word is spelt letter by letter
            return self.unknown - min(len(w), 12) if LETTER.search(w) else math.log(1e-4)
        single = c / self.m.total
        pair = self.m.pairs.get((before, w), 0)
        return math.log((pair + BACKING * single) / (self.m.words.get(before, 0) + BACKING))

    def prefixed(self, w: str) -> bool:
        """Whether an Arabic word is a known one with a conjunction or preposition written together with it."""
        return (w[:1] in {*"وفبكل"} and len(w) > 4 and w[1:] in self.m.words) or (w[:2] == "لل" and "ال" + w[2:] in self.m.words)

    def doubtful(self, before: str, w: str, after: str) -> bool:
        """Whether a word may be another one: unknown, or known but strange between its neighbours."""
        if w == "#" or not w:
            return False
        if w not in self.m.words:
            return not self.prefixed(w)
        if (not before or (before, w) in self.m.pairs) and (not after or (w, after) in self.m.pairs):
            return False
        return bool(self.candidates(w))

    def decode(self, words: list[str], misread: float = MISREAD) -> list[tuple[int, int, tuple[str, ...]]]:
        """The likeliest reading where it differs: (first word, words read, words written)."""
        n = len(words)
        flags = [self.doubtful(words[k - 1] if k else "", words[k], words[k + 1] if k + 1 < n else "") for k in range(n)]
        changes: list[tuple[int, int, tuple[str, ...]]] = []
        k = 0
        while k < n:
            if not flags[k]:
                k += 1
                continue
            end = k
            while end < n and flags[end]:
                end += 1
            low, high = k, min(n, end + 1)
            # a blank inside a word may leave a known word beside the doubtful one
            start = max(0, low - 1)
            changes += self._search(words, start, high, misread)
            k = high
        changed = {k for first, count, _ in changes for k in range(first, first + count)}
        for k in range(n):  # a word that no known word explains, but with a mark inside
            if flags[k] and k not in changed and INSIDE.search(words[k]):
                changes.append((k, 1, (MARKS.sub("", words[k]),)))
        return sorted(changes)

    def _search(self, words: list[str], start: int, end: int, misread: float) -> list[tuple[int, int, tuple[str, ...]]]:
        right, wrong = math.log(1 - misread), math.log(misread)
        before = words[start - 1] if start else ""
        # layer[k]: word -> (score, back layer, back word, arc)
        layers: list[dict[str, tuple[float, int, str, tuple[int, tuple[str, ...]]]]] = [{} for _ in range(end - start + 1)]
        layers[0][before] = (0.0, -1, "", (0, ()))

        def put(to: int, w: str, score: float, frm: int, prev: str, arc: tuple[int, tuple[str, ...]]) -> None:
            if w not in layers[to] or score > layers[to][w][0]:
                layers[to][w] = (score, frm, prev, arc)

        for k in range(end - start):
            w = words[start + k]
            own = [] if w == "#" else self.candidates(w)
            halves = self._halves(w)
            joined = w + words[start + k + 1] if k + 1 < end - start else ""
            fits = [(joined, self.blank)] if joined in self.m.words else []
            if joined and not fits and (w not in self.m.words or words[start + k + 1] not in self.m.words):
                fits = [(v, p + self.blank) for v, p in self.candidates(joined) if p > math.log(1e-4)] if "#" not in joined else []
            for prev, (score, *_rest) in list(layers[k].items()):
                put(k + 1, w, score + self.log_word(prev, w) + right, k, prev, (1, (w,)))
                for v, p in own:
                    put(k + 1, v, score + self.log_word(prev, v) + wrong + p, k, prev, (1, (v,)))
                for a, b in halves:
                    put(k + 1, b, score + self.log_word(prev, a) + self.log_word(a, b) + wrong + self.blank, k, prev, (1, (a, b)))
                for v, p in fits:
                    put(k + 2, v, score + self.log_word(prev, v) + wrong + p, k, prev, (2, (v,)))
        after = words[end] if end < len(words) else ""
        last = max(layers[-1], key=lambda w: (layers[-1][w][0] + (self.log_word(w, after) if after else 0.0), w))
        changes, k, w = [], end - start, last
        while k > 0:
            _, frm, prev, (count, written) = layers[k][w]
            if written != tuple(words[start + frm : start + frm + count]):
                changes.append((start + frm, count, written))
            k, w = frm, prev
        return changes[::-1]

    def _halves(self, w: str) -> list[tuple[str, str]]:
        if w in self.m.words or len(w) < 5 or w == "#":
            return []
        return [(w[:i], w[i:]) for i in range(1, len(w)) if w[:i] in self.m.words and w[i:] in self.m.words and (w[:i], w[i:]) in self.m.pairs]


def touched(words: list[Word], change: tuple[int, int, tuple[str, ...]]) -> set[int]:
    """The lines on which a change lies."""
    first, count, written = change
    out: set[int] = set()
    for word in words[first : first + count]:
        if len(word.pieces) == 1 or count > 1:
            out |= {k for k, _ in word.pieces}
            continue
        cut_at = word.pieces[0][1]
        for tag, a, b, _, _ in SequenceMatcher(None, word.text, " ".join(written), autojunk=False).get_opcodes():
            if tag != "equal":
                out.add(word.pieces[0][0] if a < cut_at else word.pieces[1][0])
                if b > cut_at > a:
                    out.add(word.pieces[1][0])
    return out


PAGE = "tbl string, row_id bigint, doc_id string, text string, scanned boolean, doubt double"


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, row_id, doc_id, text, scanned, doubt) of both tables of pages."""
    ocr = table(spark, folder, "ocr_pages").select(
        F.lit("ocr_pages").alias("tbl"),
        F.col("ocr_id").alias("row_id"),
        "doc_id",
        "text",
        F.lit(True).alias("scanned"),
        F.when(F.col("mean_confidence").between(1, 100), 1 - F.col("mean_confidence") / 100).when(F.col("mean_confidence").between(0, 1), 1 - F.col("mean_confidence")).alias("doubt"),
    )
    extracted = table(spark, folder, "extracted_pages").select(
        F.lit("extracted_pages").alias("tbl"), F.col("page_id").alias("row_id"), "doc_id", "text", (F.col("extraction_method") != "pdf").alias("scanned"), F.lit(None).cast("double").alias("doubt")
    )
    return spread(ocr.unionByName(extracted))


def _counted(pages: DataFrame, forms: frozenset[str]) -> DataFrame:
    """(first, second, n): counts of words (second null) and pairs, summed within batches first."""
    shared = pages.sparkSession.sparkContext.broadcast(forms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = shared.value
        for batch in batches:
            single: Counter[str] = Counter()
            double: Counter[tuple[str, str]] = Counter()
            for text, own, here in zip(batch["text"], batch["forms"], batch["local"], strict=True):
                words, _, _ = running(text.split("\n"), frames.marks(own, forms, here))
                # what was joined at a line end may be wrong until the counts are known
                seen = [w.text if len(w.pieces) == 1 else "" for w in words]
                single.update(seen)
                double.update(zip(["", *seen], seen, strict=False))
            single.pop("", None)
            yield pd.DataFrame(
                [(w, None, n) for w, n in single.items()] + [(a, b, n) for (a, b), n in double.items() if b and a], columns=["first", "second", "n"]
            )

    return pages.select("text", "forms", "local").mapInPandas(count, "first string, second string, n bigint").groupBy("first", "second").agg(F.sum("n").alias("n"))


def model_for(pages: DataFrame, forms: frozenset[str], local: DataFrame | None = None, least: float = LEAST_SHARE) -> Model:
    """The model of the unscanned pages (all of them, if none is said to be unscanned), with confusions from the scanned ones."""
    own = frames.with_forms(pages.where("text IS NOT NULL"), local)
    clean = own.where("NOT coalesce(scanned, true)")
    counts = cut(_counted(own if clean.isEmpty() else clean, forms).where(F.col("n") >= 1))
    total = counts.where("second IS NULL").agg(F.sum("n")).first()[0] or 0
    floor = max(LEAST_COUNT, least * total)
    bound = int(2 / least) + 1
    words: dict[str, int] = {}
    pairs: dict[tuple[str, str], int] = {}
    for r in counts.where(F.col("n") >= floor).limit(bound).collect():
        if r["second"] is None:
            words[r["first"]] = r["n"]
        else:
            pairs[r["first"], r["second"]] = r["n"]
    words.setdefault("#", 1)
    flat = {ab: math.log(1 / 400) for ab in CONFUSIONS}
    base = Model(words, pairs, max(total, 1), flat)
    return Model(words, pairs, max(total, 1), learned_confusions(own.where("coalesce(scanned, true)"), forms, base, least))


def learned_confusions(scanned: DataFrame, forms: frozenset[str], base: Model, least: float) -> dict[tuple[str, str], float]:
    """Log probabilities of confusions, from the unknown words of scanned pages and the words they most likely are."""
    rows = _counted(scanned, forms).where("second IS NULL")
    total = rows.agg(F.sum("n")).first()[0] or 0
    seen = rows.where(F.col("n") >= max(LEAST_COUNT, least * total)).limit(int(1 / least) + 1).collect()
    decoder = Decoder(base)
    written: Counter[str] = Counter()
    read: Counter[tuple[str, str]] = Counter()
    for r in seen:
        w, n = r["first"], r["n"]
        if w in base.words:
            for a in {a for a, _ in base.confusions}:
                written[a] += n * w.count(a)
            continue
        found = decoder.candidates(w)
        if not found or found[0][1] < math.log(1 / 500):
            continue
        v = found[0][0]
        for (a, b), _ in base.confusions.items():
            if len(w) - len(v) == len(b) - len(a) and any(v[:i] + b + v[i + len(a) :] == w for i in range(len(v)) if v.startswith(a, i)):
                read[a, b] += n
    return {(a, b): math.log(min(0.2, (read[a, b] + 0.5) / (written[a] + read[a, b] + 400.0))) for a, b in base.confusions}


REPAIRED = "tbl string, row_id bigint, furniture array<int>, hyphen array<int>, misread array<int>, text string"


def repaired(pages: DataFrame, forms: frozenset[str], model: Model, local: DataFrame | None = None) -> DataFrame:
    """(tbl, row_id, lines by kind, text) of each page; text is its repaired paragraphs."""
    shared = pages.sparkSession.sparkContext.broadcast((forms, model))

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, model = shared.value
        decoder = Decoder(model)
        for batch in batches:
            out = []
            for tbl, row, text, doubt, own, here in zip(*(batch[c] for c in ("tbl", "row_id", "text", "doubt", "forms", "local")), strict=True):
                lines = text.split("\n")
                frame = frames.marks(own, forms, here)
                words, broken, blanks = running(lines, frame, model.words)
                prior = MISREAD if doubt is None or math.isnan(doubt) else min(0.04, max(0.01, doubt / 5))
                changes = decoder.decode([w.text for w in words], prior)
                misread = sorted({k for c in changes for k in touched(words, c)} | set(blanks))
                out.append((tbl, row, [k for k, f in enumerate(frame) if f], broken, misread, paragraphs(lines, frame, words, broken, changes)))
            yield pd.DataFrame(out, columns=["tbl", "row_id", "furniture", "hyphen", "misread", "text"])

    return frames.with_forms(pages.where("text IS NOT NULL"), local).select("tbl", "row_id", "text", "doubt", "forms", "local").mapInPandas(repair, REPAIRED)


def paragraphs(lines: list[str], frame: list[bool], words: list[Word], broken: list[int], changes: list[tuple[int, int, tuple[str, ...]]]) -> str:
    """The text without frame lines, broken words whole, changed words put right, lines of a paragraph in one."""
    fixes: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for first, count, written in changes:
        read = [w.text for w in words[first : first + count]]
        fixes[words[first].pieces[0][0]].append((" ".join(read), " ".join(written)))
    out: list[list[str]] = [[]]
    glue = False
    joined = {w.pieces[0][0] for w in words if len(w.pieces) > 1}
    for k, line in enumerate(lines):
        if frame[k]:
            continue
        if not line.strip():
            if not glue and out[-1]:
                out.append([])
            continue
        text = line.strip()
        if k in broken:
            text = text.rstrip(BREAKS + " ")
        if glue:
            out[-1][-1] += text
        else:
            out[-1].append(text)
        glue = k in joined
        for read, written in fixes[k]:
            at = out[-1][-1].lower().find(read)
            if at >= 0:
                old = out[-1][-1]
                new = written[:1].upper() + written[1:] if old[at].isupper() else written
                out[-1][-1] = old[:at] + new + old[at + len(read) :]
    return "\n\n".join(" ".join(p) for p in out if p)


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    pages = pages_of(spark, folder)
    forms, local = frames.forms_of(pages)
    return repaired(pages, forms, model_for(pages, forms, local), local)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the page frame, lines that end in a broken word, and lines with a misread word."""
    own = _repaired(spark, folder)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("lines")) for k in ("furniture", "hyphen", "misread")])
    return own.select("tbl", "row_id", F.explode(kinds).alias("x")).select("tbl", "row_id", F.explode("x.lines").alias("line_no"), F.col("x.kind").alias("kind"))


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired text of each page."""
    return _repaired(spark, folder).select("tbl", "row_id", "text")


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
SQL: dict[str, str] = {}
