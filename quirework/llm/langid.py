"""Language of texts and of their segments, by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER bytes, learned once and then frozen. A byte costs the code length
that the longest known context gives it; an unknown byte costs the escape of that context and goes on in the next
shorter one, at last in a uniform code. The language with the shortest code wins; its confidence is the posterior over
code lengths, tempered because neighbouring bytes depend on each other.

The trees are learned from a bounded sample of pages whose labels may be wrong: words vote first (a wrong label mixes all
languages alike, so the ratio of a word's shares among labels still points to its language), then the trees are learned
from the paragraphs so assigned and once more from the paragraphs that the trees themselves assign.

For lookups all trees share one sorted table for each order whose rows hold the code length in every language, escapes
included; one search for a byte serves all languages.

Null and blank texts get no language and the confidence 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm import frames
from quirework.sources.tables import cut, spread, table

LANGUAGES = ("fr", "ar", "en", "es")
ORDER = 4
#: Most pages of each label from which the trees are learned.
SAMPLE = 600
TEMPER = 12.0
#: Characters of a group of texts that are measured at once.
GROUP = 400_000

#: Codes and names of the languages.
NAMES = {
    "fr": "fr", "fra": "fr", "fre": "fr", "français": "fr", "francais": "fr", "french": "fr",
    "ar": "ar", "ara": "ar", "arabe": "ar", "arabic": "ar", "العربية": "ar", "عربي": "ar", "عربية": "ar",
    "en": "en", "eng": "en", "anglais": "en", "english": "en",
    "es": "es", "spa": "es", "espagnol": "es", "spanish": "es", "español": "es", "espanol": "es",
}


def named(column: str) -> F.Column:
    """The language that a label names, or null."""
    plain = F.regexp_replace(F.lower(F.trim(F.col(column))), "[-_].*$", "")
    pairs = [F.lit(x) for kv in NAMES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), plain)


@dataclass(frozen=True)
class Trees:
    """Frozen statistics of all languages. For each order k: sorted keys (context and byte), code lengths in bits by
    language with escapes resolved; sorted contexts and the cost of leaving them."""

    keys: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]


def _rolled(data: np.ndarray, k: int) -> np.ndarray:
    """For each byte, the integer of it and the k bytes before it."""
    out = data.astype(np.int64)
    for j in range(1, k + 1):
        out[j:] |= data[:-j].astype(np.int64) << (8 * j)
    return out


def learn(texts: dict[str, list[str]], order: int = ORDER) -> Trees:
    """Trees from texts by language."""
    streams = []
    for language in LANGUAGES:
        joined = " ".join([" " * order, *texts.get(language, [])]).encode("utf-8", "replace")
        streams.append(np.frombuffer(joined, np.uint8))
    keys, bits, contexts, escapes = [], [], [], []
    for k in range(order + 1):
        counted, left = [], []
        for data in streams:
            symbols, n = np.unique(_rolled(data, k)[k:], return_counts=True)
            context, first = np.unique(symbols >> 8, return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            distinct = np.diff(np.append(first, len(n)))
            of = np.repeat(np.arange(len(context)), distinct)
            counted.append((symbols, np.log2((total + distinct)[of] / n)))
            left.append((context, np.log2((total + distinct) / distinct)))
        union = np.unique(np.concatenate([c[0] for c in counted]))
        around = np.unique(np.concatenate([c[0] for c in left]))
        leave = np.zeros((len(around), len(LANGUAGES)), np.float32)
        for j, (context, cost) in enumerate(left):
            leave[np.searchsorted(around, context), j] = cost
        table_ = np.full((len(union), len(LANGUAGES)), np.nan, np.float32)
        for j, (symbols, cost) in enumerate(counted):
            table_[np.searchsorted(union, symbols), j] = cost
        if k:
            lower = union & ((1 << (8 * k)) - 1)
            below = bits[k - 1][np.searchsorted(keys[k - 1], lower)]  # a key of order k has its suffix at order k - 1
        else:
            below = np.full((len(union), len(LANGUAGES)), 8.0, np.float32)
        fallen = below + leave[np.searchsorted(around, union >> 8)]
        table_ = np.where(np.isnan(table_), fallen, table_)
        keys.append(union)
        bits.append(table_.astype(np.float32))
        contexts.append(around)
        escapes.append(leave)
    return Trees(tuple(keys), tuple(bits), tuple(contexts), tuple(escapes))


def code_lengths(trees: Trees, texts: list[str]) -> np.ndarray:
    """Bits of each text (rows) in each language (columns). Texts are worked on in groups, so memory stays the same for any batch."""
    out, group, size = [np.zeros((0, len(LANGUAGES)))], [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > GROUP:
            out.append(_code_lengths(trees, group))
            group, size = [], 0
    return np.vstack([*out, _code_lengths(trees, group)])


def _code_lengths(trees: Trees, texts: list[str]) -> np.ndarray:
    order = len(trees.keys) - 1
    raw = [(" " * order + t + " ").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return np.zeros((0, len(LANGUAGES)), np.float64)
    rolled = _rolled(data, order)
    cost = np.zeros((len(data), len(LANGUAGES)), np.float32)
    open_ = np.arange(len(data))
    for k in range(order, -1, -1):
        key = rolled[open_] & ((1 << (8 * (k + 1))) - 1)
        at = np.searchsorted(trees.keys[k], key)
        at[at == len(trees.keys[k])] = 0
        hit = trees.keys[k][at] == key
        cost[open_[hit]] += trees.bits[k][at[hit]]
        open_ = open_[~hit]
        if not len(open_):
            break
        context = key[~hit] >> 8
        at = np.searchsorted(trees.contexts[k], context)
        at[at == len(trees.contexts[k])] = 0
        known = trees.contexts[k][at] == context
        cost[open_[known]] += trees.escapes[k][at[known]]
    if len(open_):
        cost[open_] += 8.0
    starts = np.concatenate([[0], ends[:-1]])
    lead = np.zeros(len(data), bool)
    for j in range(order):
        lead[starts + j] = True
    cost[lead] = 0
    return np.add.reduceat(cost.astype(np.float64), starts, axis=0)


def decide(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language of each row of bits, and its posterior."""
    best = bits.argmin(axis=1)
    post = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / TEMPER)
    return best, 1.0 / post.sum(axis=1)


WORD = re.compile(r"[^\W\d_]+")


def assign(pages: list[tuple[str, dict[str, int]]], rounds: int = 2) -> dict[str, list[str]]:
    """Paragraphs by language, from pages with votes by label that may be wrong."""
    share: dict[str, Counter[str]] = {x: Counter() for x in LANGUAGES}
    for text, votes in pages:
        words = Counter(w.lower() for w in WORD.findall(text))
        for label, n in votes.items():
            for w, c in words.items():
                share[label][w] += n * c
    totals = {x: sum(share[x].values()) + 1.0 for x in LANGUAGES}
    paragraphs = [p for text, _ in pages for p in text.split("\n\n") if p.strip()]

    def vote(p: str) -> str:
        score = np.zeros(len(LANGUAGES))
        for w in WORD.findall(p):
            rate = np.array([(share[x][w.lower()] + 0.01) / totals[x] for x in LANGUAGES])
            score += np.clip(np.log(rate / rate.mean()), -2, 2)
        return LANGUAGES[int(score.argmax())]

    sets: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    for p in paragraphs:
        sets[vote(p)].append(p)
    for _ in range(rounds):
        best, sure = decide(code_lengths(learn(sets), paragraphs))
        sets = {x: [] for x in LANGUAGES}
        for p, b, s in zip(paragraphs, best, sure, strict=True):
            if s > 0.9:
                sets[LANGUAGES[b]].append(p)
    return sets


def sample(pages: DataFrame, results: DataFrame | None = None, most: int = SAMPLE) -> list[tuple[str, dict[str, int]]]:
    """At most so many pages of each label, spread over all by a hash, with the votes of their labels."""
    own = pages.where("text IS NOT NULL").select("page_id", "text", named("language").alias("label"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("page_id", F.lit(7)), "page_id")
    few = own.where("label IS NOT NULL").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return [(r["text"], {r["label"]: 1}) for r in few.select("text", "label").collect()]


def trees_for(pages: DataFrame) -> Trees:
    """Trees learned from a bounded sample of these pages."""
    return learn(assign(sample(pages)))


SEGMENTS = "page_id bigint, label string, para_no int, language string, confidence double, bits double, chars int, page_language string, page_confidence double, pure boolean"


def segments(pages: DataFrame, trees: Trees, forms: frozenset[str], local: DataFrame | None = None) -> DataFrame:
    """(page_id, label, para_no, language, confidence, ...) of each paragraph that has text beside the page frame, and the
    language of its page: that of most of its text. pure: all its paragraphs have one language. label: what the page's own label names."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast((trees, forms))
    own = frames.with_forms(spread(pages.select("page_id", "doc_id", named("language").alias("label"), "text").where("text IS NOT NULL")), local).select("page_id", "label", "text", "forms", "local")

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, forms = shared.value
        for batch in batches:
            at, texts = [], []
            for page, label, text, own_forms, here in zip(batch["page_id"], batch["label"], batch["text"], batch["forms"], batch["local"], strict=True):
                line, own_forms = 0, frames.marks(own_forms, forms, here)
                for k, p in enumerate(text.split("\n\n")):
                    lines = p.split("\n")
                    kept = [x for x, f in zip(lines, own_forms[line : line + len(lines)], strict=False) if not f]
                    line += len(lines) + 1
                    body = QUOTE.sub(" ", " ".join(kept)).strip() or " ".join(kept).strip()
                    if WORD.search(body):
                        at.append((page, label, k))
                        texts.append(body)
            if not texts:
                continue
            bits = code_lengths(trees, texts)
            best, sure = decide(bits)
            out = pd.DataFrame(at, columns=["page_id", "label", "para_no"])
            out["language"] = [LANGUAGES[b] for b in best]
            out["confidence"], out["bits"], out["chars"] = sure, bits.min(axis=1), [len(t) for t in texts]
            weight = out.groupby(["page_id", "language"], as_index=False)["chars"].sum().sort_values(["page_id", "chars", "language"], ascending=[True, False, True])
            chief = weight.drop_duplicates("page_id").set_index("page_id")
            whole = weight.groupby("page_id")["chars"].sum()
            out["page_language"] = out["page_id"].map(chief["language"])
            out["page_confidence"] = out["page_id"].map(chief["chars"] / whole)
            out["pure"] = out["page_id"].map(weight.groupby("page_id").size() == 1)
            yield out

    return own.mapInPandas(detect, SEGMENTS)


QUOTE = re.compile(r"«[^»]{0,200}»")


def _detected(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "extracted_pages")
    forms, local = frames.forms_of(pages)
    return segments(pages, trees_for(pages), forms, local)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs in another language than their page's label names, and detector runs wrong about a page in one language.

    The texts are measured once; what is found is written and read for both parts."""
    found = cut(_detected(spark, folder).select("page_id", "label", "para_no", "language", "page_language", "pure"))
    paragraphs = found.where(~F.col("language").eqNullSafe(F.col("label"))).select(F.lit("extracted_pages").alias("tbl"), F.col("page_id").alias("row_id"), "para_no", "language")
    whole = found.where("pure").groupBy("page_id").agg(F.first("page_language").alias("page_language"))
    runs = (
        table(spark, folder, "language_results")
        .select("result_id", "page_id", named("language").alias("label"))
        .join(whole, "page_id")
        .where(~F.col("page_language").eqNullSafe(F.col("label")))
        .select(F.lit("language_results").alias("tbl"), F.col("result_id").alias("row_id"), F.lit(-1).alias("para_no"), F.col("page_language").alias("language"))
    )
    return paragraphs.unionByName(runs)


def p7_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of each paragraph, beside those of its page."""
    return _detected(spark, folder).select(
        "page_id", "para_no", "language", F.round("confidence", 4).alias("confidence"), "page_language", F.round("page_confidence", 4).alias("page_confidence"), "pure"
    )


QUERIES = {"p7_found": p7_found, "p7_segments": p7_segments}
SQL: dict[str, str] = {}
