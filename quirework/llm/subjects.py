"""Subjects of articles by classifier chains with beam search.

Term features come from a model of clauses learned on labelled articles: each clause treats one subject or none, and the
lift of each of its words says how much likelier it makes each. Clauses that cite a text are set apart with their
titles. For an article the chain sees, for each subject, how many clauses treat it, what share, how surely, what its cited
titles would say (so that it can learn to pass over them), and features of source and structure; each link also sees
the subjects chosen before it, which models co-occurrence. Links are ridge logistic regressions whose probabilities are
calibrated by a logistic on held-out folds; a beam search over the chain finds the likeliest set.

Labels are learned from a bounded sample. They may be missing or wrong: the mixture lets clauses of an article treat
subjects that aren't among its labels at a small prior. Every article is scored whole; null and empty texts get none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.confusables import needs_form, one_form
from quirework.sources.tables import spread, table

#: Most labelled articles to learn from.
SAMPLE = 8000
BEAM = 6
#: A choice whose log probability is below this is not followed.
SURE = -6.0
OFF_LABEL = 0.04
FOLDS = 4

CLAUSE = re.compile(r"[.;:!?؟؛]\s+|[\r\n\f]+\s*")
WORD = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
#: A reference to a text, with the title that may follow in brackets or after a linking word.
CITED = re.compile(
    r"(?:n\s?°|n[o°º]\.?\s|رقم|no\.\s|núm\.)\s?[\d٠-٩][\d٠-٩.\-/]*\s*(?:\([^)]{0,300}\)|(?:relati[fv]e?s? [àa]|concernant|portant|المتعلق[ة]? ب)[^,.;؛)]{0,200})?", re.IGNORECASE
)
BRACKETED = re.compile(r"\([^)]{0,300}\)")
QUOTED = re.compile(r"[«“\"][^»”\"]{0,300}[»”\"]")
ARABIC_PREFIX = re.compile(r"^(?:[وف]?(?:[بك]?ال|لل))(?=\w{2})")


def words_of(text: str) -> list[str]:
    """Words, lower case, without the Arabic article and what is written with it."""
    return [w if w < "\u0600" else ARABIC_PREFIX.sub("", w) for w in WORD.findall(text.lower())]


def clause_strings(text: str) -> list[str]:
    """The clauses of an article in one form, numbers masked."""
    plain = text if not needs_form(text) else one_form(text)
    return [c for c in CLAUSE.split(DIGITS.sub("0", plain)) if c]


def clause_words(clause: str) -> tuple[list[str], list[str]]:
    """The words of a clause, and those of the titles and quotations in it."""
    titles: list[str] = []
    rest = clause
    if "0" in clause and CITED.search(clause):
        titles = [w for m in CITED.finditer(clause) for w in words_of(m.group())]
        rest = CITED.sub(" ", clause)
        titles += [w for m in BRACKETED.findall(rest) for w in words_of(m)]
        rest = BRACKETED.sub(" ", rest)
    if any(q in rest for q in "«“\""):
        titles += [w for m in QUOTED.findall(rest) for w in words_of(m)]
        rest = QUOTED.sub(" ", rest)
    return words_of(rest), titles


@dataclass(frozen=True)
class Terms:
    """Log lifts of words: how much likelier a clause treats each subject, or none (last row), if it has the word."""

    index: dict[str, int]
    log_lift: np.ndarray
    prior: np.ndarray

    def lifts_of(self, groups: list[list[str]]) -> np.ndarray:
        """Summed log lifts of the distinct words of each group."""
        known = [[self.index[w] for w in set(g) if w in self.index] for g in groups]
        owner = np.repeat(np.arange(len(groups)), [len(k) for k in known])
        word = np.array([i for k in known for i in k], int)
        return np.column_stack([np.bincount(owner, weights=row[word], minlength=len(groups)) for row in self.log_lift])


def softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


class Scorer:
    """Scores articles with one set of terms. Clauses recur, so their scores are kept, up to a bound."""

    MOST = 300_000

    def __init__(self, terms: Terms):
        self.terms, self.subjects = terms, len(terms.prior) - 1
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.posterior = np.zeros((1024, self.subjects + 1))
        self.title = np.zeros((1024, self.subjects + 1))
        self.worded = np.zeros(1024, bool)
        self.titled = np.zeros(1024, bool)

    def _learn(self, clauses: list[str]) -> None:
        first, new = len(self.at), []
        for c in clauses:
            if c not in self.at:
                self.at[c] = first + len(new)
                new.append(clause_words(c))
        while len(self.at) > len(self.worded):
            self.posterior, self.title = np.vstack([self.posterior, np.zeros_like(self.posterior)]), np.vstack([self.title, np.zeros_like(self.title)])
            self.worded, self.titled = np.append(self.worded, np.zeros_like(self.worded)), np.append(self.titled, np.zeros_like(self.titled))
        if new:
            rows = slice(first, first + len(new))
            self.worded[rows], self.titled[rows] = [bool(w) for w, _ in new], [bool(t) for _, t in new]
            self.posterior[rows] = softmax(np.log(self.terms.prior) + self.terms.lifts_of([w for w, _ in new]))
            self.title[rows] = self.terms.lifts_of([t for _, t in new])

    def features(self, articles: list[list[str]], sources: list[tuple[float, ...]]) -> np.ndarray:
        """(articles, subjects, features): what the chain sees of each subject in each article."""
        if len(self.at) > self.MOST:
            self._reset()
        self._learn([c for a in articles for c in a])
        at = np.array([self.at[c] for a in articles for c in a], int)
        owner = np.repeat(np.arange(len(articles)), [len(a) for a in articles])
        n, m = len(articles), self.subjects
        p = self.posterior[at, :m] * self.worded[at][:, None]
        sums, sure, title = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m + 1))
        best = np.zeros((n, m))
        np.add.at(sums, owner, p)
        np.add.at(sure, owner, p > 0.5)
        np.maximum.at(best, owner, p)
        np.add.at(title, owner, self.title[at])
        number = np.bincount(owner, weights=self.worded[at], minlength=n)
        named = np.bincount(owner, weights=self.titled[at], minlength=n) > 0
        title = softmax(np.log(self.terms.prior) + title)[:, :m] * named[:, None]
        topical = np.maximum(sums.sum(1, keepdims=True), 1e-6)
        own = np.stack([np.log1p(sums), sums / topical, best, sure > 0, sure > 1, sure > 2, np.log1p(sure), sure / np.maximum(sure.sum(1, keepdims=True), 1), title], axis=2)
        general = np.column_stack([np.log1p(number), np.log1p(topical[:, 0]), np.array(sources, float).reshape(n, -1)])
        return np.concatenate([own, np.repeat(general[:, None, :], m, axis=1)], axis=2)


def learn_terms(articles: list[list[list[str]]], labels: np.ndarray, rounds: int = 3, shrink: float = 2.0) -> Terms:
    """The lifts. First by the articles that hold a word and their labels; then, so that a word isn't credited with the
    other subjects of its articles, by the clauses that hold it and the labels that these clauses seem to treat. Only
    lifts that stand clear of chance count, which keeps words of the common language out."""
    units = [[set(w for c in a for w in c)] for a in articles]
    counts = Counter(w for u in units for w in u[0])
    index = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n > 1))}
    subjects, size = labels.shape[1], max(1, len(index))
    some = labels.sum(1, keepdims=True)
    lift = np.zeros((subjects + 1, size))
    prior = np.append(np.full(subjects, 0.5 / subjects), 0.5)
    if not index:
        return Terms(index, lift, prior)

    def flat(groups: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, word, owner = [], [], []
        for i, g in enumerate(groups):
            for c in g:
                for w in set(c):
                    if w in index:
                        at.append(len(owner))
                        word.append(index[w])
                owner.append(i)
        return np.array(at, int), np.array(word, int), np.array(owner, int)

    def lifts(at: np.ndarray, word: np.ndarray, p: np.ndarray) -> None:
        total = np.bincount(word, minlength=size)
        share = p.mean(0) + 1e-9
        for k in range(subjects):
            q = (np.bincount(word, weights=p[at, k], minlength=size) + shrink * share[k]) / (total + shrink)
            low = q - 1.3 * np.sqrt(q * (1 - q) / (total + shrink))
            lift[k] = np.where(low > 1.6 * share[k], np.log(np.maximum(q, 1e-9) / share[k]), 0.0)

    at, word, owner = flat(units)
    lifts(at, word, labels[owner])
    at, word, owner = flat(articles)
    allowed = np.where(labels > 0, (1 - OFF_LABEL) / np.maximum(some, 1), OFF_LABEL / np.maximum(subjects - some, 1))
    start = np.hstack([0.5 * np.where(some > 0, allowed, OFF_LABEL / subjects), np.full((len(labels), 1), 0.5)])[owner]
    for _ in range(rounds):
        score = np.log(start)
        for k in range(subjects):
            score[:, k] += np.bincount(at, weights=lift[k][word], minlength=len(owner))
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        lifts(at, word, p[:, :subjects])
    return Terms(index, lift, prior)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (q - y) + ridge * w)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass(frozen=True)
class Chain:
    """Links in order; each has a mean, a scale, weights over features and earlier subjects, and a calibration."""

    names: tuple[str, ...]
    terms: Terms
    order: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    calibration: tuple[tuple[float, float], ...]

    def decode(self, x: np.ndarray, beam: int = BEAM) -> list[tuple[list[int], float]]:
        """The likeliest set of subjects of each article (articles, subjects, features), with its log probability."""
        z = (x - self.mean) / self.scale
        f = z.shape[2]
        base = np.column_stack([z[:, s] @ w[:f] + w[f] for s, w in zip(self.order, self.weights, strict=True)]).tolist()
        links = [w[f + 1 :].tolist() for w in self.weights]
        return [self._search(b, links, beam) for b in base]

    def _search(self, base: list[float], links: list[list[float]], beam: int) -> tuple[list[int], float]:
        paths: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for k, b in enumerate(base):
            slope, shift = self.calibration[k]
            grown = []
            for score, chosen in paths:
                logit = slope * (b + sum(links[k][i] for i in chosen)) + shift
                less = math.log1p(math.exp(-abs(logit)))
                yes, no = (-less, -less - logit) if logit > 0 else (logit - less, -less)
                if yes > SURE:
                    grown.append((score + yes, (*chosen, k)))
                if no > SURE:
                    grown.append((score + no, chosen))
            paths = sorted(grown, key=lambda g: -g[0])[:beam] if len(grown) > 1 else grown
        score, chosen = paths[0]
        return sorted(self.order[k] for k in chosen), score


def _design(x: np.ndarray, labels: np.ndarray, order: tuple[int, ...], k: int) -> np.ndarray:
    return np.hstack([x[:, order[k], :], np.ones((len(x), 1)), labels[:, list(order[:k])]])


def fit(rows: list[tuple[str, tuple[float, ...]]], labels: np.ndarray, names: list[str]) -> Chain:
    """The chain of labelled articles: (text, source features), and a 0/1 row of labels each."""
    if not rows:
        rows, labels = [("", (0.0, 0.0, 0.0))], np.zeros((1, len(names)))
    strings = [clause_strings(t) for t, _ in rows]
    split = [[w for c in own if (w := clause_words(c)[0])] for own in strings]
    order = tuple(int(i) for i in np.argsort(-labels.sum(0), kind="stable"))

    def design(terms: Terms, at: np.ndarray) -> np.ndarray:
        return Scorer(terms).features([strings[i] for i in at], [rows[i][1] for i in at])

    def links(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        mean, scale = x.reshape(-1, x.shape[2]).mean(0), x.reshape(-1, x.shape[2]).std(0) + 1e-6
        z = (x - mean) / scale
        return mean, scale, [_logistic(_design(z, y, order, k), y[:, order[k]]) for k in range(len(order))]

    fold = np.random.default_rng(3).permutation(len(rows)) % FOLDS
    held = np.zeros((len(rows), len(names)))
    for f in range(FOLDS):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if not len(rest) or not len(own):
            continue
        terms = learn_terms([split[i] for i in rest], labels[rest])
        mean, scale, weights = links(design(terms, rest), labels[rest])
        z = (design(terms, own) - mean) / scale
        for k in range(len(order)):
            held[own, k] = _design(z, labels[own], order, k) @ weights[k]
    calibration = []
    for k in range(len(order)):
        a, b = _logistic(np.column_stack([held[:, k], np.ones(len(rows))]), labels[:, order[k]], ridge=0.1)
        calibration.append((max(float(a), 0.2), float(b)))
    terms = learn_terms(split, labels)
    mean, scale, weights = links(design(terms, np.arange(len(rows))), labels)
    return Chain(tuple(names), terms, order, mean, scale, tuple(weights), tuple(calibration))


def source_features(doc_id: str | None, number: str | None, text: str) -> tuple[float, ...]:
    """Language and kind of the issue, kind of the article."""
    return (float((doc_id or "").startswith("ar")), float(number is None or not str(number).isdigit()), float("\n\n" in text))


def chain_for(articles: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = SAMPLE) -> Chain:
    """The chain of a bounded sample, spread by a hash, of the labelled articles."""
    names = sorted(r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().limit(1000).collect())
    own = labels.where(F.col("subject").isin(names) & F.col("article_id").isNotNull()).groupBy("article_id").agg(
        F.collect_set("subject").alias("subjects"), F.count("*").alias("votes"), F.countDistinct("annotator").alias("annotators")
    )
    few = own.orderBy(F.xxhash64("article_id", F.lit(3)), "article_id").limit(most)
    rows = articles.select(F.col("id").alias("article_id"), "doc_id", "number", "raw_text").join(F.broadcast(few), "article_id").where("raw_text IS NOT NULL").collect()  # at most SAMPLE rows
    rows.sort(key=lambda r: r["article_id"])
    at = {s: i for i, s in enumerate(names)}
    y = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for s in r["subjects"]:
            y[i, at[s]] = 1
    return fit([(r["raw_text"], source_features(r["doc_id"], r["number"], r["raw_text"])) for r in rows], y, names)


def subjects_of(articles: DataFrame, chain: Chain) -> DataFrame:
    """(article_id, subjects, log_probability) of every article."""
    shared = articles.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = shared.value
        scorer = Scorer(chain.terms)
        for batch in batches:
            strings = [clause_strings(t) if t else [] for t in batch["raw_text"]]
            sources = [source_features(d, n, t or "") for d, n, t in zip(batch["doc_id"], batch["number"], batch["raw_text"], strict=True)]
            found = chain.decode(scorer.features(strings, sources)) if len(strings) else []
            found = [f if own else ([], 0.0) for f, own in zip(found, strings, strict=True)]
            yield pd.DataFrame({"article_id": batch["id"], "subjects": [[chain.names[i] for i in f[0]] for f in found], "log_probability": [f[1] for f in found]})

    return spread(articles.select("id", "doc_id", "number", "raw_text")).mapInPandas(score, "article_id bigint, subjects array<string>, log_probability double")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "articles")
    return subjects_of(articles, chain_for(articles, table(spark, folder, "subject_labels"), table(spark, folder, "subjects")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Articles and the subjects that their provisions treat."""
    return _scored(spark, folder).select("article_id", F.explode("subjects").alias("subject"))


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each subject among articles that have any."""
    found = p3_found(spark, folder)
    counts = found.groupBy("subject").agg(F.count("*").alias("articles"))
    return counts.select("subject", "articles", F.round(F.col("articles") / F.sum("articles").over(Window.partitionBy()), 6).alias("share"))


QUERIES = {"p3_found": p3_found, "p3_shares": p3_shares}
SQL: dict[str, str] = {}
