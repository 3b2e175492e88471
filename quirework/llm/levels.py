"""Reading level by regularised ordinal regression.

Features of a text: lexical diversity, rarity of its words in the whole corpus, grades of its words and connectives as
graded texts teach them, connectives a word and a sentence, clause depth (subordinators, relatives and linked clauses a
sentence, the most in one, the share of sentences with two), and lengths. The words that link are fixed lists for fr, ar, en
and es, of which a text uses that of the language whose commonest words it has most of. A cumulative logit with a ridge penalty turns them into one of five ordered levels. Its graded texts are a bounded sample;
the grades of words are cross-fitted there, so that a text never grades its own words. A rater who stands off the others
by about a level is moved back before the final fit. Probabilities are calibrated on held-out folds of the graded texts.

Rarity is counted over all documents. Words are kept from a share of all words on, so the table holds at most 1 / share
of them at any size; other words count as rare as that share. Texts are scored whole.

A null or wordless text gets level 1. Rows and ties need no order; labels that are null or out of 1 to 5 are not used.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.sources.tables import cut, spread, table

#: Most graded texts to learn from.
SAMPLE = 6000
#: Least share of all words that a word in the rarity table has.
LEAST_SHARE = 1e-5
LEVELS = 5
FOLDS = 5
RIDGE = 1.0

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?؟;؛]+(?:\s+|$)|\n{2,}")
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Features of a text.
WIDTH = 37

#: The commonest words of languages in Latin letters, and the words of each language (and pairs of words) that link sentences and clauses.
COMMONEST = {
    "fr": "le la les des du et est une dans au aux par pour sur ce".split(),
    "en": "the of and is to in by for on this are be it".split(),
    "es": "el los las del y es una en por para con se al".split(),
}
LINKS = {
    "fr": {
        "connective": [*"ainsi donc cependant toutefois néanmoins pourtant or car enfin ensuite puis alors aussi notamment également finalement premièrement deuxièmement inversement".split(),
                       "en effet", "en outre", "en revanche", "en conséquence", "de plus", "par conséquent", "par ailleurs", "par exemple", "au contraire", "d abord", "d ailleurs", "dès lors"],
        "subordinator": "que qu si parce lorsque lorsqu quand puisque puisqu quoique quoiqu comme afin tandis pourvu jusqu bien".split(),
        "relative": "qui dont où lequel laquelle lesquels lesquelles auquel auxquels auxquelles duquel desquels desquelles".split(),
        "linked": "et ou mais ni".split(),
    },
    "ar": {
        "connective": [*"لذلك لذا إذن اذن لكن كذلك أيضا ايضا ثم بالتالي هكذا بالإضافة بالاضافة غير فضلا علاوة أخيرا اخيرا أولا اولا ثانيا خاصة".split(), "مع ذلك", "على ذلك", "في المقابل", "نتيجة لذلك"],
        "subordinator": "أن ان إن بأن بان لأن لان كأن إذا اذا لو كي لكي حتى حيث عندما حينما بينما لما كلما متى كما رغم ريثما".split(),
        "relative": "الذي التي الذين اللذان اللتان اللذين اللتين اللواتي اللاتي مما ممن".split(),
        "linked": "و أو او أم بل".split(),
    },
    "en": {
        "connective": [*"however therefore thus hence moreover furthermore nevertheless nonetheless consequently then also besides finally first second meanwhile instead otherwise indeed accordingly".split(),
                       "in addition", "in contrast", "in particular", "for example", "for instance", "as well", "after all"],
        "subordinator": "that if because when while although though since unless until whereas whether after before once lest as".split(),
        "relative": "which who whom whose where whereby wherein".split(),
        "linked": "and or but nor yet so".split(),
    },
    "es": {
        "connective": [*"además entonces así luego pues también finalmente asimismo consiguientemente igualmente primero segundo".split(),
                       "sin embargo", "no obstante", "por tanto", "por consiguiente", "por ejemplo", "en cambio", "es decir", "por otra", "en efecto"],
        "subordinator": "que si porque cuando aunque mientras puesto como conforme ya".split(),
        "relative": "quien quienes cuyo cuya cuyos cuyas donde cual cuales".split(),
        "linked": "y e o u pero ni sino".split(),
    },
}
for _kind in ("connective", "subordinator", "relative"):  # Arabic conjunctions are written together with what they introduce
    LINKS["ar"][_kind] += [c + w for w in LINKS["ar"][_kind] for c in "وف" if " " not in w]
LINKS = {lang: {kind: frozenset(words) for kind, words in own.items()} for lang, own in LINKS.items()}
COMMONEST = {lang: frozenset(words) for lang, words in COMMONEST.items()}


def word_rarity(documents: DataFrame, text: str = "text", least: float = LEAST_SHARE) -> dict[str, float]:
    """Bits of each word, from its share of all words of all documents."""
    words = documents.where(F.col(text).isNotNull()).select(F.explode(F.expr(f"regexp_extract_all(lower(`{text}`), '[\\\\p{{L}}]+', 0)")).alias("word"))
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= least * total)
    return {r["word"]: float(np.log2(total / r["n"])) for r in kept.limit(int(1 / least) + 1).collect()}


def _tokens(text: str) -> tuple[list[list[str]], list[str]]:
    sentences = [w for s in SENTENCE.split(text or "") if (w := [x.lower() for x in WORD.findall(s)])]
    return sentences, [w for s in sentences for w in s]


def links(sentences: list[list[str]]) -> list[float]:
    """Connectives a word and a sentence; subordinators, relatives and linked clauses a sentence; the most subordinate clauses
    of a sentence, as a logarithm, and the share of sentences with two or more."""
    words = [w for s in sentences for w in s]
    if sum("\u0600" <= w[0] <= "\u06ff" for w in words) * 2 > len(words):
        lang = "ar"
    else:
        lang = max(("fr", "en", "es"), key=lambda x: sum(w in COMMONEST[x] for w in words))
    own = LINKS[lang]
    count = lambda kind, of: sum(map(own[kind].__contains__, of))
    connective = count("connective", words) + sum(count("connective", map(" ".join, zip(s, s[1:], strict=False))) for s in sentences)
    linked = count("linked", words)
    if lang == "ar":
        linked += sum(w[0] == "و" and len(w) > 4 and w not in own["linked"] for w in words)
    subordinate = np.array([count("subordinator", s) for s in sentences])
    relative = np.array([count("relative", s) for s in sentences])
    deep = subordinate + relative
    n = len(sentences)
    return [connective / len(words), connective / n, float(subordinate.sum()) / n, float(relative.sum()) / n, linked / n, float(np.log1p(deep.max())), float((deep > 1).mean())]


def _quantiles(values: np.ndarray, at: tuple[float, ...]) -> list[float]:
    """Quantiles by linear interpolation of values in order."""
    places = np.array(at) * (len(values) - 1)
    low = places.astype(int)
    high = np.minimum(low + 1, len(values) - 1)
    return (values[low] + (values[high] - values[low]) * (places - low)).tolist()


def features(text: str, rarity: dict[str, float], grades: dict[str, float], floor: float, middle: float) -> np.ndarray:
    """The features of one text."""
    sentences, words = _tokens(text)
    if not words:
        return np.zeros(WIDTH)
    rare = np.array([rarity.get(w, floor) for w in words])
    grade = np.array([grades.get(w, middle) for w in words])
    paired = np.array([grades.get(a + " " + b, middle) for s in sentences for a, b in zip(s, s[1:], strict=False)] or [middle])
    lengths = np.array([len(s) for s in sentences], float)
    sentence = np.add.reduceat(grade, np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(int)) / lengths
    rare_, grade_, paired_ = np.sort(rare), np.sort(grade), np.sort(paired)
    per = (1 - np.searchsorted(paired_, (2.0, 2.6, 3.2, 3.8, 4.4), "right") / len(paired_)).tolist()
    commas = text.count(",") + text.count("،")
    return np.array(
        [
            len(set(words)) / len(words) ** 0.75,
            rare.mean(), *_quantiles(rare_, (0.5, 0.75, 0.9)),
            grade.mean(), grade.std(), *_quantiles(grade_, QUANTILES),
            paired.mean(), *_quantiles(paired_, (0.25, 0.5, 0.75)), *per,
            sentence.mean(), sentence.std(), sentence.min(), sentence.max(),
            np.log(lengths.mean()), np.log(lengths.max()), np.log(_quantiles(np.sort(lengths), (0.5,))[0]),
            sum(map(len, words)) / len(words), commas / len(sentences),
            *links(sentences),
        ]
    )


def grade_words(texts: list[str], levels: np.ndarray, prior: float = 2.0) -> dict[str, float]:
    """Mean level of the texts that hold a word or pair of words, drawn to the middle where they are few."""
    sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    middle = float(np.mean(levels))
    for text, level in zip(texts, levels, strict=True):
        sentences, words = _tokens(text)
        for w in {*words, *(a + " " + b for s in sentences for a, b in zip(s, s[1:], strict=False))}:
            sums[w][0] += level
            sums[w][1] += 1
    return {w: (s + prior * middle) / (n + prior) for w, (s, n) in sums.items() if n > 1}


def _probabilities(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    over = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -40, 40)))
    edge = np.hstack([np.ones((len(z), 1)), over, np.zeros((len(z), 1))])
    return edge[:, :-1] - edge[:, 1:]


def calibration(x: np.ndarray, y: np.ndarray) -> float:
    """The slope that makes probabilities of held-out folds as likely as may be."""
    fold = np.random.default_rng(11).permutation(len(y)) % FOLDS
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for f in range(FOLDS):
        rest, own = fold != f, fold == f
        if own.any() and len(set(y[rest])) > 1:
            mean, scale, weights, cuts = fit_ordinal(x[rest], y[rest])
            held.append((((x[own] - mean) / scale) @ weights, cuts, y[own].astype(int)))
    slopes = np.geomspace(0.2, 2.0, 25)
    loss = [sum(-np.log(np.maximum(_probabilities(a * z, a * cuts)[np.arange(len(k)), k - 1], 1e-9)).sum() for z, cuts, k in held) for a in slopes]
    return float(slopes[int(np.argmin(loss))]) if held else 1.0


@dataclass(frozen=True)
class Model:
    """Ordinal regression: P(level > k) = logistic(x w - cut_k)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    rarity: dict[str, float]
    grades: dict[str, float]
    floor: float
    middle: float
    slope: float = 1.0

    def level(self, x: np.ndarray) -> np.ndarray:
        """The likeliest level before calibration, which changes how sure it is."""
        return _probabilities(((x - self.mean) / self.scale) @ self.weights, self.cuts).argmax(1) + 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the levels."""
        return _probabilities(self.slope * (((x - self.mean) / self.scale) @ self.weights), self.slope * self.cuts)

    def rows(self, texts: list[str]) -> np.ndarray:
        return np.array([features(t, self.rarity, self.grades, self.floor, self.middle) for t in texts]).reshape(len(texts), WIDTH)


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale, weights and cuts, by damped Newton steps on the stacked binary form of the cumulative logit."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    n, d = z.shape
    k = LEVELS - 1
    theta = np.concatenate([np.zeros(d), np.linspace(-2, 2, k)])
    penalty = np.concatenate([np.full(d, ridge), np.full(k, 1e-3)])
    design = np.hstack([np.repeat(z, k, axis=0), -np.tile(np.eye(k), (n, 1))])
    target = (y[:, None] > np.arange(1, LEVELS)[None, :]).astype(float).ravel()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        gradient = design.T @ (p - target) + penalty * theta
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty) + 1e-6 * np.eye(d + k)
        step = np.linalg.solve(curve, gradient)
        theta = theta - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return mean, scale, theta[:d], np.sort(theta[d:])


def fit(texts: list[str], levels: np.ndarray, raters: list[str], rarity: dict[str, float]) -> Model:
    """The model of graded texts."""
    floor = max(rarity.values(), default=0.0) + 1.0
    y = np.asarray(levels, float)
    if not len(y):
        texts, y, raters = [""] * LEVELS, np.arange(1, LEVELS + 1).astype(float), [""] * LEVELS
    fold = np.random.default_rng(10).permutation(len(y)) % FOLDS

    def crossed(y: np.ndarray) -> np.ndarray:
        x = np.zeros((len(y), WIDTH))
        for f in range(FOLDS):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            grades = grade_words([texts[i] for i in rest], y[rest]) if len(rest) else {}
            middle = float(y[rest].mean()) if len(rest) else 3.0
            for i in own:
                x[i] = features(texts[i], rarity, grades, floor, middle)
        return x

    def moved(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        mean, scale, weights, cuts = fit_ordinal(x, y)
        at = 1 + (((x - mean) / scale) @ weights[:, None] > cuts[None, :]).sum(1)
        own = y.copy()
        for r in set(raters):
            mine = np.array([q == r for q in raters])
            off = float(np.mean(y[mine] - at[mine]))
            if abs(off) > 0.5:
                own[mine] = np.clip(y[mine] - np.sign(off), 1, LEVELS)
        return own

    x = crossed(y)
    fixed = moved(y, x)
    if (fixed != y).any():
        x = crossed(fixed)
    # labels one level off pull little once the fit knows most of them; a second fit leaves out the clear misfits
    slope = calibration(x, fixed)
    mean, scale, weights, cuts = fit_ordinal(x, fixed)
    at = 1 + (((x - mean) / scale) @ weights[:, None] > cuts[None, :]).sum(1)
    good = np.abs(at - fixed) < 1
    if good.sum() > 0.6 * len(fixed) and len(set(fixed[good])) > 1:
        mean, scale, weights, cuts = fit_ordinal(x[good], fixed[good])
        kept = [t for t, g in zip(texts, good, strict=True) if g]
        return Model(mean, scale, weights, cuts, rarity, grade_words(kept, fixed[good]), floor, float(fixed[good].mean()), slope)
    return Model(mean, scale, weights, cuts, rarity, grade_words(texts, fixed), floor, float(fixed.mean()), slope)


def model_for(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model of a bounded sample, spread by a hash, of the graded documents."""
    graded = labels.where(F.col("level").between(1, LEVELS)).select("doc_id", "level", "rater")
    few = graded.orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id", "rater", "level").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").where("text IS NOT NULL").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["rater"] or "", r["level"]))
    return fit([r["text"] for r in rows], np.array([r["level"] for r in rows], float), [r["rater"] or "" for r in rows], word_rarity(documents))


def levels(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, level, confidence, expected) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            x = model.rows(texts)
            p, level = model.probabilities(x), model.level(x)
            level[[not WORD.search(t) for t in texts]] = 1
            yield pd.DataFrame({"doc_id": batch["doc_id"], "level": level.astype("int32"), "confidence": p.max(1), "expected": p @ np.arange(1, LEVELS + 1)})

    return spread(documents.select("doc_id", "text")).mapInPandas(score, "doc_id bigint, level int, confidence double, expected double")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return levels(documents, model_for(documents, table(spark, folder, "level_labels")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its level."""
    return _scored(spark, folder).select("doc_id", "level")


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by level, with the mean of the expected level."""
    return _scored(spark, folder).groupBy("level").agg(F.count("*").alias("documents"), F.round(F.avg("expected"), 4).alias("expected"))


QUERIES = {"p10_found": p10_found, "p10_profile": p10_profile}
SQL: dict[str, str] = {}
