"""Domains by keywords, training rows and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import fixed
from quirework.functions.text import let, strip

LEAST_TRAINING, MOST_TRAINING, LEAST_CLASS, FOLDS, SEED = 30, 6000, 10, 5, 42


NAMES = list(fixed.DOMAINS)
SEPARATOR = r"[^\p{L}\p{M}\p{N}_]+"


def _split_words(lang: int) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """Single words with their domain; the rest with their domain and pattern."""
    single, several = {}, []
    for domain, lists in fixed.DOMAINS.items():
        for w in map(str.lower, lists[lang]):
            if w == "بناء" or not all(c.isalnum() for c in w):
                own = "".join(c if c.isalnum() or c == " " else "\\" + c for c in w) + (r"(?![\p{L}\p{M}\p{N}_])" + (r"(?!\s+على)" if w == "بناء" else ""))
                several.append((domain, w, r"(?<![\p{L}\p{M}\p{N}_])" + own))
            else:
                single[w] = domain
    return single, several


def _counts(lower: Column, lang: int) -> Column:
    """The numbers of keywords of each domain, in order. Words are split off once and looked up; only keywords of several words are
    searched for."""
    single, several = _split_words(lang)
    table = F.create_map(*[F.lit(x) for kv in single.items() for x in kv])
    hits = F.filter(F.transform(F.split(lower, SEPARATOR), lambda w: F.try_element_at(table, w)), lambda d: d.isNotNull())

    def count(d: str, found: Column) -> Column:
        rest = [F.when(lower.contains(w), F.regexp_count(lower, F.lit(p))).otherwise(0) for own, w, p in several if own == d]
        return reduce(lambda a, b: a + b, rest, F.size(F.filter(found, lambda x: x == d)))

    return let(hits, lambda found: F.array(*[count(d, found) for d in NAMES]))


def domain_scores(text: Column, lang: Column) -> Column:
    """map of domain to the number of its keywords in a text, whole words; a language but fr and ar is an error."""
    checked = F.when(lang.isin("fr", "ar"), lang).otherwise(F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(lang, F.lit("null")))))
    counts = let(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.when(checked == "ar", _counts(t, 1)).otherwise(_counts(t, 0)))
    return F.map_from_arrays(F.array(*map(F.lit, NAMES)), counts)


def _ranked(scores: Column) -> Column:
    """(-score, place, domain), best first."""
    return F.array_sort(F.transform(F.array(*map(F.lit, NAMES)), lambda d, i: F.struct((-scores[d]).alias("s"), i.alias("k"), d.alias("d"))))


def best_domain(scores: Column) -> Column:
    """The domain with the highest score, the first of equals; undetermined if all are 0."""
    return let(scores, lambda s: let(_ranked(s)[0], lambda top: F.when(top["s"] < 0, top["d"]).otherwise(fixed.UNDETERMINED)))


def top_scores(scores: Column, n: int = 3) -> Column:
    """The n highest scores above 0 as text, highest first."""
    kept = let(scores, lambda s: F.slice(F.filter(_ranked(s), lambda x: x["s"] < 0), 1, n))
    return F.array_join(F.transform(kept, lambda x: F.concat(x["d"], F.lit(":"), (-x["s"]).cast("string"))), "; ")


def classify(text: Column, lang: Column, model: Callable[[Column, Column], Column] | None = None) -> Column:
    """The domain by a model, or by keywords without one or where it gives null."""
    by_words = best_domain(domain_scores(text, lang))
    return by_words if model is None else F.coalesce(model(text, lang), by_words)


def document_domain(articles: DataFrame) -> DataFrame:
    """(doc_id, domain) of the joined texts of a document's articles. Scores add up, so no text is joined: the blanks between articles
    end words as the ends of texts do."""
    own = articles.select("doc_id", "lang", domain_scores(F.col("text"), F.col("lang")).alias("s"))
    summed = own.groupBy("doc_id").agg(*[F.sum(F.col("s")[d]).alias(d) for d in fixed.DOMAINS])
    scores = F.create_map(*[x for d in fixed.DOMAINS for x in (F.lit(d), F.col(f"`{d}`"))])
    return summed.select("doc_id", best_domain(scores).alias("domain"))


def training_rows(articles: DataFrame) -> DataFrame:
    """(id, lang, text, truncated, label, top_scores) of articles long enough."""
    own = articles.select("id", "lang", strip(F.col("text")).alias("whole")).where(F.length("whole") >= LEAST_TRAINING)
    cut = own.withColumn("text", F.left("whole", F.lit(MOST_TRAINING))).withColumn("s", domain_scores(F.col("text"), F.col("lang")))
    return cut.select("id", "lang", "text", (F.length("whole") > MOST_TRAINING).alias("truncated"), best_domain(F.col("s")).alias("label"), top_scores(F.col("s")).alias("top_scores"))


def kept_classes(rows: DataFrame, label: str = "label", least: int = LEAST_CLASS) -> DataFrame:
    """Rows of classes large enough, without the undetermined."""
    large = rows.where(F.col(label) != fixed.UNDETERMINED).groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(label)
    return rows.join(large, label, "left_semi")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): all rows over classes times rows of the class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row a class
    return counts.select(label, "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


def folds(rows: DataFrame, key: str, label: str = "label", k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Rows with a fold that each class is spread over by a seeded hash."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(label), F.lit(seed)), F.lit(k)).cast("int"))


def metrics(pairs: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """(label, support, precision, recall, f1) of each label of either side; where nothing is to divide by, 0. The row with a null label
    has the accuracy as precision and recall, and the mean f1."""
    cells = pairs.groupBy(truth, found).agg(F.count("*").alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("t"), F.lit(0).alias("p")), F.struct(F.col(found).alias("label"), F.lit(0).alias("t"), F.col("n").alias("p")))).alias("x"), F.when(F.col(truth) == F.col(found), F.col("n")).otherwise(0).alias("hit"))
    sums = each.groupBy("x.label").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), (F.sum("hit") / 2).alias("h"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = sums.select("label", F.col("t").alias("support"), rate(F.col("h"), F.col("p")).alias("precision"), rate(F.col("h"), F.col("t")).alias("recall"), "h")
    rows = rows.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    total = rows.agg(F.sum("support").alias("support"), rate(F.sum("h"), F.sum("support")).alias("precision"), F.avg("f1").alias("f1"))
    both = rows.drop("h").unionByName(total.select(F.lit(None).cast("string").alias("label"), "support", "precision", F.col("precision").alias("recall"), "f1"))
    return both.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
