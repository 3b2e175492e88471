"""Citations of articles tied to the texts they cite, and decree entities passed to their articles.

A citation meets the references of its article as rows; tiers and nearness are sort keys, so the choice is one window. An
article's citations and references are few; articles are spread over the cluster by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import fixed

WINDOW = 300
CONTEXT = 80
GAP = 20
EXPLICIT = {"fr": r"(?iu)de la loi|du d[ée]cret|de l['’]arr[êe]t[ée]|du dahir", "ar": "من"}
ANAPHORIC = {"fr": r"(?iu)ci-dessus|ci-après|pr[ée]sent(?:e)?|susmentionn[ée]|pr[ée]cit[ée]", "ar": "أعلاه|أدناه|هذا(?:\\s+ال\\p{L}+)?|المذكور"}
#: Words that name a kind of text, in the order they are tried.
KINDS = [("décret", "DECRET"), ("dahir", "DAHIR"), ("arrêté", "ARRETE"), ("arrête", "ARRETE"), ("loi", "LOI"), ("décision", "DECISION")]


def _by_lang(lang: Column, text: Column, patterns: dict[str, str]) -> Column:
    return F.when(lang == "ar", text.rlike(patterns["ar"])).otherwise(text.rlike(patterns["fr"]))


def _between(text: Column, low: Column, high: Column) -> Column:
    return F.when(low < high, F.substring(text, low + 1, high - low)).otherwise("")


def resolve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, citation_no, text, start, end_pos, target_label, target_text, resolved, resolution_type) of each citation.

    rows: keys, doc_id, lang, text, citations and references (arrays of spans). Of references near the citation, the first with an
    explicit link wins; then the first whose own words complete the link; then the first that ends just before. Else a pointing
    word makes it the nearest of the kind it names, or the nearest. Else the nearest. Without references it is the document.
    """
    rows = rows.select(*keys, "doc_id", "lang", F.col("text").alias("body"), "citations", F.filter("references", lambda s: s["label"].isin(fixed.LEGAL_OR_ISSUE)).alias("refs"))
    cited = rows.select(*keys, "doc_id", "lang", "body", "refs", F.posexplode("citations").alias("citation_no", "c"))
    context = F.substring("body", F.col("c.start") + 1, F.col("c.end_pos") - F.col("c.start") + CONTEXT)
    named = lambda t: F.coalesce(*[F.when(F.lower(t).contains(w), F.lit(label)) for w, label in KINDS])
    cited = cited.withColumn("kind", F.coalesce(named(F.col("c.text")), named(context))).withColumn("points", _by_lang(F.col("lang"), context, ANAPHORIC))
    pairs = cited.select("*", F.posexplode_outer("refs").alias("ref_no", "r"))
    c_end, r_start, r_end = F.col("c.end_pos"), F.col("r.start"), F.col("r.end_pos")
    distance = F.abs(r_start - c_end)
    near = F.col("r.label").isin(fixed.LEGAL_LABELS) & (distance <= WINDOW)
    link = _by_lang(F.col("lang"), _between(F.col("body"), c_end, r_start), EXPLICIT)
    own = _by_lang(F.col("lang"), _between(F.col("body"), c_end, r_end), EXPLICIT)
    adjacent = (r_end <= F.col("c.start")) & (F.length(F.trim(_between(F.col("body"), r_end, F.col("c.start")))) < GAP)
    same_kind = F.col("points") & (F.col("r.label") == F.col("kind"))
    tier = F.when(near & link, 1).when(near & own, 2).when(near & adjacent, 3).when(same_kind, 4).otherwise(5)
    ranked = pairs.withColumn("tier", tier).withColumn("far", F.when(F.col("tier") <= 3, 0).otherwise(distance))
    best = Window.partitionBy(*keys, "citation_no").orderBy("tier", "far", "ref_no")
    chosen = ranked.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    none = F.col("r").isNull()
    how = (
        F.when(none & F.col("points"), "anaphoric").when(none, "fallback_document").when(F.col("tier") <= 3, "explicit").when(F.col("tier") == 4, "anaphoric_resolved")
        .when(F.col("points"), "anaphoric_fallback_entity").otherwise("fallback_closest")
    )
    return chosen.select(
        *keys, "citation_no", F.col("c.text").alias("text"), F.col("c.start").alias("start"), F.col("c.end_pos").alias("end_pos"),
        F.coalesce("r.label", F.lit("DOCUMENT_SOURCE")).alias("target_label"), F.coalesce("r.text", "doc_id").alias("target_text"), F.lit(True).alias("resolved"), how.alias("resolution_type"),
    )


def decree_of_articles(articles: DataFrame, decrees: DataFrame) -> DataFrame:
    """Articles with the decree they belong to: the last that starts at or before them. A union and a running value, no range join."""
    starts = decrees.groupBy("doc_id", F.col("first_article_idx").alias("article_idx")).agg(F.max("decree_idx").alias("decree_idx"))
    marks = starts.select("doc_id", "article_idx", F.col("decree_idx"), F.lit(0).alias("is_article")).unionByName(
        articles.select("doc_id", "article_idx", F.lit(None).cast("int").alias("decree_idx"), F.lit(1).alias("is_article"))
    )
    order = Window.partitionBy("doc_id").orderBy("article_idx", "is_article").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.withColumn("decree_idx", F.last("decree_idx", ignorenulls=True).over(order)).where("is_article = 1").select("doc_id", "article_idx", "decree_idx")
    return articles.join(held, ["doc_id", "article_idx"], "left")


def passed_down(own: DataFrame, decree: DataFrame) -> DataFrame:
    """Entities of articles and those of their decrees that the article doesn't name yet, whatever case, without offsets.

    own: doc_id, article_idx, label, text, start, end_pos. decree: doc_id, article_idx, label, text.
    """
    key = F.lower("text")
    known = own.select("doc_id", "article_idx", key.alias("key")).distinct()
    extra = decree.withColumn("key", key).dropDuplicates(["doc_id", "article_idx", "key"]).join(known, ["doc_id", "article_idx", "key"], "left_anti")
    return own.select("doc_id", "article_idx", "label", "text", "start", "end_pos").unionByName(
        extra.select("doc_id", "article_idx", "label", "text", F.lit(-1).alias("start"), F.lit(-1).alias("end_pos"))
    )


def with_decree_targets(citations: DataFrame, decrees: DataFrame) -> DataFrame:
    """Citations of the document itself point to their decree's own reference, where it has one.

    citations: doc_id, decree_idx and the columns of resolve. decrees: doc_id, decree_idx, label, text.
    """
    titles = decrees.select("doc_id", "decree_idx", F.col("label").alias("d_label"), F.col("text").alias("d_text")).dropDuplicates(["doc_id", "decree_idx"])
    own = (F.col("target_label") == "DOCUMENT_SOURCE") & F.col("d_text").isNotNull()
    joined = citations.join(titles, ["doc_id", "decree_idx"], "left")
    return joined.withColumn("target_text", F.when(own, F.col("d_text")).otherwise(F.col("target_text"))).withColumn("target_label", F.when(own, F.col("d_label")).otherwise(F.col("target_label"))).drop("d_label", "d_text")


def placed_by_number(spans: Column, text: Column) -> Column:
    """References moved to where their number stands in a text; -1 where it doesn't. For references passed down from decrees and issues."""

    def place(s: Column) -> Column:
        number = F.regexp_extract(s["text"], r"\d+(?:[-–.]\d+){1,2}", 0)
        at = F.when(number != "", F.instr(text, number) - 1).otherwise(-1)
        return s.withField("start", at.cast("int")).withField("end_pos", F.when(at >= 0, at + F.length(number)).otherwise(-1).cast("int"))

    return F.transform(spans, place)


def resolve_again(resolved: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Citations of articles with any that cites the document itself, resolved once more with all references known (those of the article, its decree and its
    issue), placed by their numbers; what stays without a reference keeps its target.

    resolved: the columns of resolve. rows: keys, doc_id, lang, text, citations, references."""
    left = resolved.where("target_label = 'DOCUMENT_SOURCE'").select(*keys).distinct()
    again = resolve(rows.join(left, keys).withColumn("references", placed_by_number(F.col("references"), F.col("text"))), keys)
    found = again.where("target_label <> 'DOCUMENT_SOURCE'").select(*keys, "citation_no", *[F.col(c).alias(f"new_{c}") for c in ("target_label", "target_text", "resolution_type")])
    joined = resolved.join(found, [*keys, "citation_no"], "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("target_label", "target_text", "resolution_type") else F.col(c) for c in resolved.columns])


def edges(citations: DataFrame) -> DataFrame:
    """The citation graph: distinct (doc_id, target_label, target_text) with how often each is cited."""
    return citations.groupBy("doc_id", "target_label", "target_text").agg(F.count("*").alias("citations"), F.count_if("resolved").alias("resolved"))
