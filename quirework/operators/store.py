"""The relational store: reads, counts, the entity index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import plain_key

CATEGORIES = {"MINISTERE": "institutions", "INSTITUTION": "institutions", "ORG": "organizations", "PERSON": "persons"}


def document(documents: DataFrame, doc_id: str) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id)


def documents_by_date(documents: DataFrame) -> DataFrame:
    """By date of publication, those without one first."""
    return documents.orderBy(F.asc_nulls_first("date_publication"), "doc_id")


def entities_by_label(entities: DataFrame, articles: DataFrame, label: str) -> DataFrame:
    """Entities of a label with the document and number of their article."""
    side = articles.select(F.col("id").alias("article_id"), "doc_id", "number")
    return entities.where(F.col("label") == label).join(side, "article_id")


def citations_to(citations: DataFrame, articles: DataFrame, target: str) -> DataFrame:
    """Resolved citations of a target with the document and number of their article."""
    side = articles.select(F.col("id").alias("article_id"), "doc_id", "number")
    return citations.where((F.col("target_text") == target) & F.col("resolved")).join(side, "article_id")


def articles_with_documents(articles: DataFrame, documents: DataFrame, lang: str | None = None) -> DataFrame:
    """Articles with the language, number and date of their issue."""
    side = documents.select("doc_id", "lang", "bo_number", "date_publication")
    return articles.join(side if lang is None else side.where(F.col("lang") == lang), "doc_id")


def index_of(index: DataFrame, doc_id: str, category: str | None = None) -> DataFrame:
    """Entries of a document's entity index, of a category if given."""
    own = index.where(F.col("doc_id") == doc_id)
    return own if category is None else own.where(F.col("category") == category)


def label_counts(entities: DataFrame) -> DataFrame:
    """(label, n) of entities."""
    return entities.groupBy("label").agg(F.count("*").alias("n"))


def entity_index(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, category, canonical, variants, articles, merged_from): entities of a document under a key without case and accents; the
    longest spelling is canonical, of equals the first in order. An entry whose whole key is one word of a longer entry goes into the
    first such by length; entries that went so take none.

    Absorption joins words of longer keys with keys, within a document and category.
    """
    named = entities.where("text IS NOT NULL").withColumn("category", F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in CATEGORIES.items()])).where("category IS NOT NULL")
    own = named.join(articles.select(F.col("id").alias("article_id"), "doc_id", "number"), "article_id").withColumn("key", plain_key(F.col("text"))).where("key <> ''")
    spelled = own.groupBy("doc_id", "category", "key", "text").agg(F.collect_set("number").alias("numbers"))
    entries = spelled.groupBy("doc_id", "category", "key").agg(
        F.min_by("text", F.struct((-F.length("text")).alias("l"), "text")).alias("canonical"),
        F.array_sort(F.collect_set("text")).alias("variants"),
        F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"),
    )
    rank = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy(F.desc(F.length("canonical")), "canonical"))
    ranked = entries.withColumn("rank", rank)
    words = ranked.select("doc_id", "category", F.col("rank").alias("into"), F.explode(F.array_distinct(F.split("key", " "))).alias("key"), F.size(F.split("key", " ")).alias("k")).where("k > 1")
    taken = ranked.select("doc_id", "category", "key", "rank").join(words, ["doc_id", "category", "key"]).where("into < rank").groupBy("doc_id", "category", "rank").agg(F.min("into").alias("into"))
    # an entry of one word takes none, so what is taken never holds another
    joined = ranked.join(taken, ["doc_id", "category", "rank"], "left").withColumn("home", F.coalesce("into", "rank"))
    gone = F.col("home") != F.col("rank")
    return joined.groupBy("doc_id", "category", "home").agg(
        F.min_by("canonical", "rank").alias("canonical"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("articles"),
        F.array_sort(F.collect_list(F.when(gone, F.col("canonical")))).alias("merged_from"),
    ).drop("home")


def consolidation(entities: DataFrame, citations: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, articles, entities, citations, resolved) of each document."""
    side = articles.select(F.col("id").alias("article_id"), "doc_id")
    n = side.groupBy("doc_id").agg(F.count("*").alias("articles"))
    e = entities.join(side, "article_id").groupBy("doc_id").agg(F.count("*").alias("entities"))
    c = citations.join(side, "article_id").groupBy("doc_id").agg(F.count("*").alias("citations"), F.count_if("resolved").alias("resolved"))
    return n.join(e, "doc_id", "left").join(c, "doc_id", "left").na.fill(0, ["entities", "citations", "resolved"])


def grouped_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, label, text, n, first): how often each text of a label occurs, with its first place."""
    return items.groupBy(*keys, "label", "text").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


#: Fields of an article for an index, with the column each shape of article may have it in, and its value where neither has.
INDEXED = {
    "article_id": (["article_id", "number"], ""), "doc_id": (["doc_id"], ""), "article_number": (["article_number", "number"], ""), "lang": (["lang"], "fr"), "bo_number": (["bo_number"], ""),
    "date_publication": (["date_publication"], ""), "instrument_type": (["instrument_type"], ""), "reference": (["reference"], ""),
}


def normalised_articles(articles: DataFrame) -> DataFrame:
    """Articles of the store or of annotated issues with the same fields: the text is raw_text if it isn't empty, else text; pages may be null."""
    there = lambda c, type_: F.col(c).cast(type_) if c in articles.columns else F.lit(None).cast(type_)
    fields = [F.coalesce(*[there(c, "string") for c in own], F.lit(default)).alias(name) for name, (own, default) in INDEXED.items()]
    text = F.coalesce(F.when(there("raw_text", "string") != "", there("raw_text", "string")), there("text", "string"), F.lit(""))
    return articles.select(*fields, text.alias("text"), there("pdf_page", "int").alias("pdf_page"), there("printed_page", "int").alias("printed_page"))
