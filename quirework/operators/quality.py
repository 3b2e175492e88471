"""Rules for annotated issues; each gives the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import fixed


def _broken(rows: DataFrame, rule: str, key) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), "doc_id", key.cast("string").alias("key"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def schema_rules(documents: DataFrame, articles: DataFrame, instruments: DataFrame) -> DataFrame:
    """(rule, doc_id, key): missing fields, numbers of articles that differ, identifiers that repeat or lead nowhere, pages out of bounds."""
    counted = documents.join(articles.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    repeated = lambda rows, c: rows.where(F.col(c).isNotNull()).groupBy("doc_id", c).agg(F.count("*").alias("k")).where("k > 1")
    side = instruments.select("doc_id", F.col("instrument_id")).distinct()
    return _all(
        [
            _broken(documents.where("doc_id IS NULL OR lang IS NULL"), "document_field", F.col("doc_id")),
            _broken(counted.where("coalesce(n, 0) <> n_articles"), "article_count", F.col("n_articles")),
            _broken(articles.where("number IS NULL OR raw_header IS NULL OR text IS NULL"), "article_field", F.col("article_idx")),
            _broken(instruments.where("instrument_type IS NULL OR instrument_id IS NULL"), "instrument_field", F.col("instrument_id")),
            _broken(repeated(instruments, "instrument_id"), "instrument_id_repeats", F.col("instrument_id")),
            _broken(repeated(articles, "article_id"), "article_id_repeats", F.col("article_id")),
            _broken(articles.where("instrument_id IS NOT NULL").join(side, ["doc_id", "instrument_id"], "left_anti"), "instrument_unknown", F.col("article_idx")),
            _broken(articles.join(documents.select("doc_id", "total_pdf_pages"), "doc_id").where("pdf_page > total_pdf_pages"), "page_bound", F.col("article_idx")),
        ]
    )


def page_rules(articles: DataFrame) -> DataFrame:
    """(rule, doc_id, key): pages below 1, and pages of numbered articles that go back."""
    mapped = articles.where("pdf_page IS NOT NULL")
    before = F.max("pdf_page").over(Window.partitionBy("doc_id").orderBy("article_idx").rowsBetween(Window.unboundedPreceding, -1))
    back = mapped.where(F.col("number").rlike("^[0-9]+$")).withColumn("before", before).where("pdf_page < before")
    return _all([_broken(mapped.where("pdf_page < 1"), "page_positive", F.col("article_idx")), _broken(back, "page_order", F.col("article_idx"))])


def instrument_rules(instruments: DataFrame) -> DataFrame:
    """(rule, doc_id, key): kinds that are none, identifiers that repeat."""
    wrong = instruments.where(~F.col("instrument_type").isin(fixed.INSTRUMENT_TYPES) | F.col("instrument_type").isNull())
    twice = instruments.groupBy("doc_id", "instrument_id").agg(F.count("*").alias("k")).where("k > 1")
    return _all([_broken(wrong, "instrument_type", F.col("instrument_id")), _broken(twice, "instrument_id_repeats", F.col("instrument_id"))])
