"""Language by script, and routing by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import arabic_letters, letters


def with_model(text: Column, model: Callable[[Column], Column] | None = None) -> Column:
    """struct(language, confidence, method) by a model, or by script without one or where it gives null."""
    return detected(text) if model is None else F.coalesce(model(text), detected(text))


def detected(text: Column) -> Column:
    """struct(language, confidence, method): Arabic characters over letters. More than half: ar; from 0.4: mixed; else fr.
    Without letters, or null: unknown. Arabic digits and marks count above the line only, so a confidence may pass 1."""
    n = letters(text)
    ratio = arabic_letters(text) / n
    blank = text.isNull() | (n == 0)
    language = F.when(blank, "unknown").when(ratio > 0.5, "ar").when(ratio >= 0.4, "mixed").otherwise("fr")
    confidence = F.when(blank, 0.0).when(ratio > 0.5, ratio).when(ratio >= 0.4, 0.5).otherwise(1 - ratio)
    return F.struct(language.alias("language"), confidence.cast("double").alias("confidence"), F.lit("unicode_heuristic").alias("method"))


def routed(text: Column, least: float = 0.30) -> Column:
    """ar if Arabic characters are more than the given share of letters, else fr."""
    return F.when(arabic_letters(text) > least * letters(text), "ar").otherwise("fr")


def split_lines(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, text): the lines of each text by the language of each, in order, joined by line feeds."""
    own = frame.select(F.col(key).alias("own_key"), F.col(text).alias("whole"))
    lines = own.select("own_key", F.posexplode(F.split("whole", "\n")).alias("place", "line")).where(F.trim("line") != "")
    lines = lines.withColumn("language", F.when(detected(F.col("line"))["language"].isin("fr", "ar"), detected(F.col("line"))["language"]).otherwise("unknown"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    joined = lines.groupBy("own_key", "language").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    return joined.withColumnRenamed("own_key", key)


def split_documents(pages: DataFrame, key: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """(key, language, text): page texts by language in page order, joined by blank lines; other languages are unknown."""
    own = pages.withColumn("code", detected(F.col(text))["language"])
    own = own.withColumn("language", F.when(F.col("code").isin("fr", "ar"), F.col("code")).otherwise("unknown"))
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return own.where(F.col(text).isNotNull()).groupBy(key, "language").agg(F.array_join(F.transform(ordered, lambda x: x[text]), "\n\n").alias("text"))


def path_language(path: Column, text: Column) -> Column:
    """Language named by a folder or file of the path, else that of the text."""
    named = F.lower(F.regexp_extract(path, r"(?i)(?:^|[/_.\-])(fr|ar)(?=[/_.\-]|$)", 1))
    return F.when(named != "", named).otherwise(routed(text))
