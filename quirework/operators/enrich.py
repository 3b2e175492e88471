"""The whole chain for articles: references and dates, citations, persons and organisations, each filtered, merged and unique."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.operators import spans as S


def enrich(articles: DataFrame, recognise: Callable[[Column, Column], Column] | None = None, keep_companies: bool = False) -> DataFrame:
    """Articles (with lang and text) with entities, dates, citations, persons and organizations, arrays of spans.

    recognise: a plug-in (text, lang) that gives spans labelled PERSON and ORG; asked only where an article names a legal text. What it
    gives never overrides a rule. Persons that are companies by context go to the organisations; keep_companies adds names in capitals
    even without a word of institutions.
    """
    text, lang = F.col("text"), F.col("lang")
    found = articles.withColumn("found", S.find_legal_entities(text, lang)).withColumn("cited", S.find_citations(text, lang)).withColumn("capitals", S.find_companies(text, lang))
    own = F.filter("found", lambda s: S.valid(s["text"], s["label"]))
    dated = F.filter("found", lambda s: s["label"].isin("DATE_GREGORIAN", "DATE_HIJRI") & S.has_month(s["text"], lang))
    if recognise is None:
        seen = found.withColumn("named", F.array().cast(S.SPANS))
    else:
        legal = S.has_legal_entity(F.col("found"))
        seen = found.withColumn("named", F.coalesce(recognise(F.when(legal, text), lang), F.array().cast(S.SPANS)))
    seen = seen.withColumn("named", F.filter("named", lambda s: ~F.exists("found", lambda r: S.overlaps(s, r))))
    seen = seen.withColumn("named", S.reclassified(F.col("named"), text, F.col("capitals")))
    persons = F.filter("named", lambda s: (s["label"] == "PERSON") & S.likely_person(s["text"], lang) & S.gazetteer_person(s["text"], s["start"], s["end_pos"], text))
    organisations = F.filter("named", lambda s: (s["label"] == "ORG") & S.likely_organisation(s["text"], lang))
    ruled = F.filter("found", lambda s: s["label"].isin("ORG", "MINISTERE", "INSTITUTION"))
    return seen.select(
        *articles.columns,
        S.first_of_text(S.by_start(own)).alias("entities"),
        dated.alias("dates"),
        F.col("cited").alias("citations"),
        S.unique_spans(persons).alias("persons"),
        S.unique_spans(F.concat(ruled, organisations, F.col("capitals") if keep_companies else F.array().cast(S.SPANS))).alias("organizations"),
    )
