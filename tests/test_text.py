from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.functions import language
from quirework.functions import text as T


def one(spark, column_of, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column_of(F.col("t")).alias("x")).collect()]


def test_french_cleaning(spark):
    text = "Edition générale...................790\r\nL'opération ................ recours\r\n\r\n\r\nle texte  \n« الحقيقة في 90 دقيقة » et الحقي fin\n12\nNERAUX\nARTICLE"
    out = one(spark, T.clean_french, text, None, "")
    assert "790" not in out[0]["text"] and " […texte non modifié…] " in out[0]["text"]
    assert "الحقيقة في 90 دقيقة" in out[0]["text"] and out[0]["removed"] == ["الحقي"]
    assert "NERAUX" not in out[0]["text"] and "ARTICLE" in out[0]["text"] and "\n12\n" not in out[0]["text"]
    assert out[1]["text"] is None and out[2]["text"] == ""


def test_cleaning_is_idempotent(spark):
    text = "L’arrêté n° 5\r\n\r\nBULLETIN OFFICIEL\n42\ntexte ……… fin.\n"
    once = one(spark, lambda c: T.clean_french(c)["text"], text)
    assert one(spark, lambda c: T.clean_french(c)["text"], *once) == once


def test_arabic_cleaning(spark):
    out = one(spark, T.clean_arabic, "مالادة الأولى ٢٣ ، الئحة\nالجريدة الرسمية\n١٢", "22) 1447 أبريل (2026", None)
    assert out[0].startswith("المادة الاولى 23،") and "اللائحة" in out[0] and "الجريدة" not in out[0]
    assert out[1] == "1447 (22 ابريل 2026)" and out[2] is None


def test_small_functions(spark):
    assert one(spark, T.slug, "936-26", "n° 168-26", "1.60.063", None) == ["936_26", "168_26", "1_60_063", ""]
    assert one(spark, T.plain_key, "  Hélène   DUPONT", "É", None) == ["helene dupont", "e", None]
    assert one(spark, T.flat_entity, "loi n° 5\n sur l'eau790", "1234") == ["loi n° 5 sur l'eau", "1234"]
    assert one(spark, lambda c: T.shortened(c, 5), "abcdefgh", "abc", None) == ["abcde…", "abc", None]
    words = "La conformté du Decret, dispostions ; arrêts, publies, DECRET, decret, offcie, Cahier"
    assert one(spark, T.pdf_words, words, "rien", None, "") == ["La conformité du Décret, dispositions ; arrêts, publies, Décret, décret, Office, cahier", "rien", None, ""]
    assert one(spark, T.nfc, "é", "é") == ["é", "é"]


@pytest.mark.parametrize(
    "text,lang",
    [("bonjour", "fr"), ("مرحبا بكم", "ar"), ("", "unknown"), (None, "unknown"), ("123 - 45", "unknown"), ("abcdef مرحب", "mixed")],
)
def test_language(spark, text, lang):
    assert one(spark, language.detected, text)[0]["language"] == lang


def test_lines_by_language(spark):
    rows = spark.createDataFrame([("d", "bonjour\nمرحبا\n12\nfin")], "k string, t string")
    assert {r["language"]: r["text"] for r in language.split_lines(rows, "k", "t").collect()} == {"fr": "bonjour\nfin", "ar": "مرحبا", "unknown": "12"}
