from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quirework.operators import answers, citations, classify, instruments, layout, pages, quality, segment, store, tables, vectors
from quirework.sources import backends, files

ISSUE = """SOMMAIRE
Décret ...... 12
""" + "x" * 520 + """
TEXTES GENERAUX
Décret n° 2-15-22 du 3 mars 2020 relatif à la pêche et aux ports, pris pour l'application de la loi sur les ports du pays.
Vu la loi n° 31-58 ;
DÉCRÈTE :
ARTICLE PREMIER. – Le présent décret fixe les conditions de la pêche dans les ports. Voir l'article 5 de la loi.
ART. 2. – Le ministre est chargé de l'exécution du présent décret.
Arrêté n° 408-26 du ministre de la pêche du 3 mars 2021 portant sur les filets, les mailles et les saisons de la pêche côtière.
Vu le
décret n° 2-15-22 ;
ARRÊTE :
ARTICLE PREMIER. – Les filets sont contrôlés par les agents.
ART. 2. – suite"""


def test_segmentation(spark):
    issues = spark.createDataFrame([("d1", "fr", ISSUE), ("d2", "fr", ""), ("d3", "ar", "المادة 1 : نص أول كاف للاختبار هنا وهو طويل جدا.\nالمادة الثانية نص ثان كاف للاختبار هنا وهو طويل جدا."), ("d4", "fr", None)], "doc_id string, lang string, text string")
    rows = [r.asDict() for r in segment.articles(issues).orderBy("doc_id", "article_idx").collect()]
    assert [(r["doc_id"], r["number"]) for r in rows] == [("d1", "PREMIER"), ("d1", "2"), ("d1", "PREMIER"), ("d3", "1"), ("d3", "الثانية")]
    assert rows[0]["preamble"] is None and rows[2]["preamble"] is None and "ART. 2. – suite" in rows[2]["text"]  # a merge loses the preamble
    for r in rows[:2]:
        assert ISSUE[r["start_pos"] :].startswith(r["raw_header"])
    found = segment.decrees(issues, segment.articles(issues)).orderBy("decree_idx").collect()
    assert [(r["title"][:6], r["first_article_idx"]) for r in found] == [("Décret", 0), ("Arrêté", 2)]
    fore = issues.where("doc_id = 'd1'").select(segment.fore_matter(F.col("text"), F.col("lang")).alias("f")).first()["f"]
    assert fore["contents"].startswith("SOMMAIRE") and "ARTICLE" not in fore["preamble"] and "Vu la loi" in fore["preamble"]


def test_unknown_language_is_an_error(spark):
    with pytest.raises(Exception, match="unsupported language"):
        segment.articles(spark.createDataFrame([("d", "xx", "t")], "doc_id string, lang string, text string")).collect()


def test_truncated_pairs(spark):
    texts = ["Le texte", "continue ici", "encore une", "fois ainsi", "Fin du texte."]
    rows = spark.createDataFrame([("d", "fr", i, str(i), "h", t, i, None) for i, t in enumerate(texts)], segment.ARTICLES)
    assert [r["text"] for r in segment.merge_truncated(rows).orderBy("article_idx").collect()] == ["Le texte\ncontinue ici", "encore une\nfois ainsi", "Fin du texte."]


def test_oversized():
    assert segment.oversized("a" * 10, 20) == ["a" * 10]
    headed = "x" * 30 + "\nChapitre 1 : " + "y" * 30 + "\nSection 2 : " + "z" * 30
    assert len(segment.oversized(headed, 50)) == 3
    plain = "Une phrase. " * 20
    assert "".join(segment.oversized(plain, 100, 40)).replace(" ", "") == plain.replace(" ", "")


def _resets(spark, texts):
    numbers = ["PREMIER", "2", "3", "PREMIER", "2"]
    return spark.createDataFrame([("d", i, n, t, None) for i, (n, t) in enumerate(zip(numbers, texts, strict=True))], "doc_id string, article_idx int, number string, text string, preamble string")


def test_instruments(spark):
    rows = instruments.by_resets(_resets(spark, ["a", "b", "Arrêté n° 936-26 du 3 mars\nVu la loi\nARRÊTE :", "c", "d"]))
    own = instruments.identifiers(instruments.instruments(rows)).orderBy("instrument_no").collect()
    assert [(r["n_articles"], r["instrument_type"], r["instrument_id"]) for r in own] == [(3, "DECRET", "instr_1"), (2, "ARRETE", "instr_936_26")]
    assert instruments.by_resets(_resets(spark, ["a", "b", "c", "d", "e"])).agg(F.max("instrument_no")).first()[0] == 1


@pytest.mark.parametrize(
    "preamble,kind,number",
    [
        ("ظهير شريف رقم 1.26.12 صادر في 3 مارس", "DAHIR", "1.26.12"),
        ("مرسوم رقم 2.25.100", "DECRET", "2.25.100"),
        ("قرار مشترك لوزير رقم 943.26", "ARRETE_CONJOINT", "943.26"),
        ("قرار لوزير بناء على القانون رقم 12.06", "ARRETE", None),
        ("Décret n° 2-23-1143 du 3 mars\nVu le dahir n° 1-2-3", "DECRET", "2-23-1143"),
        ("Arrêté conjoint n° 12-20", "ARRETE_CONJOINT", "12-20"),
    ],
)
def test_kind_and_number(spark, preamble, kind, number):
    row = spark.createDataFrame([(preamble,)], "p string").select(instruments.instrument_type(F.col("p"), F.lit("")).alias("k"), instruments.reference(F.col("p")).alias("r")).first()
    assert (row["k"], row["r"]) == (kind, number)


def test_merged_decrees(spark):
    rows = [("d", 0, "DECRET", "2-15-22", "Décret"), ("d", 1, "ARRETE", "2-15-22", "Arrêté"), ("d", 2, "ARRETE", "5-20", "Arrêté"), ("d", 3, "ARRETE", None, "Arrêté"), ("d", 4, "ARRETE", "6-20", "Arrêté")]
    out = instruments.merged_decrees(spark.createDataFrame(rows, "doc_id string, decree_idx int, instrument_type string, reference string, preamble string"))
    assert [r["head_idx"] for r in out.orderBy("decree_idx").collect()] == [0, 0, 2, 2, 4]


SPAN = "struct<label:string,text:string,start:int,end_pos:int,meta:map<string,string>>"


def _span(label, text, start):
    return {"label": label, "text": text, "start": start, "end_pos": start + len(text), "meta": None}


def test_citations(spark):
    text = "l'article 5 de la loi n° 1-20 et l'article 6"
    c = [_span("C", "l'article 5", 0), _span("C", "l'article 6", 33)]
    rows = spark.createDataFrame(
        [(1, "d", "fr", text, c, [_span("LOI", "loi n° 1-20", 18), _span("DECRET", "x", 400)]), (2, "d", "fr", "l'article 7 du présent texte", [_span("C", "l'article 7", 0)], [])],
        f"id int, doc_id string, lang string, text string, citations array<{SPAN}>, references array<{SPAN}>",
    )
    out = citations.resolve(rows, ["id"]).orderBy("id", "citation_no").collect()
    assert [(r["target_label"], r["resolution_type"]) for r in out] == [("LOI", "explicit"), ("LOI", "explicit"), ("DOCUMENT_SOURCE", "anaphoric")]


def test_decree_of_articles(spark):
    arts = spark.createDataFrame([("d", i) for i in range(5)], "doc_id string, article_idx int")
    decs = spark.createDataFrame([("d", 0, 1), ("d", 1, 3)], "doc_id string, decree_idx int, first_article_idx int")
    assert [r["decree_idx"] for r in citations.decree_of_articles(arts, decs).orderBy("article_idx").collect()] == [None, 0, 0, 1, 1]


def test_passed_down(spark):
    own = spark.createDataFrame([("d", 0, "LOI", "Loi 5", 3, 8)], "doc_id string, article_idx int, label string, text string, start int, end_pos int")
    decree = spark.createDataFrame([("d", 0, "LOI", "loi 5"), ("d", 0, "DECRET", "décret 2")], "doc_id string, article_idx int, label string, text string")
    assert sorted((r["text"], r["start"]) for r in citations.passed_down(own, decree).collect()) == [("Loi 5", 3), ("décret 2", -1)]


def test_reading_order(spark):
    def page(*boxes):
        return layout.page_order([layout.Block(*b, k) for k, b in enumerate(boxes)])

    two = page((0, 0, 40, 10, "a"), (60, 0, 100, 10, "c"), (0, 20, 40, 30, "b"), (60, 20, 100, 30, "d"), (0, 200, 40, 210, "e"), (60, 200, 100, 210, "f"))
    assert [b.text for b in two] == ["a", "b", "e", "c", "d", "f"]
    arabic = page((0, 0, 40, 10, "ا"), (60, 0, 100, 10, "ب"), (0, 20, 40, 30, "ت"), (60, 20, 100, 30, "ث"))
    assert [b.text for b in arabic] == ["ب", "ث", "ا", "ت"]
    assert [b.text for b in page((0, 0, 90, 10, "long title of the page"), (0, 20, 40, 30, "x"))] == ["long title of the page", "x"]
    assert page() == []


def test_bidi():
    line = lambda s: layout.logical_line([(c, float(i)) for i, c in enumerate(s)])
    assert "943.26" in line("943.26 مقر رارق") and "قرار" in line("943.26 مقر رارق")
    assert line("abc def") == "abc def"
    assert "62.349" not in line("943.26 مقر رارق")
    assert line("voir ةقيقحلا ici") == "voir الحقيقة ici"


def test_pages(spark):
    words = lambda k: " ".join(chr(96 + k) * 2 + chr(97 + i) * 3 for i in range(26))
    arts = spark.createDataFrame([("d", 0, words(1)), ("d", 1, words(3)), ("d", 2, words(9)), ("d", 3, "")], "doc_id string, article_idx int, text string")
    side = spark.createDataFrame([("d", k, words(k)) for k in range(1, 5)], "doc_id string, page_number int, text string")
    assert [r["pdf_page"] for r in pages.article_pages(arts, side).orderBy("article_idx").collect()] == [1, 3, None, None]
    assert [r[0] for r in spark.createDataFrame([("texte\n 790 \n", 3), ("rien", 4)], "t string, p int").select(pages.printed_page(F.col("t"), F.col("p"))).collect()] == [790, 4]


def test_tables(spark):
    rows = [("d", "k1", 1, [["Nom", "Quantité totale"], ["a", "bcdefghijklmnop"]]), ("d", "k2", 9, [["xyz", "fin du tableau"]]), ("d", "k3", 9, [[" "]])]
    t = spark.createDataFrame(rows, "doc_id string, table_key string, page_number int, rows array<array<string>>")
    a = spark.createDataFrame([("d", 0, 1, "Nom Quantité totale a bcdefghijklmnop", "i1"), ("d", 1, 2, "xyz fin du tableau", "i2")], "doc_id string, article_idx int, pdf_page int, text string, instrument_id string")
    links = tables.linked(t, a)
    assert sorted((r["table_key"], r["article_idx"]) for r in links.collect()) == [("k1", 0), ("k2", 1)]
    assert [r["table_key"] for r in tables.unlinked(t, links).collect()] == ["k3"]
    assert tables.instrument_tables(links, a).count() == 2
    doc = spark.createDataFrame([(1, "titre\nA    B\n1    2\nfin\nseul    mot")], "k int, t string")
    out = tables.ascii_tables(doc, "k", "t").collect()
    assert len(out) == 1 and out[0]["markdown"] == "| A | B |\n| --- | --- |\n| 1 | 2 |"


def test_domains(spark):
    rows = spark.createDataFrame([("L'impôt et la taxe", "fr"), ("rien", "fr"), ("الضريبة على القيمة المضافة رسم", "ar"), ("بناء على القانون", "ar"), ("réseau nécessaire", "fr"), ("le fonds de commerce", "fr"), (None, "fr")], "t string, l string")
    assert [r[0] for r in rows.select(classify.classify(F.col("t"), F.col("l"))).collect()] == ["Fiscal", "Indéterminé", "Fiscal", "Indéterminé", "Indéterminé", "Commercial", "Indéterminé"]
    scores = rows.limit(1).select(classify.domain_scores(F.col("t"), F.col("l")).alias("s")).first()["s"]
    assert scores["Fiscal"] == 2 and sum(scores.values()) == 2
    with pytest.raises(Exception, match="unsupported language"):
        spark.createDataFrame([("a", "xx")], "t string, l string").select(classify.classify(F.col("t"), F.col("l"))).collect()


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "truth string, found string")
    out = {r["label"]: (r["precision"], r["recall"]) for r in classify.metrics(rows).collect()}
    assert out["a"] == (0.5, 0.5) and out["b"] == (0.5, 1.0) and out["c"] == (0.0, 0.0) and out[None][0] == 0.5


def test_vectors(spark):
    import random

    rng = random.Random(1)
    data = [(i, [rng.random() for _ in range(4)]) for i in range(50)] + [(50, None)]
    index = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    queries = index.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    out = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.search(index, queries, 4).collect()}
    for q in range(3):
        best = sorted(((-sum(x * y for x, y in zip(v, data[q][1], strict=True)), i) for i, v in data if v), key=lambda x: (round(x[0], 9), x[1]))[:4]
        assert [out[q, k + 1] for k in range(4)] == [i for _, i in best]
    embed = vectors.hash_embedding(16)
    row = spark.createDataFrame([("un texte", ""), ], "a string, b string").select(embed(F.col("a")).alias("x"), embed(F.col("b")).alias("y")).first()
    assert abs(sum(v * v for v in row["x"]) - 1) < 1e-9 and set(row["y"]) == {0.0}
    hits = spark.createDataFrame([(1, 0.82), (2, 0.818)], "vec_id int, score double")
    assert [r["vec_id"] for r in vectors.guarded(hits).collect()] == [1]


def test_store(spark):
    arts = spark.createDataFrame([(1, "d", "1"), (2, "d", "2")], "id bigint, doc_id string, number string")
    ents = spark.createDataFrame([(1, 1, "Mohamed Alami", "PERSON"), (2, 2, "MOHAMED ALAMI", "PERSON"), (3, 2, "Alami", "PERSON"), (4, 2, None, "PERSON"), (5, 1, "x", "LOI")], "id bigint, article_id bigint, text string, label string")
    out = store.entity_index(ents, arts).collect()
    assert len(out) == 1 and out[0]["canonical"] == "MOHAMED ALAMI" and out[0]["merged_from"] == ["Alami"] and out[0]["articles"] == ["1", "2"]


def test_context(spark):
    kinds = "query_id int, rank int, text string, doc_id string, number string, bo_number string, instrument_type string, reference string, pdf_page int, printed_page int, extracted_tables array<struct<n_rows:int,n_cols:int,rows:array<array<string>>>>"
    hits = spark.createDataFrame([(1, 1, "a" * 20000, "d", "5", "7500", "DECRET", "2-15", 3, 790, [{"n_rows": 2, "n_cols": 2, "rows": [["A", "B"]]}]), (1, 2, "b", None, None, None, None, None, None, None, None)], kinds)
    loose = spark.createDataFrame([("d", 4, [["x"]], i) for i in range(5)], "doc_id string, page_number int, rows array<array<string>>, table_idx int")
    out = answers.contexts(hits, loose).first()["context"]
    assert out.startswith("[Source 1], Bulletin Officiel n°7500, — d, , article 5,  (DECRET,  n°2-15, ), , pdf_page=3 (BO p.790)")
    assert "1 tableau(x) (2 lignes × 2 colonnes)" in out and "[Source 2], Bulletin Officiel n°?" in out and "et 2 tableau(x) supplémentaire(s)" in out and len(out) < 11100
    asked = spark.createDataFrame([(1, "q", "fr"), (2, "س", "ar")], "query_id int, question string, lang string")
    made = {r["query_id"]: r for r in answers.prompts(asked, answers.contexts(hits)).collect()}
    assert made[1]["canned"] is None and made[2]["canned"] == answers.NO_ANSWER["ar"]


def test_quality(spark):
    arts = spark.createDataFrame([("d", 0, "1", 3), ("d", 1, "2", 2), ("d", 2, "(annexe)", 1)], "doc_id string, article_idx int, number string, pdf_page int")
    assert [(r["rule"], r["key"]) for r in quality.page_rules(arts).collect()] == [("page_order", "1")]
    ins = spark.createDataFrame([("d", "i1", "DECRET"), ("d", "i1", "AUTRE")], "doc_id string, instrument_id string, instrument_type string")
    assert sorted(r["rule"] for r in quality.instrument_rules(ins).collect()) == ["instrument_id_repeats", "instrument_type"]


def test_ocr_threshold(spark):
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate([1000, 2000, 3000, 500, 299])], "doc_id string, page int, char_count int")
    assert [r["needs_ocr"] for r in layout.needs_ocr(rows).orderBy("page").collect()] == [False, False, False, False, True]


def test_files(spark, tmp_path):
    issue = {"doc_id": "d", "lang": "fr", "bo_number": "7500", "date_publication": "2020-03-03", "full_text": "", "articles": [{"number": "1", "text": "Vu la loi 5.", "instrument_id": "i", "entities": [{"label": "LOI", "text": "loi 5", "start": 6, "end": 11}] * 2}], "instruments": [{"instrument_id": "i", "instrument_type": "DECRET", "reference": "2-15"}]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps(issue, indent=1))
    rows = files.issues(spark, str(tmp_path / "a"))
    flat = files.flat_articles(rows).first()
    assert (flat["number"], flat["instrument_type"], flat["reference"]) == ("1", "DECRET", "2-15")
    assert files.issue_text(rows).first()["text"] == "Vu la loi 5."
    assert "- **LOI** : loi 5 (×2)" in files.issue_markdown(rows).first()["markdown"]
    assert "Vu la **loi 5**[LOI]." in files.issue_markdown(rows.withColumn("articles", F.transform("articles", lambda a: a.withField("entities", F.slice(a["entities"], 1, 1)))), audit=True).first()["markdown"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "p" / "y.pdf").write_bytes(b"no")
    pdfs = files.pdf_files(spark, str(tmp_path / "p"))
    assert [r["is_pdf"] for r in pdfs.orderBy("path").collect()] == [True, False]

    def backend(content):
        if content == b"no":
            raise ValueError("bad")
        return [{"text": "t"}]

    assert [(r["text"], r["error"]) for r in files.scanned_by(pdfs, backend, "text string").orderBy("path").collect()] == [("t", None), (None, "ValueError: bad")]
    (tmp_path / "t.csv").write_text("﻿id,text\n1,\"a\nb\"\n", encoding="utf-8")
    assert files.csv_rows(spark, str(tmp_path / "t.csv")).columns == ["id", "text"]
    seen = spark.createDataFrame([("a", "5", "h"), ("b", "4", "h"), ("c", None, None), ("d", "5", "h"), ("e", "5", "h")], "path string, extractor_version string, pdf_sha256 string")
    sources = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "z")], "path string, sha256 string")
    assert {r["path"]: r["reason"] for r in files.freshness(seen, sources).collect()} == {"a": "fresh", "b": "stale version", "c": "no provenance", "d": "source changed", "e": "source missing"}


def test_metadata(spark):
    rows = spark.createDataFrame([("BULLETIN OFFICIEL Nº 7500 – 28 chaoual 1447 (16 avril 2026) Édition générale",), ("عدد 7515 بتاريخ 31 فبراير 2025 النشرة العامة",), ("",)], "t string")
    out = [r[0] for r in rows.select(files.metadata(F.col("t"))).collect()]
    assert (out[0]["bo_number"], out[0]["date_publication"]) == ("7500", "2026-04-16") and (out[1]["bo_number"], out[1]["date_publication"]) == ("7515", None) and out[2]["bo_number"] is None


def test_routing(spark):
    rows = spark.createDataFrame([("a", "pleine_page", "long texte", "ا", ""), ("b", "colonnes", "x", "ا", "?")], "doc_id string, layout string, text_fr string, text_ar string, text_unknown string")
    assert sorted((r["doc_id"], r["lang"]) for r in files.routed_texts(rows).collect()) == [("a", "fr"), ("b", "ar"), ("b", "fr"), ("b", "unknown")]


def test_retries():
    calls = []

    def call(system, user):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert backends.with_retries(call, sleep=lambda s: None)("s", "u") == "ok"
    assert backends.quoting("s", "ctx\n\nQuestion : q") == "ctx"


def test_stream(spark, tmp_path):
    from quirework import streaming
    from quirework.functions import language

    spark.createDataFrame([(1, "bonjour"), (2, "مرحبا")], "id int, text string").write.parquet(str(tmp_path / "in"))
    query = streaming.run(streaming.arriving(spark, str(tmp_path / "in"), "id int, text string"), lambda d: d.select("id", language.routed(F.col("text")).alias("lang")), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(60)
    assert {r["id"]: r["lang"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "fr", 2: "ar"}


def test_enrich(spark):
    from quirework.operators import enrich

    text = "Vu la loi n° 1-20 et l'article 5, M. Jean Dupont et la Banque Centrale du 3 mars 2020. La loi n° 1-20."
    rows = spark.createDataFrame([(1, "fr", text), (2, "fr", None), (3, "fr", "")], "id int, lang string, text string")

    @F.pandas_udf(enrich.S.SPANS)
    def recognise(texts, langs):
        import pandas as pd

        at = lambda t, w, label: (label, w, t.index(w), t.index(w) + len(w), None)
        return pd.Series([[] if not t else [at(t, "Jean Dupont", "PERSON"), at(t, "Banque Centrale", "ORG"), at(t, "loi n° 1-20", "ORG")] for t in texts])

    out = {r["id"]: r for r in enrich.enrich(rows, lambda t, g: recognise(t, g)).collect()}
    assert [s["text"] for s in out[1]["entities"]] == ["loi n° 1-20", "3 mars 2020"]
    assert [s["text"] for s in out[1]["persons"]] == ["Jean Dupont"] and [s["text"] for s in out[1]["organizations"]] == ["Banque Centrale"]
    assert len(out[1]["citations"]) == 1 and len(out[1]["dates"]) == 1 and out[2]["entities"] == [] and out[3]["persons"] == []
