from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.functions import language
from quirework.functions import text as T
from quirework.operators import answers, citations, classify, layout, segment, store, tables, vectors
from quirework.sources import backends, files


def test_blocks(spark):
    rows = [("d", 1, 0.0, 5.0, 10.0, 7.0, "en-tête", 100.0), ("d", 1, 0.0, 50.0, 10.0, 60.0, " corps ", 100.0), ("d", 1, 0.0, 96.0, 10.0, 99.0, "pied", 100.0), ("d", 1, 0.0, 40.0, 10.0, 45.0, "  ", 100.0)]
    b = spark.createDataFrame(rows, "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double, text string, page_height double")
    assert [r["text"] for r in layout.body_blocks(b).collect()] == ["corps"]
    boxes = spark.createDataFrame([("d", 1, 0.0, 45.0, 10.0, 55.0)], "doc_id string, page_number int, bx0 double, by0 double, bx1 double, by1 double")
    assert [r["text"].strip() for r in layout.outside_tables(b, boxes).orderBy("y0").collect()] == ["en-tête", "", "pied"]
    line = spark.createDataFrame([([("a", 0.0), ("c", 2.0), ("b", 1.0)],), (None,)], "l array<struct<c:string,x0:double>>")
    assert [r[0] for r in line.select(layout.reading_line("l")).collect()] == ["abc", None]
    s = spark.createDataFrame([("ar", 400.0, 300.0), (None, 2000.0, 100.0)], "l string, w double, h double").select(layout.ocr_settings(F.col("l"), F.col("w"), F.col("h"))).collect()
    assert (s[0][0]["dpi"], s[0][0]["engine"], s[1][0]["dpi"], s[1][0]["engine"]) == (400, "ara", 200, "fra+ara")


def test_gutter(spark):
    words = [("d", 1, 10.0 + i % 5 * 30, 10.0 + i % 5 * 30, 90.0, 1000.0) for i in range(5)] + [("d", 1, 320.0 + 5 * i, 320.0 + 5 * i, 90.0, 1000.0) for i in range(12)] + [("d", 1, 500.0 + 5 * i, 500.0 + 5 * i, 90.0, 1000.0) for i in range(12)]
    w = spark.createDataFrame(words, "doc_id string, page_number int, x0 double, x1 double, confidence double, page_width double")
    assert layout.gutter(w).first()["gutter"] == pytest.approx((375 + 500) / 2)
    assert layout.gutter(w.limit(5)).first()["gutter"] is None


def test_table_cells(spark):
    t = spark.createDataFrame([("d", 1, [1.0], [[" a ", None]], 0), ("d", 1, [1.0], [[" a ", None]], 1), ("d", 2, [1.0], [[" a ", None]], 2)], "doc_id string, page_number int, bbox array<double>, rows array<array<string>>, at int")
    assert t.select(tables.normal_cells(F.col("rows"))).first()[0] == [["a", ""]]
    assert sorted(r["at"] for r in tables.distinct_tables(t, "at").collect()) == [0, 2]
    assert t.select(files.pipe_table(F.col("rows"))).first()[0] == "| a |  |\n| --- | --- |"
    assert "page_number" in t.select(files.tables_json(F.array(F.struct("page_number", "rows")))).first()[0]


def test_language_plugs(spark):
    rows = spark.createDataFrame([("/x/fr/a.txt", "مرحبا"), ("/x/doc.txt", "مرحبا"), ("BO_7500_Ar.pdf", "a")], "p string, t string")
    assert [r[0] for r in rows.select(language.path_language(F.col("p"), F.col("t"))).collect()] == ["fr", "ar", "ar"]
    model = lambda t: F.when(t == "a", F.struct(F.lit("en").alias("language"), F.lit(0.9).alias("confidence"), F.lit("model").alias("method")))
    assert [r[0]["language"] for r in rows.select(language.with_model(F.col("t"), model)).collect()] == ["ar", "ar", "en"]
    assert rows.select(language.with_model(F.col("t"))).first()[0]["language"] == "ar"


def test_document_domain(spark):
    rows = spark.createDataFrame([("a", "fr", "l'impôt"), ("a", "fr", "travail travail"), ("b", "fr", None)], "doc_id string, lang string, text string")
    assert {r["doc_id"]: r["domain"] for r in classify.document_domain(rows).collect()} == {"a": "Social", "b": "Indéterminé"}


def test_segment_labels(spark):
    rows = spark.createDataFrame([("Annexe 2\nx",), ("autre",)], "t string")
    assert [r[0] for r in rows.select(segment.annex_label(F.col("t"))).collect()] == ["Annexe 2", "(annexe)"]
    text = spark.createDataFrame([("Intro\nARTICLE PREMIER. a\nART. 2. b",)], "t string")
    assert text.select(segment.labelled_pieces(F.col("t"))).first()[0] == ["Intro", "ARTICLE PREMIER. a", "ART. 2. b"]


def test_decree_targets(spark):
    c = spark.createDataFrame([("d", 0, "DOCUMENT_SOURCE", "d"), ("d", 0, "LOI", "loi 5"), ("d", None, "DOCUMENT_SOURCE", "d")], "doc_id string, decree_idx int, target_label string, target_text string")
    t = spark.createDataFrame([("d", 0, "DECRET", "décret n° 2")], "doc_id string, decree_idx int, label string, text string")
    assert sorted(r["target_text"] for r in citations.with_decree_targets(c, t).collect()) == ["d", "décret n° 2", "loi 5"]


def test_conversation(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(10)] + [(2, 0, "system", "x"), (3, 0, "user", None)], "conv_id int, turn int, role string, text string")
    assert sorted(r["turn"] for r in answers.history_tail(turns.where("conv_id = 1")).collect()) == list(range(2, 10))
    made = answers.standalone(turns, F.lit("q"), lambda h, q: F.concat(q, F.lit(" / "), F.split(h, "\n")[0])).collect()
    assert [(r["conv_id"], r["query"]) for r in made] == [(1, "q / user: t2")]
    assert answers.standalone(turns, F.lit("q")).first()["query"] == "q"
    arts = spark.createDataFrame([("1", "Le registre", 0), ("2", "rien", 1)], "number string, text string, article_idx int")
    ents = spark.createDataFrame([("LOI",), ("LOI",)], "label string")
    assert answers.rule_answer(arts, ents, "article 2").first()["value"] == "rien"
    assert answers.rule_answer(arts, ents, "Combien d'entités ?").first()["value"] == "2"
    assert answers.rule_answer(arts, ents, "liste").count() == 2 and answers.rule_answer(arts, ents, "REGISTRE").first()["key"] == "1"


def test_store_reads(spark):
    docs = spark.createDataFrame([("a", "fr", "1", "2020"), ("b", "ar", "2", None)], "doc_id string, lang string, bo_number string, date_publication string")
    arts = spark.createDataFrame([(1, "a", "1"), (2, "b", "1")], "id bigint, doc_id string, number string")
    cites = spark.createDataFrame([(1, 1, "x", "LOI", "loi 5", True), (2, 2, "y", "LOI", "loi 5", False)], "id bigint, article_id bigint, text string, target_label string, target_text string, resolved boolean")
    assert [r["doc_id"] for r in store.documents_by_date(docs).collect()] == ["b", "a"] and store.document(docs, "a").count() == 1
    assert [r["doc_id"] for r in store.citations_to(cites, arts, "loi 5").collect()] == ["a"]
    index = spark.createDataFrame([("a", "persons", "x"), ("a", "organizations", "y")], "doc_id string, category string, canonical string")
    assert store.index_of(index, "a").count() == 2 and store.index_of(index, "a", "persons").count() == 1
    none = store.consolidation(spark.createDataFrame([], "article_id bigint"), cites.select("article_id", "resolved"), arts)
    assert {r["doc_id"]: (r["entities"], r["citations"], r["resolved"]) for r in none.collect()} == {"a": (0, 1, 1), "b": (0, 1, 0)}


def test_oversampled_search(spark):
    index = spark.createDataFrame([(i, [1.0, i / 100], i % 10) for i in range(40)], "vec_id bigint, embedding array<float>, label int")
    assert [r["vec_id"] for r in vectors.nearest(index.where("label = 3"), [0.0, 1.0], 2).collect()] == [33, 23]
    assert [r["vec_id"] for r in vectors.nearest_oversampled(index, [0.0, 1.0], F.col("label") == 3, 2).collect()] == [33]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "fr", "x"), ("b", "ar", "y")], "doc_id string, lang string, text string")
    files.write_texts(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("lang = 'ar'").count() == 1
    files.write_issues(rows, str(tmp_path / "j"))
    assert files.issues(spark, str(tmp_path / "j")).count() == 2
    files.write_store(rows, str(tmp_path / "s"))
    files.write_store(rows.where("doc_id = 'a'").withColumn("text", F.lit("z")), str(tmp_path / "s"))
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", "z"), ("b", "y")]
    files.write_index(rows, str(tmp_path / "i"), "hash")
    assert spark.read.parquet(str(tmp_path / "i")).first()["model"] == "hash"
    files.write_training(rows, str(tmp_path / "c"))
    assert files.csv_rows(spark, str(tmp_path / "c")).columns == ["doc_id", "lang", "text"]
    stamped = files.stamped(rows.withColumn("sha256", F.lit("h"))).first()
    assert (stamped["extractor_version"], stamped["pdf_sha256"]) == ("5", "h") and stamped["generated_at"] is not None


def test_backends():
    assert backends.no_names("x") == []
    with pytest.raises(ConnectionError):
        backends.with_retries(lambda s, u: (_ for _ in ()).throw(ConnectionError()), sleep=lambda s: None)("s", "u")
    if not __import__("importlib.util").util.find_spec("fitz"):
        with pytest.raises(NotImplementedError):
            backends.pdf_reader()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, lang string, text string")
    assert segment.articles(empty).count() == 0 and segment.decrees(empty, segment.articles(empty)).count() == 0
    assert T.let(F.lit(1), lambda x: x + 1) is not None


def test_dictionary_files(spark, tmp_path):
    from quirework.sources import files

    rows = [
        '{"label": "M", "pattern": [{"LOWER": {"IN": ["ministère", "ministre"]}}, {"LOWER": "de"}, {"LOWER": "l\'"}, {"LOWER": "eau"}]}', '{"text": "وزارة الماء", "label": "M"}',
        '{"text": "وزارة الماء", "label": "M"}', '{"label": "S", "pattern": "secrétariat"}', "", '{"label": "X"}',
    ]
    (tmp_path / "d.jsonl").write_text("\n".join(rows), encoding="utf8")
    found = {tuple(r) for r in files.dictionary(spark, str(tmp_path / "d.jsonl")).collect()}
    assert found == {("M", "ministère de l'eau"), ("M", "ministre de l'eau"), ("M", "وزارة الماء"), ("S", "secrétariat")}


def test_known_ministries(spark):
    from pyspark.sql import functions as F

    from quirework.operators import spans

    texts = [("Le MINISTÈRE  de l’Intérieur et le ministre de la santé.", "fr"), ("وزارة الداخلية والجماعات الترابية ووزارة", "ar"), ("", "fr"), (None, "ar"), ("administère de la justicex", "fr")]
    out = spark.createDataFrame(texts, "t string, g string").select(spans.find_ministries(F.col("t"), F.col("g")).alias("s")).collect()
    assert [[x["text"] for x in r["s"]] for r in out] == [["MINISTÈRE  de l’Intérieur", "ministre de la santé"], ["وزارة الداخلية والجماعات الترابية"], [], [], []]


def test_scan_lines(spark):
    from quirework.operators import layout

    boxes = [("d", 1, 50.0, 0.0, 90.0, 10.0, 0.9), ("d", 1, 0.0, 20.0, 40.0, 30.0, 0.9), ("d", 1, 0.0, 44.0, 40.0, 56.0, 0.5), ("d", 1, 5.0, 100.0, 40.0, 110.0, 0.9), ("d", 1, 0.0, 70.0, 1.0, 80.0, 0.1), ("e", 1, 0.0, 0.0, 1.0, 1.0, None)]
    out = layout.scan_lines(spark.createDataFrame(boxes, "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double, confidence double")).orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in out] == [(0, 0.0, 0.0, 90.0, 56.0, 3), (1, 5.0, 100.0, 40.0, 110.0, 1)]


def test_redistributed(spark):
    from pyspark.sql import functions as F

    from quirework.operators import spans

    texts = ["le 3 mars 2020", None, "", "fin le 4 mai 2021"]
    frame = spark.createDataFrame([(texts,), ([],), (None,)], "t array<string>").withColumn("j", spans.joined_texts(F.col("t"), "\n#\n"))
    rows = frame.withColumn("d", spans.find_dates(F.col("j.text"), F.lit("fr"))).withColumn("s", spans.redistributed(F.col("d"), F.col("t"), "\n#\n")).collect()
    assert [[(x["text"], x["start"], x["end_pos"]) for x in own] for own in rows[0]["s"]] == [[("3 mars 2020", 3, 14)], [], [], [("4 mai 2021", 7, 17)]]
    assert rows[0]["j"]["starts"] == [0, 17, 20, 23] and rows[1]["s"] == [] and rows[2]["s"] is None


def test_normalised_articles(spark):
    from quirework.operators import store

    of_store = spark.createDataFrame([("d", "3", "texte", "ar"), ("d", None, "", None)], "doc_id string, number string, raw_text string, lang string")
    of_issue = spark.createDataFrame([("d", "art_1", "3", "corps", 7)], "doc_id string, article_id string, number string, text string, pdf_page int")
    assert [tuple(r) for r in store.normalised_articles(of_store).collect()] == [("3", "d", "3", "ar", "", "", "", "", "texte", None, None), ("", "d", "", "fr", "", "", "", "", "", None, None)]
    assert [tuple(r) for r in store.normalised_articles(of_issue).collect()] == [("art_1", "d", "3", "fr", "", "", "", "", "corps", 7, None)]


def test_rule_answers(spark):
    from quirework.operators.answers import rule_answer

    arts = spark.createDataFrame([("1", "un registre", 0), ("2", "deux", 1)], "number string, text string, article_idx int")
    ents = spark.createDataFrame([("LOI",), ("LOI",)], "label string")
    instr = spark.createDataFrame([("DECRET", "2-1-3", 2)], "instrument_type string, reference string, n_articles int")
    docs = spark.createDataFrame([("d", "6822", "2019-10-17")], "doc_id string, bo_number string, date_publication string")
    ask = lambda q: [tuple(r) for r in rule_answer(arts, ents, q, instr, docs).collect()]
    assert ask("Combien d'articles ?") == [("count", "articles", "2")] and ask("Nombre d'instruments ?") == [("count", "DECRET 2-1-3", "1")]
    assert ask("Combien d'entités ?") == [("count", "LOI", "2")] and ask("BO numéro ?") == [("number", "6822", "2019-10-17")] and ask("Date ?") == [("date", "d", "2019-10-17")]
    assert ask("Liste des instruments") == [("list", "DECRET 2-1-3", "2")] and ask("Article 2") == [("article", "2", "deux")] and ask("registre") == [("search", "1", "un registre")]


def test_resolve_again(spark):
    from pyspark.sql import functions as F

    from quirework.operators import citations, spans

    rows = spark.createDataFrame([("d", 0, "fr", "Vu l'article 3 et le texte 15-09 ;"), ("d", 1, "fr", "Vu l'article 4 ;")], "doc_id string, article_idx int, lang string, text string")
    rows = rows.withColumn("citations", spans.find_citations(F.col("text"), F.col("lang"))).withColumn("references", F.array().cast(spans.SPANS))
    first = citations.resolve(rows, ["doc_id", "article_idx"])
    law = F.array(F.struct(F.lit("LOI").alias("label"), F.lit("loi n° 15-09").alias("text"), F.lit(-1).alias("start"), F.lit(-1).alias("end_pos"), F.lit(None).cast("map<string,string>").alias("meta")))
    again = citations.resolve_again(first, rows.withColumn("references", F.when(F.col("article_idx") == 0, law).otherwise(F.col("references"))), ["doc_id", "article_idx"])
    assert sorted((r["article_idx"], r["target_label"], r["target_text"]) for r in again.collect()) == [(0, "LOI", "loi n° 15-09"), (1, "DOCUMENT_SOURCE", "d")]
