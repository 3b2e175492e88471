"""Queries over a gazette put together from orders and their lines, whose truth follows from these by SQL.

Each order is an issue, French or Arabic by its key: a line with number and date, a decree, and an article for each line of the order;
after the third article a second decree starts, whose articles count anew. An article cites an article of a law and has a date of both
calendars and a ministry. What the operators must find in the texts is stated over the tables, not over the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import citations, instruments, layout, quality, segment, spans, store, tables
from quirework.sources import files
from quirework.sources.tables import cut, table

MONTHS_FR = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
MONTHS_AR = ["يناير", "فبراير", "مارس", "أبريل", "ماي", "يونيو", "يوليوز", "غشت", "شتنبر", "أكتوبر", "نونبر", "دجنبر"]
HIJRI = [("moharrem", "محرم", 1), ("safar", "صفر", 2), ("rejeb", "رجب", 7), ("chaabane", "شعبان", 8), ("ramadan", "رمضان", 9), ("chaoual", "شوال", 10)]


def _one_of(value: str, names: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


def _day(d: str, m: str, y: str, names: list[str]) -> str:
    return f"CAST({d} AS STRING) || ' ' || ({_one_of(f'{m} - 1', names)}) || ' ' || CAST({y} AS STRING)"


#: SQL that both engines read. o: issues; li: lines in order, with the number k in the issue, the decree and the number in it; x: their texts;
#: pieces: all parts of the issues in order.
TEXTS = f"""
    o AS (SELECT o_orderkey AS ok, CAST(o_orderkey AS STRING) AS doc_id, o_orderkey % 2 = 1 AS ar, 1000 + o_custkey % 9000 AS bo, o_custkey AS cust,
                 extract(DAY FROM o_orderdate) AS od, extract(MONTH FROM o_orderdate) AS om, extract(YEAR FROM o_orderdate) AS oy FROM {{orders}}),
    lr AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS k FROM {{lineitem}}),
    li AS (SELECT o.*, k, CASE WHEN k > 3 THEN 2 ELSE 1 END AS dec, CASE WHEN k > 3 THEN k - 3 ELSE k END AS no, CAST(l_quantity AS INT) AS q, l_partkey AS part, l_partkey % 90 + 1 AS cited,
                  CAST(l_suppkey % 90 + 10 AS STRING) AS law, CAST(l_partkey % 80 + 10 AS STRING) AS law_year, extract(DAY FROM l_shipdate) AS d, extract(MONTH FROM l_shipdate) AS m,
                  extract(YEAR FROM l_shipdate) AS y, l_suppkey % 28 + 1 AS hd, l_partkey % 6 AS hm, 1400 + l_partkey % 40 AS hy, count(*) OVER (PARTITION BY o.ok) AS n
           FROM lr JOIN o ON l_orderkey = o.ok),
    x AS (SELECT *, CASE WHEN ar THEN 'المادة ' || CAST(no AS STRING) || ' -' WHEN no = 1 THEN 'Article premier. -' ELSE 'Article ' || CAST(no AS STRING) || '. -' END AS head,
                 CASE WHEN ar THEN 'مادة ' ELSE 'article ' END || CAST(cited AS STRING) AS cite0,
                 CASE WHEN ar THEN {_day("d", "m", "y", MONTHS_AR)} ELSE {_day("d", "m", "y", MONTHS_FR)} END AS day,
                 CAST(hd AS STRING) || ' ' || CASE WHEN ar THEN {_one_of("hm", [h[1] for h in HIJRI])} ELSE {_one_of("hm", [h[0] for h in HIJRI])} END || ' ' || CAST(hy AS STRING) AS hijri
          FROM li),
    b AS (SELECT *, CASE WHEN ar THEN 'تخضع كمية ' || CAST(q AS STRING) || ' وحدة وفقا لل' || cite0 || ' من القانون رقم ' || law || '.' || law_year || ' لمراقبة وزارة الصيد، ابتداء من ' || day || '، الموافق ' || hijri || '.'
                 ELSE 'La quantité de ' || CAST(q AS STRING) || ' unités relève de l''' || cite0 || ' de la loi n° ' || law || '-' || law_year || ', sous le contrôle du ministère de la pêche, à compter du ' || day || ' (' || hijri || ').'
                      || CASE WHEN k = 3 THEN ' Le présent texte sera publié au Bulletin officiel.' ELSE '' END END AS body FROM x),
    dn AS (SELECT o.*, 1 AS dec, cust AS num FROM o UNION ALL SELECT o.*, 2 AS dec, part AS num FROM o JOIN (SELECT ok, part FROM li WHERE k = 4) f ON f.ok = o.ok),
    dt AS (SELECT *, CASE WHEN ar THEN 'مرسوم رقم 2.' || CAST(oy % 90 + 10 AS STRING) || '.' || CAST(num % 9000 + 100 AS STRING) || ' بتحديد شروط نقل البضائع عن طريق البحر وتفريغها'
                     ELSE 'Décret n° 2-' || CAST(oy % 90 + 10 AS STRING) || '-' || CAST(num % 9000 + 100 AS STRING) || ' fixant les conditions de transport des marchandises par voie maritime' END AS title FROM dn),
    de AS (SELECT *, title || CASE WHEN ar THEN '\\nإن السلطة المختصة بناء على الاقتراح المقدم إليها\\nترسم ما يلي :' ELSE '\\nL''autorité compétente, sur la proposition qui lui est faite,\\nDÉCRÈTE :' END AS decree FROM dt),
    pieces AS (
        SELECT doc_id, ar, 0 AS ord, CASE WHEN ar THEN 'النشرة العامة عدد ' || CAST(bo AS STRING) || ' بتاريخ ' || {_day("od", "om", "oy", MONTHS_AR)} ELSE 'Édition générale n° ' || CAST(bo AS STRING) || ' du ' || {_day("od", "om", "oy", MONTHS_FR)} END AS piece FROM o
        UNION ALL SELECT doc_id, ar, CASE dec WHEN 1 THEN 1 ELSE 7 END, decree FROM de
        UNION ALL SELECT doc_id, ar, 2 * k, head || ' ' || body FROM b)
"""
#: DuckDB: articles as they must come out. In Arabic the second decree stays with the article before it, in French it is the preamble of the next.
TRUTH = (
    TEXTS.replace("{lineitem}", "lineitem").replace("{orders}", "orders").replace("'\\n", "E'\\n")
    + """,
    placed AS (SELECT doc_id, ord, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - length(piece) - 1 AS start FROM pieces),
    a AS (SELECT b.doc_id, b.ar, b.ok, k - 1 AS article_idx, b.k, b.no, b.dec, b.n, b.body, head, CASE WHEN b.ar OR no <> 1 THEN CAST(no AS VARCHAR) ELSE 'premier' END AS number, start,
                 CASE WHEN b.ar AND k = 3 AND n > 3 THEN body || E'\\n' || two.decree ELSE body END AS text, CASE WHEN NOT b.ar AND k = 4 THEN two.decree END AS preamble,
                 cite0, law, law_year, day, hijri, d, m, y, hd, hm, hy, two.title AS title2, two.num AS num2, b.oy
          FROM b JOIN placed ON placed.doc_id = b.doc_id AND ord = 2 * k LEFT JOIN de two ON two.doc_id = b.doc_id AND two.dec = 2)
"""
)


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, lang, text) of the gazette."""
    parts = spark.sql(f"WITH {TEXTS} SELECT doc_id, ar, ord, piece FROM pieces", lineitem=table(spark, folder, "lineitem"), orders=table(spark, folder, "orders"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "\n")
    return parts.groupBy("doc_id").agg(F.when(F.first("ar"), "ar").otherwise("fr").alias("lang"), joined.alias("text"))


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return segment.articles(issues(spark, folder))


def gz_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of the gazette with number, header, place, text and preamble."""
    return _articles(spark, folder).select("doc_id", "article_idx", "number", "raw_header", "start_pos", F.md5("text").alias("text"), F.md5("preamble").alias("preamble"))


def gz_decrees(spark: SparkSession, folder: str) -> DataFrame:
    """Decrees of the gazette with title and first article."""
    own = cut(issues(spark, folder))
    return segment.decrees(own, segment.articles(own)).select("doc_id", "decree_idx", "title", F.md5("preamble").alias("preamble"), "first_article_idx")


def gz_fore_matter(spark: SparkSession, folder: str) -> DataFrame:
    """What stands before the first article."""
    return issues(spark, folder).select("doc_id", segment.fore_matter(F.col("text"), F.col("lang")).alias("f")).select("doc_id", F.md5("f.preamble").alias("preamble"), F.col("f.contents").alias("contents"))


def gz_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Number, date and edition of each issue."""
    return files.first_metadata(issues(spark, folder).withColumn("file_rank", F.lit(1)))


def gz_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of the articles in both calendars."""
    own = _articles(spark, folder).select("doc_id", "article_idx", F.explode(spans.find_dates(F.col("text"), F.col("lang"))).alias("s"))
    meta = [F.col("s.meta")[c].cast("int").alias(c) for c in ("day", "month", "year")]
    return own.select("doc_id", "article_idx", F.col("s.label").alias("label"), F.col("s.text").alias("text"), F.col("s.start").alias("start_pos"), F.col("s.end_pos").alias("end_pos"), *meta)


def gz_legal_entities(spark: SparkSession, folder: str) -> DataFrame:
    """References, dates and ministries of the articles without overlaps."""
    own = _articles(spark, folder).select("doc_id", "article_idx", F.explode(spans.find_legal_entities(F.col("text"), F.col("lang"))).alias("s"))
    return own.select("doc_id", "article_idx", F.col("s.label").alias("label"), F.col("s.text").alias("text"), F.col("s.start").alias("start_pos"))


def gz_institutions(spark: SparkSession, folder: str) -> DataFrame:
    """Arabic institutions of the articles."""
    own = _articles(spark, folder).select("doc_id", "article_idx", F.explode(spans.find_institutions(F.col("text"), F.col("lang"))).alias("s"))
    return own.select("doc_id", "article_idx", F.col("s.label").alias("label"), F.col("s.text").alias("text"), F.col("s.start").alias("start_pos"))


def gz_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of the articles and the texts they cite."""
    own = _articles(spark, folder).withColumn("citations", spans.find_citations(F.col("text"), F.col("lang"))).withColumn("references", spans.find_references(F.col("text"), F.col("lang")))
    return citations.resolve(own, ["doc_id", "article_idx"])


def gz_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The citation graph of the gazette."""
    return citations.edges(cut(gz_citations(spark, folder)))


def _instruments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = cut(instruments.by_resets(_articles(spark, folder)))
    return rows, cut(instruments.identifiers(instruments.instruments(rows)))


def gz_instruments(spark: SparkSession, folder: str) -> DataFrame:
    """Instruments of the gazette by counts that start anew."""
    return _instruments(spark, folder)[1].select("doc_id", "instrument_no", "instrument_id", "instrument_type", "reference", "n_articles", "first_article_idx")


def gz_article_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of the gazette with the identifiers of article and instrument."""
    return instruments.article_identifiers(*_instruments(spark, folder)).select("doc_id", "article_idx", "article_id", "instrument_id")


def gz_decree_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Articles by the decree they stand under, after decrees that go on with the one before are merged."""
    own = cut(issues(spark, folder))
    rows = cut(segment.articles(own))
    found = segment.decrees(own, rows).withColumn("instrument_type", instruments.instrument_type(F.col("preamble"), F.lit(None).cast("string"))).withColumn("reference", instruments.reference(F.col("preamble")))
    merged = instruments.merged_decrees(cut(found))
    heads = merged.select("doc_id", "decree_idx", "head_idx", "first_article_idx")
    held = citations.decree_of_articles(rows.select("doc_id", "article_idx"), heads).join(heads.drop("first_article_idx"), ["doc_id", "decree_idx"])
    groups = held.groupBy("doc_id", "head_idx").agg(F.count("*").alias("articles"), F.min("article_idx").alias("first_article_idx"))
    return groups.join(merged.select("doc_id", F.col("decree_idx").alias("head_idx"), "instrument_type", "reference"), ["doc_id", "head_idx"])


def gz_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that the gazette breaks when pages, headers and numbers of articles are wrong on some issues."""
    rows, own = _instruments(spark, folder)
    key = F.col("doc_id").cast("bigint")
    page = F.when((key % 5 == 0) & (F.col("article_idx") == 1), F.lit(90)).when((key % 7 == 0) & (F.col("article_idx") == 0), F.lit(0)).otherwise(F.col("article_idx") + 1)
    full = instruments.article_identifiers(rows, own).withColumn("pdf_page", page.cast("int")).join(rows.select("doc_id", "article_idx", F.col("raw_header").alias("h")), ["doc_id", "article_idx"]).withColumn("raw_header", F.when(key % 11 != 0, F.col("h")))
    documents = rows.groupBy("doc_id").agg(F.first("lang").alias("lang"), F.count("*").alias("n")).select("doc_id", "lang", (F.col("n") + F.when(key % 3 == 0, 1).otherwise(0)).alias("n_articles"), F.lit(80).alias("total_pdf_pages"))
    rules = quality.schema_rules(documents, full, own).unionByName(quality.instrument_rules(own)).unionByName(quality.page_rules(full))
    return rules.groupBy("rule", "doc_id").agg(F.count("*").alias("broken"))


def gz_clean(spark: SparkSession, folder: str) -> DataFrame:
    """French issues cleaned of running titles, page numbers, contents lines and blank lines put between their parts."""
    parts = spark.sql(f"WITH {TEXTS} SELECT doc_id, ar, ord, piece FROM pieces", lineitem=table(spark, folder, "lineitem"), orders=table(spark, folder, "orders")).where("NOT ar")
    noise = F.concat(F.lit("\r\nBULLETIN OFFICIEL\r\n"), F.col("ord").cast("string"), F.lit("\r\n\r\nAnnexe au texte ......... "), F.col("ord").cast("string"), F.lit("  \n\n\n\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.replace("piece", F.lit("'"), F.lit("’")).alias("piece"), noise.alias("noise")))), lambda x: F.concat(x["piece"], x["noise"])), "")
    return parts.groupBy("doc_id").agg(joined.alias("text")).select("doc_id", F.md5(T.clean_french(F.col("text"))["text"]).alias("text"))


def gz_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that show in the lines of an order by wide gaps."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).alias("r"))
    row = F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat_ws("     ", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), F.concat(F.lit("a|"), r["q"].cast("string"))))
    pages = lines.groupBy("l_orderkey").agg(F.concat(F.lit("Etat des quantités\n"), F.array_join(row, "\n"), F.lit("\nFin de l'état")).alias("text"))
    return tables.ascii_tables(pages, "l_orderkey", "text")


def gz_reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Reading of pages in two columns, from the left in Latin and from the right in Arabic script."""
    lines = spark.sql(f"WITH {TEXTS} SELECT doc_id, ar, k FROM li", lineitem=table(spark, folder, "lineitem"), orders=table(spark, folder, "orders"))
    x0, y0 = F.when(F.col("k") % 2 == 1, 0.0).otherwise(60.0), F.floor((F.col("k") - 1) / 2) * 20.0
    word = F.when(F.col("ar"), "نص").otherwise("texte")
    blocks = lines.select("doc_id", F.lit(1).alias("page_number"), x0.alias("x0"), y0.alias("y0"), (x0 + 40.0).alias("x1"), (y0 + 10.0).alias("y1"), word.alias("text"), F.col("k").alias("block_idx"))
    return layout.in_reading_order(blocks)


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("l_suppkey") % 500).cast("double").alias("x0"), (F.col("l_partkey") % 300).cast("double").alias("y0"),
        (F.col("l_suppkey") % 500 + F.col("l_quantity")).cast("double").alias("x1"), (F.col("l_partkey") % 300 + 10).cast("double").alias("y1"), (F.col("l_discount") * 10).alias("confidence"),
    )


def gz_scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of scanned boxes, one for each line of an order."""
    return layout.scan_lines(_boxes(spark, folder))


#: SQL that both engines read: for each order a ministry by name and a sentence with it.
NAMED = f"""
    f AS (SELECT CAST(o_orderkey AS STRING) AS doc_id, CAST(o_custkey AS STRING) AS cust, {_one_of("o_orderkey % 2", ["fr", "ar"])} AS lang,
                 CASE WHEN o_orderkey % 2 = 1 THEN {_one_of(f"o_orderkey % {len(spans.MINISTRIES['ar'])}", spans.MINISTRIES["ar"])}
                      ELSE {_one_of(f"o_orderkey % {len(spans.MINISTRIES['fr'])}", [p.replace("'", "''") for p in spans.MINISTRIES["fr"]])} END AS name FROM {{orders}}),
    s AS (SELECT *, CASE lang WHEN 'ar' THEN 'قدم الملف رقم ' || cust || ' إلى ' || name || '، ولم يرفض.' ELSE 'Le dossier ' || cust || ' est remis au ' || upper(substring(name, 1, 1)) || substring(name, 2) || ', sans suite.' END AS text FROM f)
"""


def gz_ministries(spark: SparkSession, folder: str) -> DataFrame:
    """Ministries known by name, the longest where one begins another."""
    own = spark.sql(f"WITH {NAMED} SELECT doc_id, lang, text FROM s", orders=table(spark, folder, "orders"))
    found = own.select("doc_id", F.explode(spans.find_ministries(F.col("text"), F.col("lang"))).alias("s"))
    return found.select("doc_id", F.col("s.label").alias("label"), F.lower("s.text").alias("text"), F.col("s.start").alias("start_pos"))


def gz_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of the store and of the gazette with the same fields."""
    own = store.normalised_articles(table(spark, folder, "articles").select("doc_id", "number", "raw_text"))
    side = store.normalised_articles(_articles(spark, folder))
    return own.unionByName(side).select("doc_id", "article_id", "article_number", "lang", F.md5("text").alias("text"))


def gz_resolved_again(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of articles whose laws are known from the decree alone, resolved at a second try."""
    own = _articles(spark, folder).withColumn("citations", spans.find_citations(F.col("text"), F.col("lang"))).withColumn("known", spans.find_references(F.col("text"), F.col("lang")))
    bare = cut(own.select("doc_id", "article_idx", "lang", "text", "citations", "known"))
    none = F.filter("known", lambda s: F.lit(False))
    first = cut(citations.resolve(bare.withColumn("references", none), ["doc_id", "article_idx"]))
    lost = F.transform("known", lambda s: s.withField("start", F.lit(-1)).withField("end_pos", F.lit(-1)))
    return citations.resolve_again(first, bare.withColumn("references", lost), ["doc_id", "article_idx"]).select("doc_id", "article_idx", "text", "target_label", "target_text")


def gz_redistributed(spark: SparkSession, folder: str) -> DataFrame:
    """Dates found in the articles of an issue put in one, given back to their articles."""
    own = _articles(spark, folder).groupBy("doc_id").agg(F.first("lang").alias("lang"), F.transform(F.array_sort(F.collect_list(F.struct("article_idx", "text"))), lambda x: x["text"]).alias("texts"))
    mark = "\n<ARTICLE_BOUNDARY>\n"
    found = own.withColumn("spans", spans.find_dates(spans.joined_texts(F.col("texts"), mark)["text"], F.col("lang")))
    back = found.select("doc_id", F.posexplode(spans.redistributed(F.col("spans"), F.col("texts"), mark)).alias("article_idx", "spans"))
    return back.select("doc_id", "article_idx", F.explode("spans").alias("s")).select("doc_id", "article_idx", F.col("s.text").alias("text"), F.col("s.start").alias("start_pos"))


QUERIES = {f.__name__: f for f in (
    gz_articles, gz_decrees, gz_fore_matter, gz_metadata, gz_dates, gz_legal_entities, gz_institutions, gz_citations, gz_edges, gz_instruments, gz_article_ids, gz_decree_groups, gz_quality, gz_clean, gz_tables,
    gz_reading_order, gz_scan_lines, gz_ministries, gz_normalised, gz_resolved_again, gz_redistributed,
)}

#: The second decree of an Arabic issue stands in its third article.
WITHIN = "ar AND k = 3 AND n > 3"
REFERENCE2 = "'2.' || (oy % 90 + 10) || '.' || (num2 % 9000 + 100)"
DATES = f"""
    g AS (SELECT doc_id, article_idx, 'DATE_GREGORIAN' AS label, day AS text, instr(body, day) - 1 AS start_pos, d::INT AS day, m::INT AS month, y::INT AS year FROM a
          UNION ALL SELECT doc_id, article_idx, 'DATE_HIJRI', hijri, length(body) - length(hijri) - CASE WHEN ar THEN 1 WHEN k = 3 THEN 2 + length(' Le présent texte sera publié au Bulletin officiel.') ELSE 2 END, hd::INT,
                           CASE hm {' '.join(f'WHEN {k} THEN {h[2]}' for k, h in enumerate(HIJRI))} END, hy::INT FROM a)
"""
CITED = """
    c AS (SELECT doc_id, article_idx, CASE WHEN ar THEN 'لل' ELSE 'l''' END || cite0 AS text, instr(body, cite0) - 3 AS s, CASE WHEN ar THEN 'قانون رقم ' || law || '.' || law_year ELSE 'loi n° ' || law || '-' || law_year END AS target_text, ar FROM a)
"""
RESETS = "i AS (SELECT *, CASE WHEN ar OR dec = 1 THEN 1 ELSE 2 END AS ino, 'fr' AS f FROM a)"
SQL = {
    "gz_articles": f"WITH {TRUTH} SELECT doc_id, article_idx, number, head AS raw_header, start::INT AS start_pos, md5(text) AS text, md5(preamble) AS preamble FROM a",
    "gz_decrees": f"""
        WITH {TRUTH} SELECT de.doc_id, (dec - 1)::INT AS decree_idx, title, md5(decree) AS preamble, CASE dec WHEN 1 THEN 0 ELSE 3 END::INT AS first_article_idx FROM de WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = de.doc_id)
    """,
    "gz_fore_matter": f"""
        WITH {TRUTH} SELECT doc_id, md5(string_agg(piece, E'\\n' ORDER BY ord)) AS preamble, '' AS contents FROM pieces WHERE ord <= 1 GROUP BY 1
    """,
    "gz_metadata": f"""
        WITH {TRUTH} SELECT doc_id, bo::VARCHAR AS bo_number, strftime(make_date(oy, om, od), '%Y-%m-%d') AS date_publication, CASE WHEN ar THEN 'النشرة العامة' ELSE 'Édition générale' END AS edition_label FROM o
    """,
    "gz_dates": f"WITH {TRUTH}, {DATES} SELECT doc_id, article_idx, label, text, start_pos::INT AS start_pos, (start_pos + length(text))::INT AS end_pos, day, month, year FROM g",
    "gz_legal_entities": f"""
        WITH {TRUTH}, {DATES}, {CITED}
        SELECT doc_id, article_idx, label, text, start_pos::INT AS start_pos FROM g
        UNION ALL SELECT doc_id, article_idx, 'LOI', target_text, instr((SELECT body FROM a WHERE a.doc_id = c.doc_id AND a.article_idx = c.article_idx), target_text) - 1 FROM c
        UNION ALL SELECT doc_id, article_idx, 'MINISTERE', CASE WHEN ar THEN 'وزارة الصيد' ELSE 'ministère de la pêche' END, instr(body, CASE WHEN ar THEN 'وزارة' ELSE 'ministère' END) - 1 FROM a
        UNION ALL SELECT doc_id, article_idx, 'DECRET', 'مرسوم رقم ' || {REFERENCE2}, length(body) + 1 FROM a WHERE {WITHIN}
    """,
    "gz_institutions": f"WITH {TRUTH} SELECT doc_id, article_idx, 'INSTITUTION' AS label, 'وزارة الصيد' AS text, (instr(body, 'وزارة') - 1)::INT AS start_pos FROM a WHERE ar",
    "gz_citations": f"""
        WITH {TRUTH}, {CITED} SELECT doc_id, article_idx, 0 AS citation_no, text, s::INT AS start, (s + length(text))::INT AS end_pos, 'LOI' AS target_label, target_text, true AS resolved, 'explicit' AS resolution_type FROM c
    """,
    "gz_edges": f"WITH {TRUTH}, {CITED} SELECT doc_id, 'LOI' AS target_label, target_text, count(*) AS citations, count(*) AS resolved FROM c GROUP BY 1, 3",
    "gz_instruments": f"""
        WITH {TRUTH}, {RESETS},
             r AS (SELECT doc_id, ino, count(*) AS n_articles, min(article_idx) AS f, CASE WHEN ino = 2 THEN '2-' || any_value(oy % 90 + 10) || '-' || any_value(num2 % 9000 + 100) END AS reference FROM i GROUP BY 1, 2)
        SELECT doc_id, ino::BIGINT AS instrument_no, CASE WHEN reference IS NULL THEN 'instr_' || ino ELSE 'instr_' || replace(reference, '-', '_') END AS instrument_id, 'DECRET' AS instrument_type, reference, n_articles, f AS first_article_idx FROM r
    """,
    "gz_article_ids": f"""
        WITH {TRUTH}, {RESETS}, r AS (SELECT *, CASE WHEN ino = 2 THEN '2_' || (oy % 90 + 10) || '_' || (num2 % 9000 + 100) ELSE '1' END AS stem FROM i)
        SELECT doc_id, article_idx, 'art_' || stem || '_' || row_number() OVER (PARTITION BY doc_id, ino ORDER BY article_idx) AS article_id, 'instr_' || stem AS instrument_id FROM r
    """,
    "gz_decree_groups": f"""
        WITH {TRUTH}, e AS (SELECT doc_id, dec, min(k) - 1 AS f, count(*) AS articles FROM a GROUP BY 1, 2)
        SELECT doc_id, (dec - 1)::INT AS head_idx, articles, f::INT AS first_article_idx, 'DECRET' AS instrument_type, CASE WHEN ar THEN '2.' || (oy % 90 + 10) || '.' || (num % 9000 + 100) ELSE '2-' || (oy % 90 + 10) || '-' || (num % 9000 + 100) END AS reference
        FROM e JOIN de USING (doc_id, dec)
    """,
    "gz_quality": f"""
        WITH {TRUTH},
             p AS (SELECT doc_id, ok, article_idx, number, n, CASE WHEN ok % 5 = 0 AND article_idx = 1 THEN 90 WHEN ok % 7 = 0 AND article_idx = 0 THEN 0 ELSE article_idx + 1 END AS page FROM a),
             q AS (SELECT *, max(page) OVER (PARTITION BY doc_id ORDER BY article_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p WHERE regexp_full_match(number, '[0-9]+')),
             w AS (SELECT 'article_count' AS rule, doc_id FROM (SELECT DISTINCT doc_id, ok FROM p) WHERE ok % 3 = 0 UNION ALL SELECT 'article_field', doc_id FROM p WHERE ok % 11 = 0
                   UNION ALL SELECT 'page_bound', doc_id FROM p WHERE page > 80 UNION ALL SELECT 'page_positive', doc_id FROM p WHERE page < 1 UNION ALL SELECT 'page_order', doc_id FROM q WHERE page < before)
        SELECT rule, doc_id, count(*) AS broken FROM w GROUP BY 1, 2
    """,
    "gz_clean": f"WITH {TRUTH} SELECT doc_id, md5(string_agg(piece, E'\\n' ORDER BY ord)) AS text FROM pieces WHERE NOT ar GROUP BY 1",
    "gz_reading_order": f"""
        WITH {TRUTH}, c AS (SELECT *, CASE WHEN n < 4 THEN 0 WHEN (k % 2 = 0) = ar THEN 0 ELSE 1 END AS side FROM li)
        SELECT doc_id, 1 AS page_number, k AS block_idx, (row_number() OVER (PARTITION BY doc_id ORDER BY side, (k - 1) // 2, k) - 1)::INT AS position FROM c
    """,
    "gz_scan_lines": """
        WITH b AS (SELECT l_orderkey::VARCHAR AS doc_id, l_suppkey % 500 AS x0, l_partkey % 300 AS y0, l_suppkey % 500 + l_quantity AS x1 FROM lineitem WHERE l_discount * 10 >= 0.3),
             g AS (SELECT *, coalesce(y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY y0) > 25, true) AS new FROM b),
             l AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY y0) - 1 AS line_no FROM g)
        SELECT doc_id, 1 AS page_number, line_no::INT AS line_no, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, (max(y0) + 10)::DOUBLE AS y1, count(*) AS boxes FROM l GROUP BY 1, 3
    """,
    "gz_ministries": f"""
        WITH {NAMED.replace("{orders}", "orders")} SELECT doc_id, 'MINISTERE' AS label, name AS text, CASE lang WHEN 'ar' THEN length('قدم الملف رقم ' || cust || ' إلى ') ELSE length('Le dossier ' || cust || ' est remis au ') END::INT AS start_pos FROM s
    """,
    "gz_normalised": f"""
        WITH {TRUTH} SELECT doc_id, number AS article_id, number AS article_number, CASE WHEN ar THEN 'ar' ELSE 'fr' END AS lang, md5(text) AS text FROM a
        UNION ALL SELECT coalesce(doc_id, ''), coalesce(number, ''), coalesce(number, ''), 'fr', md5(coalesce(raw_text, '')) FROM articles
    """,
    "gz_resolved_again": f"WITH {TRUTH}, {CITED} SELECT doc_id, article_idx, text, 'LOI' AS target_label, target_text FROM c",
    "gz_redistributed": f"WITH {TRUTH}, {DATES} SELECT doc_id, article_idx, text, start_pos::INT AS start_pos FROM g",
    "gz_tables": """
        WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS k, '| ' || l_linenumber || ' | ' || l_partkey || ' | a\\|' || l_quantity::INT || ' |' AS r FROM lineitem)
        SELECT l_orderkey, 1 AS first_line, count(*) AS lines, string_agg(CASE WHEN k = 1 THEN r || chr(10) || '| --- | --- | --- |' ELSE r END, chr(10) ORDER BY k) AS markdown FROM l GROUP BY 1 HAVING count(*) > 1
    """,
}
