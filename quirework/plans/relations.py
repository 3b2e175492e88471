"""Queries over the store: reads, joins, counts, the entity index, citations and instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import language
from quirework.operators import citations, enrich, instruments, spans, store
from quirework.sources.tables import cut, spread, table


def documents_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Issues by date, those without one first, with their place."""
    own = table(spark, folder, "bulletins").select("doc_id", "date_publication", "lang")
    return store.documents_by_date(own)


def entities_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Laws named in articles."""
    own = store.entities_by_label(table(spark, folder, "entities"), table(spark, folder, "articles"), "LOI")
    return own.select("id", "article_id", "doc_id", "number", "text")


def articles_join_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with the number, language and date of their issue."""
    own = store.articles_with_documents(table(spark, folder, "articles"), table(spark, folder, "bulletins"))
    return own.select("id", "doc_id", "number", "bo_number", "date_publication")


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by label."""
    return store.label_counts(table(spark, folder, "entities"))


def document_entity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Articles and entities of each issue."""
    articles = table(spark, folder, "articles")
    none = spark.createDataFrame([], "article_id bigint, resolved boolean")
    return store.consolidation(table(spark, folder, "entities"), none, articles).select("doc_id", "articles", "entities")


def grouped_entities(spark: SparkSession, folder: str) -> DataFrame:
    """How often each text of a label occurs in an article."""
    own = table(spark, folder, "entities").select("article_id", "label", "text", F.col("id").alias("pos"))
    return store.grouped_counts(own, ["article_id"])


def entity_index(spark: SparkSession, folder: str) -> DataFrame:
    """Persons, organisations and institutions of each issue under one spelling."""
    own = store.entity_index(table(spark, folder, "entities"), table(spark, folder, "articles"))
    return own.select("doc_id", "category", "canonical", F.array_join("variants", "\x1f").alias("variants"), F.array_join("articles", "\x1f").alias("articles"), F.array_join("merged_from", "\x1f").alias("merged_from"))


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    own = spread(table(spark, folder, "articles").where("raw_text IS NOT NULL AND doc_id IS NOT NULL").select("id", "doc_id", "raw_text")).select("id", "doc_id", language.routed(F.col("raw_text")).alias("lang"), F.col("raw_text").alias("text"))
    found = own.withColumn("citations", spans.find_citations(F.col("text"), F.col("lang"))).where(F.size("citations") > 0)
    return found.withColumn("references", spans.find_references(F.col("text"), F.col("lang")))


def citations_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Each citation of an article with the text it cites."""
    return citations.resolve(_cited(spark, folder), ["id"])


def citation_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The citation graph of the issues."""
    rows = cut(citations.resolve(_cited(spark, folder), ["id"]))
    return citations.edges(rows.join(table(spark, folder, "articles").select("id", "doc_id"), "id"))


def citations_to_law(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of the law that articles name most, with document and number."""
    rows = cut(citations.resolve(_cited(spark, folder), ["id"]).withColumnRenamed("id", "article_id"))
    most = rows.where("target_label = 'LOI'").groupBy("target_text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_text").limit(1)
    own = rows.join(F.broadcast(most.select("target_text")), "target_text")  # one row
    side = table(spark, folder, "articles").select(F.col("id").alias("article_id"), "doc_id", "number")
    return own.where("resolved").join(side, "article_id").select("article_id", "doc_id", "number", "text", "target_text")


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "articles").where("doc_id IS NOT NULL")
    return own.select("doc_id", "id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1).alias("article_idx"), F.coalesce("number", F.lit("")).alias("number"), F.coalesce("raw_text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("preamble"))


def reset_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with the ordinal of their instrument, by counts that start anew after an enacting or closing clause."""
    return instruments.by_resets(_numbered(spark, folder)).select("doc_id", "id", "instrument_no")


def issue_instruments(spark: SparkSession, folder: str) -> DataFrame:
    """Instruments of the issues with kind, number and identifier."""
    return instruments.identifiers(instruments.instruments(instruments.by_resets(_numbered(spark, folder)))).select("doc_id", "instrument_id", "instrument_type", "reference", "n_articles")


def article_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with the identifiers of article and instrument."""
    rows = cut(instruments.by_resets(_numbered(spark, folder)))
    own = instruments.identifiers(instruments.instruments(rows))
    return instruments.article_identifiers(rows, own).select("doc_id", "id", "article_id", "instrument_id", "instrument_type", "reference")


def instrument_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Kind and number read off the titles of the instruments."""
    own = table(spark, folder, "instruments")
    kind = instruments.instrument_type(F.upper("title_fr"), F.lit(None).cast("string"))
    return own.select("reference", kind.alias("kind"), instruments.reference(F.col("title_fr")).alias("number_fr"), instruments.reference(F.regexp_replace("title_ar", "^ال", "")).alias("number_ar"))


def decree_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with the last one at or before them that has a preamble."""
    own = table(spark, folder, "segments").select("doc_id", "article_idx", "seg_id")
    starts = table(spark, folder, "segments").where("preamble IS NOT NULL").select("doc_id", F.col("article_idx").alias("first_article_idx"), F.col("article_idx").alias("decree_idx"))
    return citations.decree_of_articles(own, starts).select("seg_id", "decree_idx")


def history_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The last two detector runs of each page."""
    from quirework.operators.answers import history_tail as tail

    own = table(spark, folder, "language_results").select(F.col("page_id").alias("conv_id"), F.col("result_id").alias("turn"), "language")
    return tail(own, 2)


def enriched_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of entities, dates, citations, persons and organisations of each article."""
    own = spread(table(spark, folder, "articles").where("raw_text IS NOT NULL").select("id", "raw_text"))
    rows = enrich.enrich(own.select("id", language.routed(F.col("raw_text")).alias("lang"), F.col("raw_text").alias("text")))
    return rows.select("id", *[F.size(c).alias(c) for c in ("entities", "dates", "citations", "persons", "organizations")])


def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """The first five segments that name the register."""
    from quirework.operators.answers import keyword_hits

    own = table(spark, folder, "segments").select("seg_id", "text", F.col("seg_id").alias("article_idx"))
    return keyword_hits(own, "registre").select("seg_id", F.length("text").alias("characters"))


def issue_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The rule answer to a question for numbers of entities."""
    from quirework.operators.answers import rule_answer

    own = table(spark, folder, "articles").select("number", F.col("raw_text").alias("text"), F.col("id").alias("article_idx"))
    return rule_answer(own, table(spark, folder, "entities"), "Combien d'entités ?")


def issue_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Number, date and edition read off the first page of each issue."""
    from quirework.sources.files import first_metadata

    pages = table(spark, folder, "extracted_pages").where("text IS NOT NULL").select("doc_id", F.when(F.col("doc_id").startswith("ar"), "ar").otherwise("fr").alias("lang"), F.col("page_number").alias("file_rank"), "text")
    return first_metadata(pages)


def issue_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each issue as Markdown."""
    from quirework.sources import files

    span = lambda: F.struct("label", "text", F.coalesce("start_pos", F.lit(-1)).alias("start"), F.coalesce("end_pos", F.lit(-1)).alias("end"))
    ents = table(spark, folder, "entities").where("text IS NOT NULL").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("id", span().alias("s")))).alias("e"))
    arts = table(spark, folder, "articles").where("doc_id IS NOT NULL").join(ents, F.col("id") == F.col("article_id"), "left")
    one = F.struct("number", F.col("raw_text").alias("text"), F.transform(F.coalesce("e", F.array().cast(f"array<struct<id:bigint,s:{files.SPAN}>>")), lambda x: x["s"]).alias("entities"), F.array().cast("array<string>").alias("citations"))
    issues = arts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("a")))), lambda x: x["a"]).alias("articles"))
    full = issues.join(table(spark, folder, "bulletins").select("doc_id", "bo_number", "date_publication"), "doc_id")
    return files.issue_markdown(full).select("doc_id", F.length("markdown").alias("characters"))


QUERIES = {f.__name__: f for f in (
    documents_ordered, entities_by_label, articles_join_documents, label_counts, document_entity_counts, grouped_entities, entity_index, citations_resolved, citation_edges, citations_to_law,
    reset_sessions, issue_instruments, article_ids, instrument_reference, decree_asof, history_tail, enriched_articles, keyword_search, issue_answer, issue_metadata, issue_markdown,
)}
SQL = {
    "documents_ordered": "SELECT doc_id, date_publication, lang FROM bulletins",
    "entities_by_label": "SELECT e.id, article_id, doc_id, number, text FROM entities e JOIN articles a ON a.id = article_id WHERE label = 'LOI'",
    "articles_join_documents": "SELECT id, doc_id, number, bo_number, date_publication FROM articles JOIN bulletins USING (doc_id)",
    "label_counts": "SELECT label, count(*) AS n FROM entities GROUP BY 1",
    "document_entity_counts": """
        SELECT doc_id, count(DISTINCT a.id) AS articles, count(e.id) AS entities FROM articles a LEFT JOIN entities e ON e.article_id = a.id GROUP BY 1
    """,
    "grouped_entities": "SELECT article_id, label, text, count(*) AS n, min(id) AS first FROM entities GROUP BY ALL",
    "reset_sessions": r"""
        WITH n AS (SELECT doc_id, id, row_number() OVER w AS k, upper(trim(coalesce(number, ''))) AS no, coalesce(lag(coalesce(raw_text, '')) OVER w, '') AS before
                   FROM articles WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY id)),
             r AS (SELECT *, (no IN ('1', '1ER', 'UNIQUE', 'PREMIÈRE') OR starts_with(no, 'PREMIER')) AND k > 1 AND (
                   regexp_matches(before, '(?i)(?:DÉCR[EÈ]TE|ARR[EÊ]TE|D[ÉE]CIDE|ORDONNE|DISPOSENT|STATUENT)\s*[:\-–]|SONT\s+ABROG[ÉE]ES?')
                   OR regexp_matches(before, '(?i)charg[ée]\s+(?:de\s+l[''’])?ex[ée]cution\s+du\s+pr[ée]sent|publi[ée]\s+au\s+Bulletin\s+officiel|Fait\s+[àa]\s+Rabat|Le\s+(?:Chef\s+du\s+)?(?:Gouvernement|Ministre|Pr[ée]sident)|AZIZ\s+AKHANNOUCH|MOHAMMED\s+[A-Z]+|Notifi[ée]\s+aux\s+int[ée]ress[ée]s')) AS new FROM n)
        SELECT doc_id, id, (1 + sum(new::INT) OVER (PARTITION BY doc_id ORDER BY id))::BIGINT AS instrument_no FROM r
    """,
    "instrument_reference": "SELECT reference, CASE instrument_type WHEN 'ARRETE' THEN 'ARRETE' WHEN 'DECRET' THEN 'DECRET' WHEN 'DAHIR' THEN 'DAHIR' ELSE 'DECRET' END AS kind, reference AS number_fr, replace(reference, '-', '.') AS number_ar FROM instruments",
    "decree_asof": """
        SELECT seg_id, last_value(CASE WHEN preamble IS NOT NULL THEN article_idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY article_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS decree_idx
        FROM segments
    """,
    "keyword_search": "SELECT seg_id, length(text)::INT AS characters FROM segments WHERE contains(lower(text), 'registre') ORDER BY seg_id LIMIT 5",
    "issue_answer": "SELECT 'count' AS kind, label AS key, count(*)::VARCHAR AS value FROM entities GROUP BY label",
    "history_tail": """
        SELECT page_id AS conv_id, result_id AS turn, language FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY result_id DESC) AS k FROM language_results) WHERE k <= 2
    """,
}
