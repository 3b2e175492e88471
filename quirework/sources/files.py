"""Files in and out: texts, annotated issues, tables, PDF files, training rows, Markdown.

A row that can't be read keeps its place with an error; a folder is one job, whatever its number of files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import replaced, table_cell

SPAN = "struct<label:string,text:string,start:int,end:int>"
TABLE = "struct<page_number:int,bbox:array<double>,n_rows:int,n_cols:int,rows:array<array<string>>>"
ISSUE = (
    "doc_id string, source string, lang string, bo_number string, date_publication string, edition_label string, preamble_text string, sommaire string, full_text string, "
    f"possible_embedded_arabic array<string>, n_articles int, total_pdf_pages int, preamble_entities array<{SPAN}>, "
    f"decrees array<struct<title:string,preamble:string,first_article_idx:int,entities:array<{SPAN}>>>, "
    f"articles array<struct<number:string,raw_header:string,text:string,preamble:string,entities:array<{SPAN}>,dates:array<{SPAN}>,"
    "citations:array<struct<text:string,target_label:string,target_text:string,resolved:boolean>>,"
    f"persons:array<{SPAN}>,organizations:array<{SPAN}>,pdf_page:int,printed_page:int,article_id:string,instrument_id:string,extracted_tables:array<{TABLE}>>>, "
    "instruments array<struct<instrument_id:string,instrument_type:string,reference:string,n_articles:int,article_indices:array<int>,article_ids:array<string>>>, "
    f"unlinked_tables array<{TABLE}>"
)
EXTRACTOR_VERSION = "5"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, each whole."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def issues(spark: SparkSession, path: str) -> DataFrame:
    """Annotated issues from JSON files, one each."""
    return spark.read.schema(ISSUE).json(path, multiLine=True, recursiveFileLookup=True)


def flat_articles(issues_: DataFrame) -> DataFrame:
    """One row an article, with the fields of its issue and the kind and number of its instrument."""
    rows = issues_.select("doc_id", "lang", "bo_number", "date_publication", "instruments", F.posexplode("articles").alias("article_idx", "a"))
    kind = F.filter("instruments", lambda i: i["instrument_id"] == F.col("a.instrument_id"))
    found = rows.withColumn("i", F.get(kind, F.lit(0)))
    return found.select("doc_id", "lang", "bo_number", "date_publication", "article_idx", "a.*", F.col("i.instrument_type").alias("instrument_type"), F.col("i.reference").alias("reference"))


def issue_text(issues_: DataFrame) -> DataFrame:
    """(doc_id, text): the whole text, else the joined texts of the articles."""
    joined = F.array_join(F.transform("articles", lambda a: F.coalesce(a["text"], F.lit(""))), "\n")
    return issues_.select("doc_id", F.coalesce(F.when(F.col("full_text") != "", F.col("full_text")), joined).alias("text"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header that may start with a byte order mark."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256, is_pdf) of PDF files in a folder and below."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return rows.select("path", "content", F.sha2("content", 256).alias("sha256"), is_pdf(F.col("content")).alias("is_pdf"))


def is_pdf(content: Column) -> Column:
    """Whether bytes start as a PDF file does."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def scanned_by(files: DataFrame, backend: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows of a backend for each file's content: path, the columns of schema, error. A file that fails is a row with its error."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [{"path": path, **dict.fromkeys(names), **r, "error": None} for r in backend(content)]
                except Exception as e:
                    out.append({"path": path, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def freshness(interim: DataFrame, sources: DataFrame, version: str = EXTRACTOR_VERSION, bypass: bool = False) -> DataFrame:
    """(path, fresh, reason) of interim texts (path, extractor_version, pdf_sha256; null without provenance) by their sources (path,
    sha256)."""
    joined = interim.join(sources.select("path", "sha256"), "path", "left")
    reason = (
        F.when(F.lit(bypass), "bypassed").when(F.col("extractor_version").isNull(), "no provenance").when(F.col("extractor_version") != version, "stale version")
        .when(F.col("sha256").isNull(), "source missing").when(F.col("sha256") != F.col("pdf_sha256"), "source changed").otherwise("fresh")
    )
    return joined.select("path", reason.isin("fresh", "bypassed").alias("fresh"), reason.alias("reason"))


def stamped(rows: DataFrame, version: str = EXTRACTOR_VERSION) -> DataFrame:
    """Interim texts with the digest of their source, the version and the time."""
    return rows.withColumn("extractor_version", F.lit(version)).withColumn("pdf_sha256", F.col("sha256")).withColumn("generated_at", F.current_timestamp())


def routed_texts(results: DataFrame) -> DataFrame:
    """(doc_id, lang, text): both languages of pages in columns, else the longer; what is in no language by itself.

    results: doc_id, layout, text_fr, text_ar, text_unknown."""
    fr, ar = F.length(F.coalesce("text_fr", F.lit(""))), F.length(F.coalesce("text_ar", F.lit("")))
    two = F.col("layout") == "colonnes"
    parts = F.array(
        F.when((fr > 0) & (two | (fr >= ar)), F.struct(F.lit("fr").alias("lang"), F.col("text_fr").alias("text"))),
        F.when((ar > 0) & (two | (ar > fr)), F.struct(F.lit("ar").alias("lang"), F.col("text_ar").alias("text"))),
        F.when(F.length(F.coalesce("text_unknown", F.lit(""))) > 0, F.struct(F.lit("unknown").alias("lang"), F.col("text_unknown").alias("text"))),
    )
    return results.select("doc_id", F.explode(F.array_compact(parts)).alias("p")).select("doc_id", "p.*")


def write_texts(rows: DataFrame, path: str) -> None:
    """Texts by language."""
    rows.write.mode("overwrite").partitionBy("lang").parquet(path)


def write_issues(rows: DataFrame, path: str) -> None:
    """Issues as JSON; a folder shows only whole once the job has committed."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_store(rows: DataFrame, path: str) -> None:
    """A table of the store; documents that are written again replace their rows, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def write_index(rows: DataFrame, path: str, model: str) -> None:
    """Vectors beside their rows, and the name of the model."""
    rows.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)


def write_training(rows: DataFrame, path: str) -> None:
    """Training rows as CSV with a header; its first name starts with a byte order mark."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").csv(path, header=True, escape='"', encoding="UTF-8")


def tables_json(tables: Column) -> Column:
    """Tables as JSON text."""
    return F.to_json(tables)


def pipe_table(rows: Column) -> Column:
    """Rows of cells as a pipe table; the first is its head."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, table_cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(rows, F.lit(0)))))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")).otherwise("")


ARTIFACT_LINE = r"(?mU)^\s*(?:\d{1,4}|[*·•\-_=]{1,5}|BULLETIN OFFICIEL.*|الجريدة الرسمية.*)\s*$\n?"


def article_markdown(article: Column, audit: bool = False) -> Column:
    """An article as Markdown. audit: its entities marked in the text, from the last to the first, so that offsets stay right."""
    text = F.coalesce(article["text"], F.lit(""))
    spans = F.filter(F.coalesce(article["entities"], F.array().cast(f"array<{SPAN}>")), lambda s: (s["start"] >= 0) & (s["end"] > s["start"]))
    last_first = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))))
    mark = lambda t, s: F.concat(F.left(t, s["start"]), F.lit("**"), F.substring(t, s["start"] + 1, s["end"] - s["start"]), F.lit("**["), s["label"], F.lit("]"), F.substring(t, s["end"] + 1, F.length(t)))
    body = F.aggregate(last_first, text, mark) if audit else replaced(text, ARTIFACT_LINE, "")
    heads = F.concat(F.lit("## Article "), F.coalesce(article["number"], F.lit("?")))
    return F.concat(heads, F.lit("\n\n"), body, labelled(article["entities"]))


def labelled(spans: Column) -> Column:
    """Entities by label in the order they first occur, with how often each text does."""
    labels = F.array_distinct(F.transform(spans, lambda s: s["label"]))

    def line(label: Column) -> Column:
        own = F.transform(F.filter(spans, lambda s: s["label"] == label), lambda s: s["text"])
        shown = F.transform(F.array_distinct(own), lambda t: F.concat(t, F.when(F.size(F.filter(own, lambda o: o == t)) > 1, F.concat(F.lit(" (×"), F.size(F.filter(own, lambda o: o == t)).cast("string"), F.lit(")"))).otherwise("")))
        return F.concat(F.lit("- **"), label, F.lit("** : "), F.array_join(shown, ", "))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform(labels, line), "\n"))).otherwise("")


def issue_markdown(issues_: DataFrame, audit: bool = False) -> DataFrame:
    """(doc_id, markdown) of issues; audit adds numbers of articles, entities and citations."""
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.col("doc_id")), F.concat(F.lit("Bulletin Officiel n° "), F.col("bo_number")), F.concat(F.lit("Date : "), F.col("date_publication")))
    body = F.array_join(F.transform("articles", lambda a: article_markdown(a, audit)), "\n\n")
    total = lambda c: F.aggregate(F.transform("articles", lambda a: F.coalesce(F.size(a[c]), F.lit(0))), F.lit(0), lambda x, y: x + y).cast("string")
    stats = F.concat(F.lit("\n\n---\nArticles : "), F.size("articles").cast("string"), F.lit(" ; entités : "), total("entities"), F.lit(" ; citations : "), total("citations"))
    return issues_.select("doc_id", F.concat(head, F.lit("\n\n"), body, stats if audit else F.lit("")).alias("markdown"))


def first_metadata(texts_: DataFrame) -> DataFrame:
    """(doc_id, bo_number, date_publication, edition_label) of the first file of a document with a number, Arabic before French.

    texts_: doc_id, lang, file_rank, text."""
    own = texts_.select("doc_id", F.struct(F.col("file_rank"), F.when(F.col("lang") == "ar", 0).otherwise(1).alias("k")).alias("order"), metadata(F.col("text")).alias("m")).where("m.bo_number IS NOT NULL")
    return own.groupBy("doc_id").agg(F.min_by("m", "order").alias("m")).select("doc_id", "m.*")


def metadata(text: Column) -> Column:
    """struct(bo_number, date_publication, edition_label) from the first 500 characters; an invalid date is null."""
    from quirework.functions import fixed

    head = F.left(text, F.lit(500))
    no = F.regexp_extract(head, r"(?iu)(?:n[°ºo]\s*|عدد\s*)(\d{3,5}(?:[- ]?(?:bis|ter|مكرر))?)", 1)
    months = {**fixed.GREGORIAN_FR, **fixed.GREGORIAN_AR}
    names = "|".join(sorted(months, key=lambda k: (-len(k), k)))
    pattern = rf"(?iuU)(\d{{1,2}})(?:er)?\s+({names})\s+(\d{{4}})"
    month = F.try_element_at(F.create_map(*[F.lit(x) for kv in months.items() for x in kv]), F.lower(F.regexp_extract(head, pattern, 2)))
    day, year = F.regexp_extract(head, pattern, 1).try_cast("int"), F.regexp_extract(head, pattern, 3).try_cast("int")
    zero = F.lit(0)
    date = F.date_format(F.try_make_timestamp(year, month, day, zero, zero, zero), "yyyy-MM-dd")
    edition = F.regexp_extract(head, r"(?iuU)(édition\s+(?:générale|de\s+traduction\s+officielle|des\s+[\p{L}\s]{3,40})|النشرة\s+العامة|نشرة\s+الترجمة\s+الرسمية)", 1)
    return F.struct(F.when(no != "", no).alias("bo_number"), date.alias("date_publication"), F.when(edition != "", edition).alias("edition_label"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(label, phrase) of a JSON-lines dictionary: a phrase as text or pattern, or a pattern of tokens, each with one form or several (IN),
    of which every combination is a phrase. Lines without a phrase are left out."""
    token = "struct<LOWER:string>"
    raw = spark.read.text(path).where("trim(value) <> ''")
    flat = F.get_json_object("value", "$.pattern")
    plain = raw.select(F.get_json_object("value", "$.label").alias("label"), F.coalesce(F.get_json_object("value", "$.text"), F.when(~flat.startswith("["), flat)).alias("phrase"), flat.alias("pattern"))
    forms = F.transform(
        F.from_json("pattern", f"array<{token}>"),
        lambda t: F.coalesce(F.from_json(F.get_json_object(t["LOWER"], "$.IN"), "array<string>"), F.array(t["LOWER"])),
    )
    combined = F.aggregate(forms, F.array(F.lit("")), lambda acc, own: F.flatten(F.transform(acc, lambda a: F.transform(own, lambda w: F.when(a == "", w).otherwise(F.concat_ws(" ", a, w))))))
    tokens = plain.where("phrase IS NULL AND startswith(pattern, '[')").select("label", F.explode(combined).alias("phrase"))
    found = plain.where("phrase IS NOT NULL").select("label", "phrase").unionByName(tokens)
    return found.select("label", F.regexp_replace("phrase", "' ", "'").alias("phrase")).distinct()
