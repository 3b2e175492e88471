"""Tables of pages: cells, copies, links to articles and instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LEAST_CHARACTERS, LEAST_RATIO = 20, 0.30


def normal_cells(rows: Column) -> Column:
    """Cells trimmed, null cells empty."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(F.trim(c), F.lit(""))))


def has_content(rows: Column) -> Column:
    """Whether any cell isn't blank."""
    return F.exists(F.flatten(rows), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def table_key(*columns: str) -> Column:
    """Digest of the columns that tell tables apart."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def distinct_tables(tables: DataFrame, order: str) -> DataFrame:
    """The first table of each page, box and cells of a document."""
    keyed = tables.withColumn("table_key", table_key("page_number", "bbox", "rows"))
    first = keyed.groupBy("doc_id", "table_key").agg(F.min(order).alias(order))
    return keyed.join(first, ["doc_id", "table_key", order], "left_semi")


def cell_characters(rows: Column, text: Column) -> Column:
    """struct(hits, all): characters of the cells, and how many of them occur in the text at all."""
    joined = F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), " ")
    chars = F.split(joined, "")
    return F.struct(F.size(F.filter(chars, lambda c: text.contains(c))).alias("hits"), F.length(joined).alias("all"))


def linked(tables: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, table_key, article_idx): tables of an article's page whose characters occur in it; those without an article by page go to
    the one with the highest share of their characters, the first of equals. An empty table goes with every article of its page."""
    own = articles.select("doc_id", "article_idx", F.col("pdf_page").alias("page_number"), "text")
    by_page = tables.join(own, ["doc_id", "page_number"]).withColumn("c", cell_characters(F.col("rows"), F.col("text")))
    first = by_page.where(~has_content(F.col("rows")) | (F.col("c.hits") >= LEAST_CHARACTERS)).select("doc_id", "table_key", "article_idx")
    rest = tables.where(has_content(F.col("rows"))).join(first.select("doc_id", "table_key").distinct(), ["doc_id", "table_key"], "left_anti")
    scored = rest.join(own.drop("page_number"), "doc_id").withColumn("c", cell_characters(F.col("rows"), F.col("text"))).withColumn("ratio", F.col("c.hits") / F.col("c.all"))
    best = scored.where(F.col("ratio") >= LEAST_RATIO).groupBy("doc_id", "table_key").agg(F.max_by("article_idx", F.struct("ratio", (-F.col("article_idx")).alias("k"))).alias("article_idx"))
    return first.unionByName(best)


def unlinked(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Tables that no article took."""
    return tables.join(links.select("doc_id", "table_key").distinct(), ["doc_id", "table_key"], "left_anti")


def instrument_tables(links: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, instrument_id, table_keys): the distinct tables of an instrument's articles."""
    joined = links.join(articles.select("doc_id", "article_idx", "instrument_id"), ["doc_id", "article_idx"])
    return joined.groupBy("doc_id", "instrument_id").agg(F.array_sort(F.collect_set("table_key")).alias("table_keys"))


def summary(tables: Column) -> Column:
    """struct(n_tables, n_rows, n_cols) of an array of tables: number, rows in all, most columns."""
    total = F.aggregate(tables, F.lit(0), lambda a, t: a + F.coalesce(t["n_rows"], F.lit(0)))
    return F.struct(F.size(tables).alias("n_tables"), total.alias("n_rows"), F.coalesce(F.array_max(F.transform(tables, lambda t: t["n_cols"])), F.lit(0)).alias("n_cols"))


def ascii_tables(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first_line, lines, markdown): runs of two or more lines with wide gaps, as pipe tables."""
    own = frame.select(F.col(key).alias("own_key"), F.col(text).alias("whole"))
    lines = own.select("own_key", F.posexplode(F.split("whole", "\n")).alias("place", "line")).where(F.col("line").rlike(r"\S {4,}\S"))
    # neighbouring lines have the same distance from their rank
    marked = lines.withColumn("island", F.col("place") - F.row_number().over(Window.partitionBy("own_key").orderBy("place")))
    cells = F.transform(F.split(F.trim("line"), r" {3,}"), lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    row = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    runs = marked.groupBy("own_key", "island").agg(F.min("place").alias("first_line"), F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("place", row.alias("row"), F.size(cells).alias("n")))).alias("rows"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("rows")[0]["n"]))
    body = F.transform("rows", lambda r: r["row"])
    return runs.where("lines > 1").select(F.col("own_key").alias(key), "first_line", "lines", F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.size(body))), "\n").alias("markdown"))
