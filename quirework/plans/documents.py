"""Queries over pages and whole documents: copies, layout, segmentation, page maps, tables, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import layout, pages, segment, vectors
from quirework.sources.tables import table


def ocr_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that need scanning by the length of the pages of their issue."""
    own = table(spark, folder, "extracted_pages").select("page_id", "doc_id", "char_count")
    return layout.needs_ocr(own).select("page_id", "needs_ocr")


def ocr_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted pages that a scan of the same page would replace."""
    scans = table(spark, folder, "ocr_pages").groupBy("doc_id", "page_number").agg(F.max_by(F.struct(F.length("text").alias("n"), F.coalesce("mean_confidence", F.lit(0.0)).alias("c")), F.struct("processed_at", "ocr_id")).alias("s"))
    own = table(spark, folder, "extracted_pages").join(scans, ["doc_id", "page_number"])
    takes = layout.takes_ocr(F.length("text"), F.col("s.n"), F.coalesce("needs_ocr", F.lit(False)), F.col("s.c"))
    return own.select("page_id", F.coalesce(takes, F.lit(False)).alias("takes_ocr"))


def mean_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean confidence of the scans of each issue; negative ones don't count."""
    own = table(spark, folder, "ocr_pages").groupBy("doc_id").agg(F.avg(F.when(F.col("mean_confidence") >= 0, F.col("mean_confidence"))).alias("c"), F.count("*").alias("pages"))
    return own.select("doc_id", "pages", F.round("c", 4).alias("mean_confidence"))


def exact_dup_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the same text, by the smallest key."""
    own = table(spark, folder, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return own.where("copies > 1").select("first_id", "copies")


def split_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Shared words of the two sides of each split."""
    own = table(spark, folder, "bilingual_splits").where("text_left IS NOT NULL AND text_right IS NOT NULL")
    return own.select("split_id", F.round(vectors.jaccard(F.col("text_left"), F.col("text_right")), 6).alias("jaccard"))


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues put together from their segments, in order."""
    own = table(spark, folder, "segments").where("doc_id IS NOT NULL")
    piece = F.concat_ws("\n", F.col("preamble"), F.when(F.trim(F.coalesce("raw_header", F.lit(""))) != "", F.col("raw_header")), F.coalesce("text", F.lit("")))
    joined = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_idx", piece.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return joined.withColumn("lang", F.when(F.col("doc_id").startswith("ar"), "ar").otherwise("fr"))


def gazette_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles found again in issues put together from their segments."""
    return segment.articles(_issues(spark, folder)).select("doc_id", "article_idx", "number", F.length("text").alias("characters"), "start_pos")


def gazette_fore_matter(spark: SparkSession, folder: str) -> DataFrame:
    """What stands before the first article of such issues."""
    own = _issues(spark, folder).select("doc_id", segment.fore_matter(F.col("text"), F.col("lang")).alias("f"))
    return own.select("doc_id", F.length("f.preamble").alias("preamble"), F.length("f.contents").alias("contents"))


def header_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Article numbers read off the headers of segments."""
    own = table(spark, folder, "segments").where("raw_header IS NOT NULL AND raw_header <> ''")
    lang = F.when(F.col("doc_id").startswith("ar"), "ar").otherwise("fr")
    return own.select("seg_id", segment.article_number(F.col("raw_header"), lang).alias("number"))


def oversized_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of each article by the structural splitter."""
    own = table(spark, folder, "articles").where("raw_text IS NOT NULL").select("id", F.posexplode(segment.parts_of(F.col("raw_text"), 5000, 2500)).alias("part_no", "part"))
    return own.select("id", "part_no", F.length("part").alias("characters"))


def signature_page_match(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each segment's runs of characters on the pages of its issue."""
    articles = table(spark, folder, "segments").where("text IS NOT NULL").select("doc_id", "article_idx", "text")
    side = table(spark, folder, "extracted_pages").where("text IS NOT NULL").select("doc_id", "page_number", "text")
    return pages.page_scores(articles, side).select("doc_id", "article_idx", "page_number", F.round("score", 6).alias("score"))


def page_map(spark: SparkSession, folder: str) -> DataFrame:
    """Page of each segment, never going back."""
    articles = table(spark, folder, "segments").where("text IS NOT NULL").select("doc_id", "article_idx", "text")
    side = table(spark, folder, "extracted_pages").where("text IS NOT NULL").select("doc_id", "page_number", "text")
    return pages.article_pages(articles, side)


def printed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Printed number of each page."""
    return table(spark, folder, "extracted_pages").where("text IS NOT NULL").select("page_id", pages.printed_page(F.col("text"), F.col("page_number")).alias("printed_page"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks from order lines: places from their keys, a line of Latin or Arabic text."""
    own = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("doc_id"), (F.pmod("l_linenumber", F.lit(2)) + 1).cast("int").alias("page_number"), F.pmod("l_partkey", F.lit(500)).cast("double").alias("x0"),
        F.pmod("l_suppkey", F.lit(700)).cast("double").alias("y0"), F.col("l_quantity"), F.when(F.pmod("l_partkey", F.lit(500)) < 250, "texte").otherwise("نص").alias("text"), "l_extendedprice",
    )
    return own.select("doc_id", "page_number", "x0", "y0", (F.col("x0") + 2 * F.col("l_quantity")).alias("x1"), (F.col("y0") + F.lit(12.0)).alias("y1"), "text", F.floor(F.col("l_extendedprice") * 100).cast("int").alias("block_idx"))


def layout_type(spark: SparkSession, folder: str) -> DataFrame:
    """Layout of each order's blocks."""
    return layout.layout_type(_blocks(spark, folder))


def block_in_table(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks outside a table box that every second order has on its first page, by page."""
    blocks = _blocks(spark, folder)
    boxes = blocks.where("page_number = 1").groupBy("doc_id").agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0")).select("doc_id", F.lit(1).alias("page_number"), "bx0", "by0", (F.col("bx0") + 200).alias("bx1"), (F.col("by0") + 300).alias("by1"))
    return layout.outside_tables(blocks, boxes).groupBy("page_number").agg(F.count("*").alias("blocks"))


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each block in the reading of its page."""
    return layout.in_reading_order(_blocks(spark, folder))


def block_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Horizontal bands of each page's blocks."""
    return layout.bands(_blocks(spark, folder)).groupBy("doc_id", "page_number").agg(F.max("band").alias("bands"))


def bilingual_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks left and right of the middle of each order."""
    own = layout.bilingual_columns(_blocks(spark, folder))
    return own.select("doc_id", F.length("text_left").alias("left_characters"), F.length("text_right").alias("right_characters"))


#: White space of Unicode, for RE2.
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUERIES = {f.__name__: f for f in (
    ocr_threshold, ocr_choice, mean_confidence, exact_dup_docs, split_similarity, gazette_articles, gazette_fore_matter, header_numbers, oversized_parts, signature_page_match,
    page_map, printed_pages, layout_type, block_in_table, reading_order, block_bands, bilingual_columns,
)}
BLOCKS = """
    SELECT l_orderkey::VARCHAR AS doc_id, (l_linenumber % 2 + 1)::INT AS page_number, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey % 700)::DOUBLE AS y0,
           (l_partkey % 500)::DOUBLE + 2 * l_quantity AS x1, (l_suppkey % 700)::DOUBLE + 12 AS y1, l_partkey % 500 < 250 AS latin FROM lineitem
"""
#: Segments (a, and the first 40 characters s) and pages (p) of an issue, with the share of the segment's distinct runs of four characters on the page.
PAIRS = f"""
    g AS (SELECT doc_id, article_idx, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS a FROM segments WHERE text IS NOT NULL),
    h AS (SELECT doc_id, article_idx, a, left(a, 40) AS s, lower(a) AS low FROM g WHERE a <> ''),
    ag AS (SELECT doc_id, article_idx, s, CASE WHEN length(s) >= 30 THEN list_distinct(list_transform(range(1, length(low) - 2), lambda i: substring(low, i, 4))) ELSE [] END AS r FROM h),
    pg AS (SELECT doc_id, page_number, translate(text, chr(13) || chr(10), '  ') AS p FROM extracted_pages WHERE text IS NOT NULL AND page_number IS NOT NULL),
    pr AS (SELECT *, list_distinct(list_transform(range(1, length(p) - 2), lambda i: substring(lower(p), i, 4))) AS q FROM pg),
    m AS (SELECT doc_id, article_idx, page_number, len(r) AS n, contains(p, s) AS whole, contains(p, left(s, 20)) AS short,
                 CASE WHEN len(r) = 0 THEN 0 WHEN contains(p, s) THEN 1 ELSE len(list_intersect(r, q)) / len(r) END AS score FROM ag JOIN pr USING (doc_id))
"""
SQL = {
    "signature_page_match": f"WITH {PAIRS} SELECT doc_id, article_idx, page_number, round(score, 6) AS score FROM m WHERE score >= 0.2",
    "page_map": f"""
        WITH RECURSIVE {PAIRS},
            l AS (SELECT doc_id, article_idx, any_value(n) AS n, list({{'s': -score, 'p': page_number, 'w': whole, 't': short}} ORDER BY page_number) AS x FROM m GROUP BY ALL),
            o AS (SELECT s.doc_id, s.article_idx, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.article_idx) AS k, n, coalesce(x, []) AS x
                  FROM segments s LEFT JOIN l USING (doc_id, article_idx) WHERE s.text IS NOT NULL),
            w AS (SELECT doc_id, 0::BIGINT AS k, NULL::INT AS article_idx, 0 AS last, NULL::INT AS page, NULL::INT AS far FROM (SELECT DISTINCT doc_id FROM o)
                  UNION ALL
                  SELECT doc_id, k, article_idx, coalesce(page, last), page, far FROM (
                    SELECT *, coalesce(CASE WHEN n > 0 AND len(b) > 0 AND -b[1].s * n >= greatest(3, 0.2 * n) THEN CASE WHEN len(c) > 0 AND -c[1].s >= 0.9 * -b[1].s THEN c[1].p ELSE b[1].p END END,
                                       list_min(list_transform(list_filter(x, lambda e: e.t AND e.p >= low), lambda e: e.p))) AS page FROM (
                      SELECT *, list_sort(list_filter(x, lambda e: e.p >= low AND e.s < 0)) AS b, list_sort(list_filter(x, lambda e: e.p >= low AND e.p < low + 7 AND e.s < 0)) AS c,
                             CASE WHEN n > 0 AND len(x) > 0 AND list_sort(x)[1].s <= -0.5 THEN coalesce(list_min(list_transform(list_filter(x, lambda e: e.w), lambda e: e.p)), list_sort(x)[1].p) END AS far FROM (
                        SELECT o.*, w.last, greatest(1, w.last) AS low FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)))
            )
        SELECT doc_id, article_idx, coalesce(page, far)::INT AS pdf_page FROM w WHERE k > 0
    """,
    "ocr_threshold": """
        WITH m AS (SELECT doc_id, quantile_cont(char_count, 0.5) AS middle FROM extracted_pages GROUP BY 1)
        SELECT page_id, char_count < greatest(300, floor(0.30 * middle)) AS needs_ocr FROM extracted_pages LEFT JOIN m USING (doc_id)
    """,
    "ocr_choice": """
        WITH s AS (SELECT doc_id, page_number, arg_max({'n': length(text), 'c': coalesce(mean_confidence, 0)}, (processed_at, ocr_id)) AS s FROM ocr_pages GROUP BY ALL)
        SELECT page_id, coalesce(s.n > length(text) + 100 OR (coalesce(needs_ocr, false) AND s.c > 0.7 AND s.n > 0.5 * length(text)), false) AS takes_ocr
        FROM extracted_pages JOIN s USING (doc_id, page_number)
    """,
    "mean_confidence": """
        SELECT doc_id, count(*) AS pages, round(avg(CASE WHEN mean_confidence >= 0 THEN mean_confidence END), 4) AS mean_confidence FROM ocr_pages GROUP BY 1
    """,
    "exact_dup_docs": "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "split_similarity": f"""
        WITH w AS (SELECT split_id, list_distinct(list_filter(regexp_split_to_array(lower(text_left), '{WS}+'), lambda x: x <> '')) AS l,
                          list_distinct(list_filter(regexp_split_to_array(lower(text_right), '{WS}+'), lambda x: x <> '')) AS r FROM bilingual_splits WHERE text_left IS NOT NULL AND text_right IS NOT NULL)
        SELECT split_id, round(CASE WHEN len(l) + len(r) = 0 THEN 0 ELSE 100.0 * len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))) END, 6) AS jaccard FROM w
    """,
    "printed_pages": r"""
        WITH m AS (SELECT page_id, page_number, regexp_extract_all(right(text, 500), '(?m)^[ \t]*([0-9]{1,4})[ \t]*$', 1) AS t, regexp_extract_all(text, '(?m)^[ \t]*([0-9]{1,4})[ \t]*$', 1) AS a
                   FROM extracted_pages WHERE text IS NOT NULL)
        SELECT page_id, CASE WHEN len(t) > 0 THEN t[1]::INT WHEN len(a) > 0 THEN a[-1]::INT ELSE page_number END AS printed_page FROM m
    """,
    "header_numbers": f"""
        WITH h AS (SELECT seg_id, raw_header, CASE WHEN starts_with(doc_id, 'ar') THEN translate(regexp_extract(raw_header, '(?:المادة|املادة){WS}*([0-9٠-٩]+|{segment.ORDINAL_AR})', 1), '٠١٢٣٤٥٦٧٨٩', '0123456789')
                          ELSE regexp_extract(raw_header, '(?i)(PREMIER|1er|UNIQUE|[0-9]+(?:-[0-9]+)?)', 1) END AS n FROM segments WHERE raw_header IS NOT NULL AND raw_header <> '')
        SELECT seg_id, CASE WHEN n = '' THEN regexp_replace(raw_header, '^{WS}+|{WS}+$', '', 'g') ELSE n END AS number FROM h
    """,
    "block_bands": f"""
        WITH b AS ({BLOCKS}), g AS (SELECT doc_id, page_number, y0, coalesce(y0 - lag(y1) OVER (PARTITION BY doc_id, page_number ORDER BY y0) > 15, true) AS new FROM b)
        SELECT doc_id, page_number, sum(new::INT)::BIGINT AS bands FROM g GROUP BY ALL
    """,
    "bilingual_columns": f"""
        WITH b AS ({BLOCKS}), m AS (SELECT doc_id, (min(x0) + max(x1)) / 2 AS middle FROM b GROUP BY 1), c AS (SELECT doc_id, (x0 + x1) / 2 < middle AS l, CASE WHEN latin THEN 5 ELSE 2 END AS n FROM b JOIN m USING (doc_id))
        SELECT doc_id, greatest(coalesce(sum(n + 1) FILTER (l), 0) - 1, 0)::INT AS left_characters, greatest(coalesce(sum(n + 1) FILTER (NOT l), 0) - 1, 0)::INT AS right_characters FROM c GROUP BY 1
    """,
    "layout_type": f"""
        WITH b AS ({BLOCKS}), m AS (SELECT doc_id, (min(x0) + max(x1)) / 2 AS middle FROM b GROUP BY 1),
             c AS (SELECT doc_id, (x0 + x1) / 2 < middle AS l, latin FROM b JOIN m USING (doc_id)),
             s AS (SELECT doc_id, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr, coalesce(sum(CASE WHEN l AND NOT latin THEN 2 END), 0) AS al, coalesce(sum(CASE WHEN l THEN CASE WHEN latin THEN 5 ELSE 2 END END), 0) AS ll,
                          coalesce(sum(CASE WHEN NOT l AND NOT latin THEN 2 END), 0) AS ar, coalesce(sum(CASE WHEN NOT l THEN CASE WHEN latin THEN 5 ELSE 2 END END), 0) AS lr FROM c GROUP BY 1),
             r AS (SELECT *, al / greatest(ll, 1) AS rl, ar / greatest(lr, 1) AS rr FROM s)
        SELECT doc_id, CASE WHEN least(nl, nr) / greatest(nl, nr, 1) > 0.35 AND NOT ((rl > 0.5 AND rr > 0.5) OR (rl < 0.5 AND rr < 0.5)) THEN 'colonnes' ELSE 'pleine_page' END AS layout FROM r
    """,
    "block_in_table": f"""
        WITH b AS ({BLOCKS}), t AS (SELECT doc_id, min(x0) AS bx0, min(y0) AS by0 FROM b WHERE page_number = 1 GROUP BY 1)
        SELECT page_number, count(*) AS blocks FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND b.page_number = 1
            AND greatest(0, least(x1, bx0 + 200) - greatest(x0, bx0)) * greatest(0, least(y1, by0 + 300) - greatest(y0, by0)) / greatest((x1 - x0) * (y1 - y0), 1e-6) >= 0.5) GROUP BY 1
    """,
}
