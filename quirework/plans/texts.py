"""Queries over texts: cleaning, language, domains, dates, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import fixed, language
from quirework.functions import text as T
from quirework.operators import classify, spans
from quirework.sources.tables import spread, table

#: White space of Unicode, for RE2.
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
AR = r"[\x{600}-\x{6ff}\x{750}-\x{77f}]"


def _n(pattern: str, column: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def domain_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the language of their script and the domain of their keywords."""
    own = spread(table(spark, folder, "documents").where("text IS NOT NULL").select("text")).select(language.routed(F.col("text")).alias("lang"), "text")
    return own.select("lang", classify.classify(F.col("text"), F.col("lang")).alias("domain")).groupBy("lang", "domain").agg(F.count("*").alias("documents"))


def _word_count(word: str) -> str:
    isolated = "".join(c if c.isalnum() or c == "_" else f" {c} " for c in word.lower()).replace("'", "''")
    pattern = f"' {isolated} '"
    count = f"((length(s) - length(replace(s, {pattern}, ''))) // length({pattern}))"
    return f"({count} - {_n('(?:^|[^\\p{L}\\p{M}\\p{N}_])بناء\\s+على', 't')})" if word == "بناء" else count


def _labelled_sql(rows: str) -> str:
    """CTEs that end in l: the rows (lang, text and others) with their label."""
    lists = {lang: ", ".join(f"{{'d': '{d}', 'k': {i}, 's': {' + '.join(map(_word_count, words[j]))}}}" for i, (d, words) in enumerate(fixed.DOMAINS.items())) for j, lang in enumerate(("fr", "ar"))}
    return f"""
        WITH r AS ({rows}),
             a AS (SELECT *, lower(text) AS t, ' ' || regexp_replace(lower(text), '([^\\p{{L}}\\p{{M}}\\p{{N}}_])', ' \\1 ', 'g') || ' ' AS s FROM r),
             b AS (SELECT *, CASE WHEN lang = 'ar' THEN [{lists['ar']}] ELSE [{lists['fr']}] END AS x FROM a),
             c AS (SELECT *, list_sort(list_transform(x, lambda e: {{'s': -e.s, 'k': e.k, 'd': e.d}}))[1] AS top FROM b),
             l AS (SELECT *, CASE WHEN top.s < 0 THEN top.d ELSE '{fixed.UNDETERMINED}' END AS label FROM c)
    """


def _domain_sql() -> str:
    rows = f"SELECT CASE WHEN {_n(AR, 'text')} > 0.30 * {_n('\\p{L}', 'text')} THEN 'ar' ELSE 'fr' END AS lang, text FROM documents WHERE text IS NOT NULL"
    return f"{_labelled_sql(rows)} SELECT lang, label AS domain, count(*) AS documents FROM l GROUP BY ALL"


def _training_sql() -> str:
    stripped = f"regexp_replace(raw_text, '^{WS}+|{WS}+$', '', 'g')"
    rows = f"""SELECT CASE WHEN {_n(AR, 'raw_text')} > 0.30 * {_n('\\p{L}', 'raw_text')} THEN 'ar' ELSE 'fr' END AS lang, left({stripped}, 6000) AS text, length({stripped}) > 6000 AS truncated
               FROM articles WHERE length({stripped}) >= 30"""
    return f"{_labelled_sql(rows)} SELECT lang, label, truncated, count(*) AS n FROM l GROUP BY ALL"


def lang_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each page by its script."""
    own = table(spark, folder, "extracted_pages").select("page_id", language.detected(F.col("text")).alias("d"))
    return own.select("page_id", "d.language", F.round("d.confidence", 6).alias("confidence"))


def route_language(spark: SparkSession, folder: str) -> DataFrame:
    """Articles by the language they are routed to."""
    return table(spark, folder, "articles").where("raw_text IS NOT NULL").groupBy(language.routed(F.col("raw_text")).alias("lang")).agg(F.count("*").alias("articles"), F.sum(F.length("raw_text")).alias("characters"))


def lines_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Page texts split by the language of each line."""
    return language.split_lines(table(spark, folder, "extracted_pages"), "page_id", "text")


def documents_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each issue's text in each language, pages in order."""
    own = language.split_documents(table(spark, folder, "extracted_pages"))
    return own.select("doc_id", "language", F.length("text").alias("characters"), F.md5("text").alias("digest"))


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with one kind of line end, no blank lines and no blanks at line ends."""
    return table(spark, folder, "articles").where("raw_text IS NOT NULL").select("id", T.squeezed_lines(T.collapsed(T.line_ends(F.col("raw_text")))).alias("text"))


def clean_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles through the cleaning chain of their language, with the Arabic runs taken out of French ones."""
    own = spread(table(spark, folder, "articles").where("raw_text IS NOT NULL").select("id", "raw_text")).withColumn("lang", language.routed(F.col("raw_text")))
    own = own.select("id", "lang", T.clean_french(F.when(F.col("lang") == "fr", F.col("raw_text"))).alias("c"), T.clean_arabic(F.when(F.col("lang") == "ar", F.col("raw_text"))).alias("t"))
    return own.select("id", "lang", F.coalesce("t", "c.text").alias("text"), F.when(F.col("lang") == "fr", F.size("c.removed")).otherwise(0).alias("removed"))


def page_number_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with lone numbers of up to four digits on a line, and how many."""
    own = table(spark, folder, "extracted_pages").select("page_id", F.regexp_count("text", F.lit(r"(?md)^[ \t]*[0-9]{1,4}[ \t]*$")).alias("lines"))
    return own.where("lines > 0")


def date_months(spark: SparkSession, folder: str) -> DataFrame:
    """Dates in documents by language of the script, calendar and month."""
    own = spread(table(spark, folder, "documents").where("text IS NOT NULL").select("text")).select(language.routed(F.col("text")).alias("lang"), "text")
    found = own.select("lang", F.explode(spans.find_dates(F.col("text"), F.col("lang"))).alias("d"))
    return found.groupBy("lang", "d.label", F.col("d.meta")["month"].cast("int").alias("month")).agg(F.count("*").alias("dates"), F.min(F.col("d.meta")["year"].cast("int")).alias("first_year"))


def word_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """Articles and documents with the words put right that come broken out of files."""
    texts = table(spark, folder, "articles").select(F.lit("articles").alias("tbl"), F.col("id").alias("row_id"), F.col("raw_text").alias("text"))
    texts = texts.unionByName(table(spark, folder, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "text"))
    return texts.where("text IS NOT NULL").select("tbl", "row_id", F.md5(T.pdf_words(F.col("text"))).alias("text"))


def references_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """References, dates and names in articles, without overlaps, by label and language."""
    own = spread(table(spark, folder, "articles").where("raw_text IS NOT NULL").select("raw_text")).select(language.routed(F.col("raw_text")).alias("lang"), F.col("raw_text").alias("text"))
    return own.select("lang", F.explode(spans.find_legal_entities(F.col("text"), F.col("lang"))).alias("s")).groupBy("lang", "s.label").agg(F.count("*").alias("n"), F.countDistinct("s.text").alias("texts"))


def valid_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that pass the filter, by label."""
    own = table(spark, folder, "entities").where("text IS NOT NULL").select("label", T.flat_entity(F.col("text")).alias("text"))
    return own.where(spans.valid(F.col("text"), F.coalesce("label", F.lit("")))).groupBy("label").agg(F.count("*").alias("n"))


def entity_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by how their offsets fit the article: in range, and equal to the slice."""
    home = table(spark, folder, "articles").select(F.col("id").alias("article_id"), "raw_text")
    own = table(spark, folder, "entities").join(home, "article_id")
    inside = F.coalesce((F.col("start_pos") >= 0) & (F.col("start_pos") < F.col("end_pos")) & (F.col("end_pos") <= F.length("raw_text")), F.lit(False))
    same = F.coalesce(F.substring("raw_text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")) == F.col("text"), F.lit(False))
    return own.groupBy(inside.alias("in_range"), (inside & same).alias("is_slice")).agg(F.count("*").alias("n"))


def located_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities without valid offsets, put where their text stands in the article."""
    home = table(spark, folder, "articles").select(F.col("id").alias("article_id"), "raw_text")
    own = table(spark, folder, "entities").where("text IS NOT NULL AND (start_pos IS NULL OR start_pos < 0)").join(home, "article_id")
    span = F.struct("label", "text", F.col("start_pos").alias("start"), "end_pos", F.lit(None).cast("map<string,string>").alias("meta"))
    return own.select("id", spans.located(span, F.col("raw_text")).alias("s")).select("id", "s.start", "s.end_pos", "s.text")


def overlap_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of each article that stay when earlier ones win over those they overlap."""
    own = table(spark, folder, "entities").where("start_pos >= 0 AND end_pos > start_pos")
    collected = F.array_sort(F.collect_list(F.struct("id", "label", "text", F.col("start_pos").alias("start"), "end_pos")))
    span = lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"), x["start"].alias("start"), x["end_pos"].alias("end_pos"), F.lit(None).cast("map<string,string>").alias("meta"))
    grouped = own.groupBy("article_id").agg(F.transform(collected, span).alias("all"))
    return grouped.select("article_id", F.size("all").alias("before"), F.size(spans.resolved_overlaps(F.col("all"))).alias("after"))


def rules_over_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names that overlap no reference of their article, by label."""
    own = table(spark, folder, "entities").where("start_pos >= 0 AND end_pos > start_pos")
    rules = own.where(F.col("label").isin(fixed.LEGAL_LABELS)).select("article_id", F.col("start_pos").alias("a"), F.col("end_pos").alias("b"))
    names = own.where(F.col("label").isin("PERSON", "ORG", "MINISTERE"))
    kept = names.join(rules, (names["article_id"] == rules["article_id"]) & (F.col("a") < F.col("end_pos")) & (F.col("start_pos") < F.col("b")), "left_anti")
    return kept.groupBy("label").agg(F.count("*").alias("n"))


def persons_and_organisations(spark: SparkSession, folder: str) -> DataFrame:
    """Person and organisation entities through both passes of filters and the company test."""
    home = table(spark, folder, "articles").select(F.col("id").alias("article_id"), "raw_text")
    own = table(spark, folder, "entities").where("text IS NOT NULL AND label IN ('PERSON', 'ORG') AND start_pos >= 0").join(home, "article_id").withColumn("lang", language.routed(F.col("raw_text")))
    company = spans.company_context(F.col("text"), F.col("start_pos"), F.col("end_pos"), F.col("raw_text"))
    person = spans.likely_person(F.col("text"), F.col("lang")) & spans.gazetteer_person(F.col("text"), F.col("start_pos"), F.col("end_pos"), F.col("raw_text"))
    kept = F.when(F.col("label") == "ORG", spans.likely_organisation(F.col("text"), F.col("lang"))).otherwise(person)
    own = own.select("lang", F.when((F.col("label") == "PERSON") & F.coalesce(company, F.lit(False)), "COMPANY").otherwise(F.col("label")).alias("kind"), kept.alias("kept"))
    return own.groupBy("lang", "kind").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Articles long enough with their keyword label, by label and truncation."""
    own = spread(table(spark, folder, "articles").where("raw_text IS NOT NULL").select("id", "raw_text")).select("id", language.routed(F.col("raw_text")).alias("lang"), F.col("raw_text").alias("text"))
    return classify.training_rows(own).groupBy("lang", "label", "truncated").agg(F.count("*").alias("n"))


def page_language_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of the script heuristic against the runs' most frequent forms of ar and fr."""
    pages = table(spark, folder, "extracted_pages").where("language IN ('fr', 'ar')")
    pairs = pages.select(F.col("language").alias("truth"), language.detected(F.col("text"))["language"].alias("found"))
    return classify.metrics(pairs)


def label_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of subject labels with ten rows and more."""
    return classify.class_weights(classify.kept_classes(table(spark, folder, "subject_labels").select(F.col("subject").alias("label"))))


def _dates_sql() -> str:
    """Dates of both calendars; the months of a language are told apart by the calendar they are of."""
    day = "[0-9٠-٩]{1,2}"
    year = {"gregorian": "4", "hijri": "3,4"}

    def names(months: dict[str, int], lang: str) -> str:
        alternatives = "|".join(sorted(months, key=lambda k: (-len(k), k)))
        return alternatives if lang == "fr" else "".join("[اأإآٱ]" if c in "اأإآٱ" else c for c in alternatives)

    parts = []
    for lang, calendar, label, months in (
        ("fr", "gregorian", "DATE_GREGORIAN", fixed.GREGORIAN_FR), ("fr", "hijri", "DATE_HIJRI", fixed.HIJRI_FR), ("ar", "gregorian", "DATE_GREGORIAN", fixed.GREGORIAN_AR), ("ar", "hijri", "DATE_HIJRI", fixed.HIJRI_AR),
    ):
        pattern = f"(?i)\\b[0-9]{{1,2}}(?:er)?{WS}+(?:{names(months, lang)}){WS}+[0-9]{{{year[calendar]}}}\\b" if lang == "fr" else f"{day}{WS}+(?:من{WS}+)?(?:{names(months, lang)}){WS}+[0-9٠-٩]{{{year[calendar]}}}"
        values = ", ".join(f"('{_plain(k)}', {v})" for k, v in {_plain(k): v for k, v in months.items()}.items())
        parts.append(f"""
            SELECT lang, '{label}' AS label, month, y FROM (
                SELECT lang, translate(regexp_replace(regexp_extract(lower(d), '(?:er)?{WS}+(?:من{WS}+)?([^0-9٠-٩]+?){WS}+[0-9٠-٩]{{3,4}}$', 1), '{WS}+', ' ', 'g'), 'أإآٱ', 'اااا') AS name,
                       translate(regexp_extract(d, '[0-9٠-٩]+$'), '٠١٢٣٤٥٦٧٨٩', '0123456789')::INT AS y
                FROM (SELECT lang, unnest(regexp_extract_all(text, '{pattern}')) AS d FROM t WHERE lang = '{lang}')) JOIN (VALUES {values}) v(name, month) USING (name)""")
    rows = f"SELECT CASE WHEN {_n(AR, 'text')} > 0.30 * {_n('\\p{L}', 'text')} THEN 'ar' ELSE 'fr' END AS lang, text FROM documents WHERE text IS NOT NULL"
    return f"WITH t AS ({rows}), u AS ({' UNION ALL '.join(parts)}) SELECT lang, label, month, count(*) AS dates, min(y) AS first_year FROM u GROUP BY 1, 2, 3"


def _plain(name: str) -> str:
    return name.lower().translate(str.maketrans("أإآٱ", "اااا"))


def _fixes_sql() -> str:
    """Each word by the three lists, one after the other."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = lambda d: "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in d.items()) + "}"
    small = {k: v if isinstance(v, str) else v[0] for k, v in fixed.ACCENT_FIXES.items()}
    large = {k: v if isinstance(v, str) else v[1] for k, v in fixed.ACCENT_FIXES.items()}
    get = lambda d, key, other: f"coalesce({pairs(d)}[{key}], {other})"
    return f"""
        WITH t AS (SELECT 'articles' AS tbl, id AS row_id, raw_text AS text FROM articles UNION ALL SELECT 'documents', doc_id, text FROM documents),
             w AS (SELECT tbl, row_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), 1) AS k FROM t WHERE text <> ''),
             d AS (SELECT DISTINCT w FROM w), a AS (SELECT w, {get(fixed.WORD_FIXES, 'lower(w)', 'w')} AS x FROM d), b AS (SELECT w, {get(fixed.CASED_FIXES, 'x', 'x')} AS x FROM a),
             c AS (SELECT w, CASE WHEN x = lower(x) THEN {get(small, 'lower(x)', 'x')} ELSE {get(large, 'lower(x)', 'x')} END AS x FROM b)
        SELECT tbl, row_id, md5(string_agg(x, '' ORDER BY k)) AS text FROM w JOIN c USING (w) GROUP BY 1, 2
        UNION ALL SELECT tbl, row_id, md5('') FROM t WHERE text = ''
    """


QUERIES = {f.__name__: f for f in (
    domain_by_lang, lang_heuristic, route_language, lines_by_language, documents_by_language, clean_lines, clean_articles, page_number_lines, date_months, word_fixes, references_by_label, valid_entities,
    entity_slices, located_entities, overlap_resolution, rules_over_names, persons_and_organisations, training_rows, page_language_metrics, label_weights,
)}

DETECTED = f"CASE WHEN n = 0 THEN 'unknown' WHEN a / n > 0.5 THEN 'ar' WHEN a / n >= 0.4 THEN 'mixed' ELSE 'fr' END"
SQL = {
    "domain_by_lang": _domain_sql(),
    "training_rows": _training_sql(),
    "lang_heuristic": f"""
        WITH p AS (SELECT page_id, {_n(AR, "coalesce(text, '')")} AS a, {_n('\\p{L}', "coalesce(text, '')")} AS n FROM extracted_pages)
        SELECT page_id, {DETECTED} AS language,
               round(CASE WHEN n = 0 THEN 0.0 WHEN a / n > 0.5 THEN a / n WHEN a / n >= 0.4 THEN 0.5 ELSE 1 - a / n END, 6) AS confidence FROM p
    """,
    "route_language": f"""
        SELECT CASE WHEN {_n(AR, 'raw_text')} > 0.30 * {_n('\\p{L}', 'raw_text')} THEN 'ar' ELSE 'fr' END AS lang, count(*) AS articles, sum(length(raw_text))::BIGINT AS characters
        FROM articles WHERE raw_text IS NOT NULL GROUP BY 1
    """,
    "lines_by_language": f"""
        WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM extracted_pages WHERE text IS NOT NULL),
             c AS (SELECT *, {_n(AR, 'line')} AS a, {_n('\\p{L}', 'line')} AS n FROM l WHERE trim(line) <> ''),
             d AS (SELECT page_id, k, line, CASE WHEN {DETECTED} IN ('fr', 'ar') THEN {DETECTED} ELSE 'unknown' END AS language FROM c)
        SELECT page_id, language, string_agg(line, chr(10) ORDER BY k) AS text FROM d GROUP BY ALL
    """,
    "documents_by_language": f"""
        WITH p AS (SELECT doc_id, page_number, text, {_n(AR, 'text')} AS a, {_n('\\p{L}', 'text')} AS n FROM extracted_pages WHERE text IS NOT NULL),
             d AS (SELECT doc_id, page_number, text, CASE WHEN {DETECTED} IN ('fr', 'ar') THEN {DETECTED} ELSE 'unknown' END AS language FROM p),
             j AS (SELECT doc_id, language, string_agg(text, chr(10) || chr(10) ORDER BY page_number, text) AS text FROM d GROUP BY ALL)
        SELECT doc_id, language, length(text)::INT AS characters, md5(text) AS digest FROM j
    """,
    "clean_lines": f"""
        WITH t AS (SELECT id, string_split(regexp_replace(raw_text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM articles WHERE raw_text IS NOT NULL)
        SELECT id, regexp_replace(array_to_string(list_filter(list_transform(l, lambda x: regexp_replace(x, '{WS}+$', '')), lambda x: x <> ''), chr(10)), '^{WS}+|{WS}+$', '', 'g') AS text FROM t
    """,
    "page_number_lines": f"""
        SELECT page_id, {_n('(?m)^[ \\t]*[0-9]{1,4}[ \\t]*$', 'text')}::INT AS lines FROM extracted_pages WHERE {_n('(?m)^[ \\t]*[0-9]{1,4}[ \\t]*$', 'text')} > 0
    """,
    "date_months": _dates_sql(),
    "word_fixes": _fixes_sql(),
    "entity_slices": """
        WITH e AS (SELECT coalesce(start_pos >= 0 AND start_pos < end_pos AND end_pos <= length(raw_text), false) AS i,
                          coalesce(substring(raw_text, start_pos + 1, end_pos - start_pos) = text, false) AS s
                   FROM entities JOIN articles ON articles.id = article_id)
        SELECT i AS in_range, i AND s AS is_slice, count(*) AS n FROM e GROUP BY ALL
    """,
    "rules_over_names": """
        WITH own AS (SELECT * FROM entities WHERE start_pos >= 0 AND end_pos > start_pos),
             rules AS (SELECT * FROM own WHERE label IN ('LOI', 'DECRET', 'ARRETE', 'DAHIR'))
        SELECT label, count(*) AS n FROM own WHERE label IN ('PERSON', 'ORG', 'MINISTERE') AND NOT EXISTS (
            SELECT 1 FROM rules r WHERE r.article_id = own.article_id AND r.start_pos < own.end_pos AND own.start_pos < r.end_pos) GROUP BY 1
    """,
    "page_language_metrics": f"""
        WITH p AS (SELECT language AS truth, {_n(AR, "coalesce(text, '')")} AS a, {_n('\\p{L}', "coalesce(text, '')")} AS n FROM extracted_pages WHERE language IN ('fr', 'ar')),
             q AS (SELECT truth, {DETECTED} AS found FROM p),
             l AS (SELECT truth AS label FROM q UNION SELECT found FROM q),
             c AS (SELECT label, (SELECT count(*) FROM q WHERE truth = label) AS t, (SELECT count(*) FROM q WHERE found = label) AS f, (SELECT count(*) FROM q WHERE truth = label AND found = label) AS h FROM l),
             r AS (SELECT label, t AS support, CASE WHEN f = 0 THEN 0 ELSE h / f END AS precision, CASE WHEN t = 0 THEN 0 ELSE h / t END AS recall FROM c),
             s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)
        SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s
        UNION ALL SELECT NULL, (SELECT count(*) FROM q), round((SELECT count(*) FROM q WHERE truth = found) / (SELECT count(*) FROM q), 6),
                         round((SELECT count(*) FROM q WHERE truth = found) / (SELECT count(*) FROM q), 6), round((SELECT avg(f1) FROM s), 6)
    """,
    "label_weights": """
        WITH c AS (SELECT subject AS label, count(*) AS n FROM subject_labels GROUP BY 1 HAVING count(*) >= 10)
        SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c
    """,
}
