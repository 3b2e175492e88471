"""Issues into articles: markers, annexes, preambles, contents lists, decrees, repairs of broken articles.

Offsets are code points of the issue's text. The markers of an issue and the pieces between them are found in one pass over its
text (``article_rows``); merging fragments is a matter of neighbouring rows and stays in windows. An issue is one row, its
articles are many; windows are by issue.
A null text has no articles. A text without markers has none either, its whole text is the preamble.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quirework.functions import fixed
from quirework.functions.text import strip, western_digits

# Sizes in characters, and the forms of markers.
MOST = 30_000
REFINED = 5_000
SHORT = 50
TRUNCATED = 100
STRAY = 15
ANNEX_LEAST = 200
DECREE_LEAST = 100
DECREE_TAIL = 50
CONTENTS_LEAST = 500

ARTICLE_FR = re.compile(r"ART(?:ICLE)?\.?\s*(?P<no>PREMIER|1er|UNIQUE|\d+(?:-\d+)?)\s*\.?\s*[-–.:—]?(?![\dA-Za-zÀ-ɏ])", re.IGNORECASE)
ORDINAL_AR = "|".join("[اأإآ]".join(re.split("[اأإآ]", o)) for o in fixed.ORDINALS_AR)
ARTICLE_AR = re.compile(rf"(?:المادة|املادة)\s*(?P<no>[0-9٠-٩]+|{ORDINAL_AR}|[اأ]?لا?[اأ]ولى)\s*[.:\-–]?")
TITLE_FR = re.compile(r"^[ \t]*(?P<w>Arr[eê]t[eé]|D[eé]cret|Dahir|D[eé]cision|R[eè]glement|Avis|Circulaire|Annexe)\b", re.MULTILINE | re.IGNORECASE)
TITLE_AR = re.compile(r"^[ \t]*(?P<w>ظهير|مرسوم|قرار|مقرر|قانون|[أا]مر|منشور|بلاغ)\b", re.MULTILINE)
SECTION_FR = re.compile(r"^[ \t]*TEXTES[ \t]+(?:G[ÉE]N[ÉE]RAUX|PARTICULIERS)\b", re.MULTILINE)
HEADINGS = re.compile(r"\n(?:(?:Chapitre|TITRE)\s+(?:[IVXL]+|\d+)|(?:Section|Paragraphe)\s+\d+)\b[.\s:]", re.IGNORECASE)
LISTED = re.compile(r"\n(?:[IVXL]+\.\s|\d{1,2}\.\s(?=[A-ZÀ-ɏ]))")
ANNEX = re.compile(r"^(Annexe\s*\d*)", re.MULTILINE | re.IGNORECASE)
#: Ends of a contents list, in the order they are tried.
CONTENTS = {"fr": ("SOMMAIRE", ["TEXTES GENERAUX", "TEXTES GÉNÉRAUX", "TEXTES PARTICULIERS"]), "ar": ("فهرست", ["نصوص عامة", "نصوص خاصة"])}


def is_title(text: str, m: re.Match, lang: str) -> bool:
    """Whether a title word at a line start is a title: a capital, or no lower-case letter ends the line before."""
    if lang == "ar" or m.group("w")[0].isupper():
        return True
    head = text[: m.start()].rstrip(" \t\r\n")
    return not head or not head[-1].islower()


def titles(text: str, lang: str, low: int, high: int) -> list[int]:
    """Starts of titles in a part of the text."""
    pattern = TITLE_AR if lang == "ar" else TITLE_FR
    return [m.start() for m in pattern.finditer(text, low, high) if is_title(text, m, lang)]


def markers(text: str, lang: str) -> list[tuple[int, int, str]]:
    """Start, end and number of each article marker. French ones start a line with a capital, outside quotation marks."""
    if lang == "ar":
        return [(m.start(), m.end(), m.group("no").translate(str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789"))) for m in ARTICLE_AR.finditer(text)]
    out = []
    for m in ARTICLE_FR.finditer(text):
        line = text.rfind("\n", 0, m.start()) + 1
        quoted = text.rfind("«", 0, m.start()) > text.rfind("»", 0, m.start())
        if not text[line : m.start()].strip() and m.group()[0].isupper() and not quoted:
            out.append((m.start(), m.end(), m.group("no")))
    return out


def contents_end(text: str, lang: str) -> tuple[int, int]:
    """Start and end of the contents list; (0, 0) without one. Its end is the first end mark, tried in order, far enough on."""
    word, ends = CONTENTS["ar" if lang == "ar" else "fr"]
    start = text.find(word)
    if start < 0:
        return 0, 0
    for end in ends:
        at = text.find(end, start + CONTENTS_LEAST)
        if at >= 0:
            return start, at
    return 0, 0


def article_rows(text: str, lang: str) -> list[tuple[str, str, str, int, str | None]]:
    """(number, header, text, start, preamble) of each article and annex of an issue."""
    skip = contents_end(text, lang)[1]
    found = [m for m in markers(text, lang) if m[0] >= skip]
    out, preamble = [], None
    for (start, head_end, no), (following, *_) in pairwise([*found, (len(text), 0, "")]):
        cut = following
        if lang != "ar":
            stops = [*titles(text, lang, head_end, following)[:1], *(m.start() for m in list(SECTION_FR.finditer(text, head_end, following))[:1])]
            cut = min([following, *stops])
        out.append((no, text[start:head_end].strip(), text[head_end:cut].strip(), start, preamble))
        preamble = None
        gap = text[cut:following]
        if gap.strip():
            annexes = [m.start() for m in ANNEX.finditer(gap)]
            for a, b in pairwise([*annexes, len(gap)]):
                stop = next((t - cut for t in titles(text, lang, cut + a + 6, cut + b)), b)
                part = gap[a:stop].strip()
                if len(part) > ANNEX_LEAST:
                    first = next((x.strip() for x in part.split("\n") if len(x.strip()) > 3), "(annexe)")
                    label = ANNEX.search(part)
                    out.append((label.group(1).strip() if label else "(annexe)", first, part, cut + a, None))
                    preamble = gap[stop:b].strip() or preamble
            if not annexes:
                preamble = gap.strip()
    return out


def oversized(text: str, most: int = MOST, refined: int = REFINED) -> list[str]:
    """Parts of a text over the limit: at its headings or lists if it has two; else at page breaks, headings, sentence ends, or at the
    limit; if that gives no more than two parts, those in equal lengths."""
    if len(text) <= most:
        return [text]
    cuts = sorted({m.start() for p in (HEADINGS, LISTED) for m in p.finditer(text)})
    if len(cuts) > 1:
        return [p for a, b in pairwise([0, *cuts, len(text)]) if (p := text[a:b].strip())]
    parts, rest = [], text
    while len(rest) > most:
        head = rest[:most]
        page = head.rfind("\f")
        caps = max((m.start() for m in re.finditer(r"\n(?:TITRE|CHAPITRE|SECTION|ANNEXE|APPENDICE)\b", head, re.IGNORECASE)), default=0)
        sentence = max(head.rfind(e) for e in (". ", ".\n", "!\n", "?\n"))
        at = page if page > most // 2 else caps if caps > 0 else sentence + 1 if sentence > most // 2 else most
        parts.append(rest[:at].strip())
        rest = rest[at:]
    parts.append(rest.strip())
    if len(parts) <= 2:
        parts = [p[i : i + refined].strip() for p in parts for i in range(0, len(p), refined)]
    return [p for p in parts if p]


ARTICLES = "doc_id string, lang string, article_idx int, number string, raw_header string, text string, start_pos int, preamble string"


def articles(issues: DataFrame) -> DataFrame:
    """The articles of issues (doc_id, lang, text), fragments merged and oversized ones split. A language but fr and ar is an error."""
    wrong = F.when(F.col("lang").isin("fr", "ar"), F.col("lang")).otherwise(F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce("lang", F.lit("null")))))

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (doc, lang, k, no, head, body, start, pre)
                for doc, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True)
                for k, (no, head, body, start, pre) in enumerate(article_rows(text, lang))
            ]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "article_idx", "number", "raw_header", "text", "start_pos", "preamble"])

    raw = issues.where("text IS NOT NULL").select("doc_id", wrong.alias("lang"), "text").mapInPandas(segment, ARTICLES)
    return split_oversized(merge_truncated(merge_fragments(raw)))


def is_stray(text: Column) -> Column:
    """A piece that is no article of its own: very short, or going on with a small letter or a digit."""
    return (F.length(text) < STRAY) | text.rlike(r"^[\p{Ll}0-9]")


def merge_fragments(rows: DataFrame) -> DataFrame:
    """Short stray articles joined to the one before, with their header; the preamble of what they join is lost."""
    order = Window.partitionBy("doc_id").orderBy("article_idx")
    stray = (F.length("text") < SHORT) & is_stray(F.col("text")) & (F.row_number().over(order) > 1)
    marked = rows.withColumn("own", F.sum((~stray).cast("int")).over(order)).withColumn("stray", stray)
    piece = F.when(F.col("stray"), F.concat_ws(" ", "raw_header", "text")).otherwise(F.col("text"))
    head = lambda c: F.min_by(c, "article_idx").alias(c)
    merged = marked.groupBy("doc_id", "lang", "own").agg(
        F.min("article_idx").alias("article_idx"), head("number"), head("raw_header"), head("start_pos"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_idx", piece.alias("t")))), lambda x: x["t"]), "\n")).alias("text"),
        F.when(F.count("*") == 1, F.min_by("preamble", "article_idx")).alias("preamble"),
    )
    return _numbered(merged)


def merge_truncated(rows: DataFrame) -> DataFrame:
    """Pairs of short articles joined where the first doesn't end a sentence and the second goes on with a small letter; in a run of
    such, every first with its second."""
    order = Window.partitionBy("doc_id").orderBy("article_idx")
    nxt = F.lead("text").over(order)
    fits = F.coalesce((F.length("text") < TRUNCATED) & (F.length(nxt) < TRUNCATED) & ~F.col("text").rlike(r"[.!?;]\s*$") & nxt.rlike(r"^\p{Ll}"), F.lit(False))
    marked = rows.withColumn("fits", fits)
    marked = marked.withColumn("run", F.sum((~F.col("fits")).cast("int")).over(order) - (~F.col("fits")).cast("int"))
    marked = marked.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("article_idx")))
    marked = marked.withColumn("takes", F.col("fits") & (F.col("k") % 2 == 1)).withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))
    joined = F.when(F.col("takes"), F.concat_ws("\n", "text", F.lead("text").over(order))).otherwise(F.col("text"))
    return _numbered(marked.withColumn("text", joined).where("NOT taken").drop("fits", "run", "k", "takes", "taken"))


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("article_idx")
    return rows.withColumn("article_idx", F.row_number().over(order) - 1).select("doc_id", "lang", "article_idx", "number", "raw_header", "text", "start_pos", "preamble")


def parts_of(text: Column, most: int = MOST, refined: int = REFINED) -> Column:
    """Parts of a text as an array; only oversized texts leave the JVM."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else oversized(t, most, refined) for t in texts], dtype=object)

    return F.when(F.length(text) > most, run(F.when(F.length(text) > most, text))).otherwise(F.array(text))


def split_oversized(rows: DataFrame) -> DataFrame:
    """Oversized articles in parts, numbered n, n-2, n-3 and so on; the header stays with the first."""
    parts = rows.select("*", F.posexplode(parts_of(F.col("text"))).alias("k", "part"))
    order = Window.partitionBy("doc_id").orderBy("article_idx", "k")
    return parts.select(
        "doc_id", "lang", (F.row_number().over(order) - 1).alias("article_idx"), F.when(F.col("k") == 0, F.col("number")).otherwise(F.concat("number", F.lit("-"), F.col("k") + 1)).alias("number"),
        F.when(F.col("k") == 0, F.col("raw_header")).otherwise("").alias("raw_header"), F.col("part").alias("text"), "start_pos", F.when(F.col("k") == 0, F.col("preamble")).alias("preamble"),
    )


@F.pandas_udf(StructType([StructField("preamble", StringType()), StructField("contents", StringType())]))
def fore_matter(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
    """What stands before the first article and after the contents list, and that list."""
    out = []
    for t, lang in zip(texts, langs, strict=True):
        if t is None:
            out.append((None, None))
            continue
        start, end = contents_end(t, lang)
        first = next((m[0] for m in markers(t, lang) if m[0] >= end), len(t))
        out.append((t[end:first].strip(), t[start:end].strip()))
    return pd.DataFrame(out, columns=["preamble", "contents"])


def decree_rows(text: str, lang: str) -> list[tuple[int, str, str, int]]:
    """(start, title, preamble, offset of the first article; -1 after the last) of each decree of an issue."""
    skip = contents_end(text, lang)[1]
    found = [m for m in markers(text, lang) if m[0] >= skip]
    out = []
    for low, high in pairwise([skip, *(m[0] for m in found)]):
        own = [t for t in titles(text, lang, low, high) if not ANNEX.match(text[t:].lstrip()[:10])]
        if own:
            start, end = own[0], own[1] if len(own) > 1 else high
            body = text[start:end].strip()
            if len(body) > DECREE_LEAST:
                out.append((start, body.split("\n")[0].strip(), body, high))
    if found:
        tail = [t for t in titles(text, lang, found[-1][1], len(text)) if not ANNEX.match(text[t:].lstrip()[:10])]
        for a, b in pairwise([*tail, len(text)]):
            body = text[a:b].strip()
            if len(body) > DECREE_TAIL:
                out.append((a, body.split("\n")[0].strip(), body, -1))
    return out


def decrees(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, decree_idx, title, preamble, first_article_idx); the index refers to the final articles by their offsets."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, k, *r[1:]) for d, lang, t in zip(batch["doc_id"], batch["lang"], batch["text"], strict=True) for k, r in enumerate(decree_rows(t, lang))]
            yield pd.DataFrame(out, columns=["doc_id", "decree_idx", "title", "preamble", "offset"])

    raw = issues.where("text IS NOT NULL").select("doc_id", "lang", "text").mapInPandas(find, "doc_id string, decree_idx int, title string, preamble string, offset int")
    first = rows.groupBy("doc_id", "start_pos").agg(F.min("article_idx").alias("at"))
    number = rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    joined = raw.join(first.withColumnRenamed("start_pos", "offset"), ["doc_id", "offset"], "left").join(number, "doc_id", "left")
    return joined.select("doc_id", "decree_idx", "title", "preamble", F.when(F.col("offset") == -1, F.coalesce("n", F.lit(0))).otherwise(F.col("at")).alias("first_article_idx"))


def article_number(header: Column, lang: Column) -> Column:
    """The number in an article's header; the header itself without one."""
    fr = F.regexp_extract(header, r"(?iU)(PREMIER|1er|UNIQUE|\d+(?:-\d+)?)", 1)
    ar = western_digits(F.regexp_extract(header, rf"(?:المادة|املادة)\s*([0-9٠-٩]+|{ORDINAL_AR})", 1))
    found = F.when(lang == "ar", ar).otherwise(fr)
    return F.when(found == "", strip(header)).otherwise(found)


def annex_label(gap: Column) -> Column:
    """Annex and number in the first annex line, else '(annexe)'."""
    found = strip(F.regexp_extract(gap, r"(?im)^(Annexe\s*\d*)", 1))
    return F.when(found == "", "(annexe)").otherwise(found)


def labelled_pieces(text: Column) -> Column:
    """The older splitter: pieces that each start with an article marker at a line start."""
    return F.filter(F.transform(F.split(text, r"(?imU)(?=^\s*ART(?:ICLE)?\.?\s*(?:PREMIER|1er|UNIQUE|\d))"), strip), lambda p: p != "")
