"""Lines of the page frame: running titles, headers, footers, page numbers.

A line's form masks numbers and folds letters that scanners confuse. Frame forms recur, and where a page has enough
lines they stand at its edges nearly always; forms of the text stand anywhere. Forms on a share of all pages are collected;
there are at most (lines per page / share) of them whatever the number of pages. Rarer ones, such as the running title of one
bulletin, go to the pages of each bulletin at whose edges they stand on a share of its pages: these stay distributed, and a
bulletin has at most (edge lines per page / share) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.sources.tables import cut

#: A form must occur this often; on this share of all pages it counts for all, else for the bulletins on this share of whose pages (and
#: on this many) it stands at the edge.
LEAST_COUNT = 4
LEAST_SHARE = 2e-4
LOCAL_SHARE = 0.3
LOCAL_COUNT = 3
#: Share of a frame form's lines that stand among the first or last EDGE lines of pages with more than 3 x EDGE lines.
EDGE_SHARE = 0.75
EDGE = 2
#: A line of the text may end a sentence, one of the frame doesn't.
SENTENCE_END = "[.;:!?,؟؛،]$"

#: Letters and what they fold to.
FOLD_FROM = "àâäáãéèêëíîïìóôöòõúûüùçñ" + "0oil|1!5ɑ" + "أإآىةک"
FOLD_TO = "aaaaaeeeeiiiiooooouuuucn" + "ooiiiiisa" + "ااايهك"


def form(line: Column) -> Column:
    """The form of a line: numbers masked, confusable letters folded, blanks single."""
    text = F.lower(F.trim(F.regexp_replace(line, r"[\s\x{A0}\x{2000}-\x{200B}]+", " ")))
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}])[0-9٠-٩oil|]*[0-9٠-٩][0-9٠-٩oil|]*(?![\p{L}\p{N}])", "#")
    return F.translate(text, FOLD_FROM, FOLD_TO)


def lines_of(text: Column) -> Column:
    """The lines of a page."""
    return F.split(text, "\n", -1)


def _edged(text: str) -> Column:
    """The form of each line with text, and whether it stands among the first or last EDGE lines; null where a page has too few lines to tell.
    What ends like a sentence has no form."""
    kept = F.filter(lines_of(F.col(text)), lambda x: F.trim(x) != "")
    n = F.size(kept)
    placed = F.transform(kept, lambda x, i: F.struct(x.alias("line"), F.when(n > 3 * EDGE, (i < EDGE) | (i >= n - EDGE)).alias("edge")))
    return F.filter(placed, lambda x: ~F.rtrim(x["line"]).rlike(SENTENCE_END))


def frame_forms(pages: DataFrame, text: str = "text") -> DataFrame:
    """(form, n) of the frame lines of these pages, whatever their share."""
    counted = (
        pages.where(F.col(text).isNotNull())
        .select(F.explode(_edged(text)).alias("x"))
        .groupBy(form(F.col("x.line")).alias("form"))
        .agg(F.count("*").alias("n"), F.count("x.edge").alias("judged"), F.sum(F.col("x.edge").cast("int")).alias("edge"))
        .where(F.col("n") >= LEAST_COUNT)
    )
    # a lower bound of the edge share, so that a few lines by chance at edges don't make a frame
    low = F.col("edge") / F.col("judged") - 0.5 / F.sqrt("judged")
    fit = (F.col("judged") > 0) & (low >= EDGE_SHARE - 0.1) & (F.col("edge") >= EDGE_SHARE * F.col("judged"))
    return counted.where(fit & ~F.col("form").rlike(SENTENCE_END)).select("form", "n")


def local_forms(pages: DataFrame, rare: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, local): of the rare frame forms, those that stand at the edges of enough pages of a bulletin."""
    own = pages.where(F.col(text).isNotNull() & F.col("doc_id").isNotNull())
    edges = F.array_distinct(F.transform(F.filter(_edged(text), lambda x: x["edge"]), lambda x: form(x["line"])))
    standing = own.select("doc_id", F.explode(edges).alias("form")).groupBy("doc_id", "form").agg(F.count("*").alias("k")).where(F.col("k") >= LOCAL_COUNT)
    size = own.groupBy("doc_id").agg(F.count("*").alias("pages"))
    found = standing.join(rare.select("form"), "form").join(size, "doc_id").where(F.col("k") >= LOCAL_SHARE * F.col("pages"))
    return found.groupBy("doc_id").agg(F.collect_set("form").alias("local"))


def forms_of(pages: DataFrame, text: str = "text", bound: int = 200_000) -> tuple[frozenset[str], DataFrame]:
    """The forms that count for all pages, refused beyond the bound that LEAST_SHARE implies, and those of single bulletins (doc_id, local)."""
    found = cut(frame_forms(pages, text))
    floor = LEAST_SHARE * pages.where(F.col(text).isNotNull()).count()
    rows = found.where(F.col("n") >= floor).select("form").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} frame forms: pages with far too many lines")
    return frozenset(r[0] for r in rows), cut(local_forms(pages, found.where(F.col("n") < floor), text))


def with_forms(pages: DataFrame, local: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Pages with the form of each line (forms) and the frame forms of their bulletin (local)."""
    none = F.array().cast("array<string>")
    own = pages.withColumn("forms", F.transform(lines_of(F.col(text)), form))
    return own.withColumn("local", none) if local is None else own.join(local, "doc_id", "left").withColumn("local", F.coalesce("local", none))


def marks(forms: list[str], common: frozenset[str], local: list[str]) -> list[bool]:
    """Whether each line of a page, by its form, is one of the frame."""
    here = set(local)
    return [f in common or f in here for f in forms]
