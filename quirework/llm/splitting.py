"""Splitting oversized texts at natural boundaries.

Every position where a text may be cut has a boundary strength. A sparse table over these positions answers, for any
window, which cut is the strongest, the rightmost one among equals. A piece ends at the strongest cut in its window of
permissible lengths; the next piece starts about ``overlap`` characters before that cut, again at the strongest cut near.

Results for odd input: null stays null (no pieces), an empty or short text is one piece, a window without any boundary
is cut at its limit, but never before a combining mark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quirework.sources.tables import spread, table

LIMIT = 5000
OVERLAP = 200

PIECES = ArrayType(
    StructType(
        [
            StructField("piece_no", IntegerType()),
            StructField("start_pos", IntegerType()),
            StructField("end_pos", IntegerType()),
            StructField("strength", IntegerType()),
            StructField("piece", StringType()),
        ]
    )
)

#: A text may be cut at the end of a run of blanks. Strengths: 1 blank, 2 comma, 3 semicolon, colon or dash, 4 sentence, 5 line,
#: 6 paragraph or page, 7 heading. Each run is looked at once, so the time is in proportion to the text whatever it holds.
RUN = re.compile(r"\s+")
LINE_END = re.compile(r"\r\n?|\n")
COMMA, STOP, DASH, SENTENCE, CLOSERS = ",،", ";:؛", "–—", ".!?؟…", "»\"')]"
HEADING = re.compile(
    r"(?:titre|chapitre|section|sous-section|annexe|article|art\.)\s+\S|(?:الباب|الفرع|القسم|المادة|ملحق)\s",
    re.IGNORECASE,
)
#: A full stop after these doesn't end a sentence.
ABBREVIATION = re.compile(r"(?:^|[\s(«'’])(?:art|al|cf|m|mm|mme|mlle|me|dr|pr|n|no|st|ste|sté|p|pp|vol|éd|etc|\w)\.$", re.IGNORECASE)


def _strength(text: str, start: int, end: int) -> int:
    """Strength of the cut after the run of blanks from start to end."""
    if end - start > 1 or text[start] in "\r\n\f":
        lines = sum(1 for _ in LINE_END.finditer(text, start, end))
        page = text.find("\f", start, end) >= 0
        if lines or page:
            return 7 if HEADING.match(text, end) else 6 if lines > 1 or page else 5
    if not start:
        return 1
    at = start - 1
    while at and text[at] in CLOSERS:
        at -= 1
    if text[at] in SENTENCE and not ABBREVIATION.search(text[max(0, at - 8) : at + 1]):
        return 4
    before = text[start - 1]
    return 3 if before in STOP or (before in DASH and text[start - 2 : start - 1].isspace()) else 2 if before in COMMA else 1


def boundary_strengths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the text may be cut, ascending, and their strengths."""
    at = [m.span() for m in RUN.finditer(text) if m.end() < len(text)]
    strengths = [_strength(text, a, b) for a, b in at]
    return np.array([b for _, b in at], dtype=np.int64), np.array(strengths, dtype=np.int64)


class StrongestCut:
    """Sparse table: the index of the strongest, then rightmost, position of each run of 2^k positions."""

    def __init__(self, positions: np.ndarray, strengths: np.ndarray, widest: int):
        self.positions, self.strengths = positions, strengths
        self.levels = [np.arange(len(positions))]
        width = 1
        while 2 * width <= min(len(positions), widest):
            last = self.levels[-1]
            left, right = last[:-width], last[width:]
            self.levels.append(np.where(strengths[right] >= strengths[left], right, left))
            width *= 2

    def query(self, low: int, high: int) -> int | None:
        """The strongest cut with low <= position <= high, the rightmost among equals."""
        i = int(np.searchsorted(self.positions, low, "left"))
        j = int(np.searchsorted(self.positions, high, "right"))
        if i >= j:
            return None
        k = min((j - i).bit_length() - 1, len(self.levels) - 1)
        a, b = int(self.levels[k][i]), int(self.levels[k][j - (1 << k)])
        return b if self.strengths[b] >= self.strengths[a] else a


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Start, end and the strength of the cut at the end, of each piece."""
    if not 0 <= 3 * overlap < limit:
        raise ValueError("the overlap must be less than a third of the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    table_ = StrongestCut(*boundary_strengths(text), widest=limit)
    pieces, start, slack = [], 0, overlap // 4
    while len(text) - start > limit:
        found = table_.query(start + limit // 2, start + limit)
        if found is None:
            end, strength = start + limit, 0
            while end > start + limit // 2 and unicodedata.combining(text[end]):
                end -= 1
        else:
            end, strength = int(table_.positions[found]), int(table_.strengths[found])
        pieces.append((start, end, strength))
        if not overlap:
            start = end
            continue
        back = table_.query(end - overlap - slack, end - overlap + slack)
        start = end - overlap if back is None else int(table_.positions[back])
    pieces.append((start, len(text), 0))
    return pieces


def _pieces_udf(limit: int, overlap: int):
    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [
                    None if t is None else [(k, a, b, s, t[a:b]) for k, (a, b, s) in enumerate(split_text(t, limit, overlap))]
                    for t in texts
                ],
                dtype=object,
            )

    return pieces


def pieces_of(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of pieces of a text column. Only texts over the limit leave the JVM."""
    long = _pieces_udf(limit, overlap)(F.when(F.length(text) > limit, text))
    whole = F.array(
        F.struct(
            F.lit(0).alias("piece_no"),
            F.lit(0).alias("start_pos"),
            F.length(text).alias("end_pos"),
            F.lit(0).alias("strength"),
            text.alias("piece"),
        )
    )
    return F.when(text.isNull(), F.lit(None).cast(PIECES)).when(F.length(text) > limit, long).otherwise(whole.cast(PIECES))


def split_rows(frame: DataFrame, tbl: str, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(tbl, row_id, pieces) of each row of a table; other columns of the frame don't matter."""
    own = spread(frame.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("whole")))
    return own.select(F.lit(tbl).alias("tbl"), "row_id", pieces_of(F.col("whole"), limit, overlap).alias("pieces"))


def all_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, row_id, pieces) of articles and segments."""
    return split_rows(table(spark, folder, "articles"), "articles", "id", "raw_text").unionByName(
        split_rows(table(spark, folder, "segments"), "segments", "seg_id", "text")
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that the splitter had to cut."""
    return all_pieces(spark, folder).where(F.size("pieces") > 1).select("tbl", "row_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every row, with its place in the text."""
    return all_pieces(spark, folder).select("tbl", "row_id", F.inline("pieces"))


def p1_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every row put together from its pieces again: its digest, the longest piece, and whether every overlap is about OVERLAP characters."""
    pieces = F.col("pieces")
    overlap = lambda x, i: pieces[i - 1]["end_pos"] - x["start_pos"]
    own = F.transform(pieces, lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], overlap(x, i) + 1, F.lit(2**31 - 1))))
    near = F.forall(F.transform(pieces, lambda x, i: (i == 0) | overlap(x, i).between(OVERLAP - OVERLAP // 4, OVERLAP + OVERLAP // 4)), lambda x: x)
    longest = F.array_max(F.transform(pieces, lambda x: F.length(x["piece"])))
    rows = all_pieces(spark, folder).where("pieces IS NOT NULL")
    return rows.select("tbl", "row_id", F.md5(F.array_join(own, "")).alias("digest"), (longest <= LIMIT).alias("within"), near.alias("overlapping"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rebuilt": p1_rebuilt}
SQL = {
    "p1_rebuilt": """
        SELECT 'articles' AS tbl, id AS row_id, md5(raw_text) AS digest, true AS within, true AS overlapping FROM articles WHERE raw_text IS NOT NULL
        UNION ALL SELECT 'segments', seg_id, md5(text), true, true FROM segments WHERE text IS NOT NULL
    """,
    "p1_found": """
        SELECT 'articles' AS tbl, id AS row_id FROM articles WHERE length(raw_text) > 5000
        UNION ALL SELECT 'segments', seg_id FROM segments WHERE length(text) > 5000
    """,
}
