"""Positioned blocks of pages: filters, layout, reading order, bidirectional lines.

Reading order depends on the blocks of one page only. Pages come one after the other in sorted partitions and are ordered in
numpy; a page is a bounded thing, so no task holds more than one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.functions.text import arabic_letters, letters, strip

# Shares and points.
HEADER, FOOTER = 0.08, 0.06
WIDE, GAP_RATIO, GAP_LEAST, EACH_SIDE = 0.6, 3.0, 6.0, 2
FOOT_MARGIN, CONTENTS_MARGIN, BAND_GAP = 120.0, 12.0, 15.0
IN_TABLE, TWO_SIDED = 0.5, 0.35


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_number, x0, y0, x1, y1, text, page_height) outside the header and footer bands, with text."""
    inside = (F.col("y1") >= HEADER * F.col("page_height")) & (F.col("y0") <= (1 - FOOTER) * F.col("page_height"))
    return blocks.where(inside).withColumn("text", strip(F.col("text"))).where("text <> ''")


def outside_tables(blocks: DataFrame, boxes: DataFrame, share: float = IN_TABLE) -> DataFrame:
    """Blocks of which less than the given share of area lies in a table box (doc_id, page_number, bx0, by0, bx1, by1)."""
    wide = F.greatest(F.lit(0.0), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "by1") - F.greatest("y0", "by0"))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-6))
    b = boxes.select(F.col("doc_id").alias("b_doc"), F.col("page_number").alias("b_page"), "bx0", "by0", "bx1", "by1")
    return blocks.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("page_number") == F.col("b_page")) & (wide * high / area >= share), "left_anti")


def needs_ocr(pages: DataFrame, least: int = 300, share: float = 0.30) -> DataFrame:
    """Pages with the flag: fewer characters than the least, or than a share of the median of the document."""
    middle = pages.groupBy("doc_id").agg(F.percentile("char_count", F.lit(0.5)).alias("middle"))
    return pages.join(middle, "doc_id", "left").withColumn("needs_ocr", F.col("char_count") < F.greatest(F.lit(least), F.floor(share * F.col("middle")))).drop("middle")


def takes_ocr(native: Column, scanned: Column, flagged: Column, confidence: Column, gain: int = 100) -> Column:
    """Whether scanned text replaces native text, by numbers of characters."""
    return (scanned > native + gain) | (flagged & (confidence > 0.7) & (scanned > 0.5 * native))


def layout_type(blocks: DataFrame) -> DataFrame:
    """(doc_id, layout): 'colonnes' if both sides of the middle hold blocks enough and differ in their main script."""
    middle = blocks.groupBy("doc_id").agg(((F.min("x0") + F.max("x1")) / 2).alias("middle"))
    left = (F.col("x0") + F.col("x1")) / 2 < F.col("middle")
    n = lambda c, side: F.sum(F.when(side, c).otherwise(0))
    ar, all_ = arabic_letters(F.col("text")), letters(F.col("text"))
    sums = blocks.join(middle, "doc_id").groupBy("doc_id").agg(
        F.count_if(left).alias("nl"), F.count_if(~left).alias("nr"), n(ar, left).alias("al"), n(all_, left).alias("ll"), n(ar, ~left).alias("ar"), n(all_, ~left).alias("lr")
    )
    rl, rr = F.col("al") / F.greatest("ll", F.lit(1)), F.col("ar") / F.greatest("lr", F.lit(1))
    same = ((rl > 0.5) & (rr > 0.5)) | ((rl < 0.5) & (rr < 0.5))
    two = F.least("nl", "nr") / F.greatest("nl", "nr", F.lit(1)) > TWO_SIDED
    return sums.select("doc_id", F.when(two & ~same, "colonnes").otherwise("pleine_page").alias("layout"))


def bilingual_columns(blocks: DataFrame) -> DataFrame:
    """(doc_id, text_left, text_right): blocks left and right of the document's middle, by page and height."""
    middle = blocks.groupBy("doc_id").agg(((F.min("x0") + F.max("x1")) / 2).alias("middle"))
    joined = blocks.join(middle, "doc_id").withColumn("left", (F.col("x0") + F.col("x1")) / 2 < F.col("middle"))
    side = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(s, F.struct("page_number", "y0", "block_idx", "text")))), lambda x: x["text"]), "\n")
    return joined.groupBy("doc_id").agg(side(F.col("left")).alias("text_left"), side(~F.col("left")).alias("text_right"))


def gutter(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, gutter): middle of the widest gap between word centres in the middle of a page of twenty sure words; null
    if it is narrow. words: doc_id, page_number, x0, x1, confidence, page_width."""
    sure = words.where("confidence > 20").withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    number = sure.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"))
    band = sure.where((F.col("c") >= 0.3 * F.col("page_width")) & (F.col("c") <= 0.7 * F.col("page_width")))
    gaps = band.withColumn("before", F.lag("c").over(Window.partitionBy("doc_id", "page_number").orderBy("c"))).where("before IS NOT NULL")
    best = gaps.groupBy("doc_id", "page_number").agg(F.max_by(F.struct(((F.col("c") + F.col("before")) / 2).alias("at"), (F.col("c") - F.col("before")).alias("gap"), "page_width"), F.col("c") - F.col("before")).alias("b"))
    joined = number.join(best, ["doc_id", "page_number"], "left")
    return joined.select("doc_id", "page_number", F.when((F.col("n") >= 20) & (F.col("b.gap") >= 0.02 * F.col("b.page_width")), F.col("b.at")).alias("gutter"))


def bands(blocks: DataFrame) -> DataFrame:
    """Blocks with the horizontal band they lie in; a wide gap above starts a new one."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("y0", "block_idx")
    new = F.coalesce(F.col("y0") - F.lag("y1").over(order) > BAND_GAP, F.lit(True))
    return blocks.withColumn("band", F.sum(new.cast("int")).over(order))


def ocr_settings(lang: Column, width: Column, height: Column) -> Column:
    """struct(dpi, psm, engine): finer for small pages, one column of text for a language by itself."""
    size = F.greatest(width, height)
    dpi = F.when(size < 500, 400).when(size < 800, 350).when(size < 1200, 300).otherwise(200)
    return F.struct(dpi.alias("dpi"), F.when(lang == "ar", 6).otherwise(3).alias("psm"), F.when(lang == "ar", "ara").when(lang == "fr", "fra").otherwise("fra+ara").alias("engine"))


@dataclass
class Block:
    """A block of a page with its place in the input."""

    x0: float
    y0: float
    x1: float
    y1: float
    text: str
    at: int

    @property
    def middle(self) -> float:
        return (self.x0 + self.x1) / 2


def widest_band(blocks: list[Block]) -> tuple[float, float] | None:
    """The widest vertical strip that no block touches, with whole blocks on both sides."""
    free, reach = [], None
    for b in sorted(blocks, key=lambda b: b.x0):
        if reach is not None and b.x0 > reach:
            free.append((reach, b.x0))
        reach = b.x1 if reach is None else max(reach, b.x1)
    fit = [(a, z) for a, z in free if sum(b.x1 <= a for b in blocks) >= EACH_SIDE and sum(b.x0 >= z for b in blocks) >= EACH_SIDE]
    return max(fit, key=lambda s: s[1] - s[0], default=None)


def decorative(text: str) -> bool:
    """An asterisk, or a short signature in capitals with a full stop."""
    plain = "".join(text.split())
    return "*" in plain or (plain.endswith(".") and len(plain) <= 40 and all(c.isupper() or c in ".-'/," for c in plain))


def column_line(blocks: list[Block]) -> tuple[float | None, bool]:
    """Where two columns part, and whether an empty strip shows it."""
    by_x = sorted(blocks, key=lambda b: b.x0)
    gaps = [b.x0 - a.x1 for a, b in zip(by_x, by_x[1:], strict=False)]
    least = max(GAP_LEAST, (median(gaps) if gaps else 0.0) * GAP_RATIO)
    strip_ = widest_band(blocks)
    if strip_ and strip_[1] - strip_[0] >= least:
        return sum(strip_) / 2, True
    limit = max(b.y1 for b in blocks) - FOOT_MARGIN
    strip_ = widest_band([b for b in blocks if b.y0 < limit])
    if strip_ and strip_[1] - strip_[0] >= least and any(b.x0 < sum(strip_) / 2 < b.x1 and decorative(b.text) for b in blocks if b.y0 >= limit):
        return sum(strip_) / 2, True
    options = []
    for k, gap in enumerate(gaps):
        at = (by_x[k].x1 + by_x[k + 1].x0) / 2
        if gap >= least and sum(b.x1 <= at for b in blocks) >= EACH_SIDE and sum(b.x0 >= at for b in blocks) >= EACH_SIDE:
            options.append((gap, k, at))
    return (max(options)[2], False) if options else (None, False)


def reading_order(blocks: list[Block]) -> list[Block]:
    """Blocks of a page as they are read: columns one after the other (the right one first on Arabic pages), wide blocks at their height."""
    down = lambda bs: sorted(bs, key=lambda b: (b.y0, b.x0))
    if not blocks:
        return []
    width = max(b.x1 for b in blocks) - min(b.x0 for b in blocks)
    wide = [b for b in blocks if b.x1 - b.x0 > WIDE * width]
    narrow = [b for b in blocks if b.x1 - b.x0 <= WIDE * width]
    if not narrow or sum(len(b.text) for b in wide) >= sum(len(b.text) for b in narrow):
        return down(blocks)
    at, empty = column_line(narrow) if len(narrow) > 1 else (None, False)
    if at is None:
        return down(blocks)
    left, right = [b for b in narrow if b.middle < at], [b for b in narrow if b.middle >= at]
    line = at
    if not empty and left and right:
        edge = max(b.x1 for b in left)
        line = (edge + min((b.x0 for b in right if b.x0 >= edge), default=edge)) / 2
    across = [b for b in narrow if b.x0 < line < b.x1]
    columns = [c for c in ([b for b in side if b not in across] for side in (left, right)) if c]
    if len(columns) < 2:
        return down(blocks)
    text = "".join(b.text for b in blocks)
    if sum("؀" <= c <= "ۿ" for c in text) > 0.3 * len(text):
        columns.reverse()
    waiting, out = sorted([*wide, *across], key=lambda b: b.y0), []
    for column in columns:
        for b in sorted(column, key=lambda b: b.y0):
            while waiting and waiting[0].y0 < b.y0:
                out.append(waiting.pop(0))
            out.append(b)
    return out + waiting


def page_order(blocks: list[Block]) -> list[Block]:
    """Reading order; a page with a contents list is read from the top, then the list by itself."""
    head = next((b for b in blocks if b.text.strip().startswith("SOMMAIRE") and len(b.text.strip()) < 20), None)
    if head is None:
        return reading_order(blocks)
    low = [b for b in blocks if b.y0 >= head.y0 - CONTENTS_MARGIN]
    return sorted([b for b in blocks if b.y0 < head.y0 - CONTENTS_MARGIN], key=lambda b: (b.y0, b.x0)) + reading_order(low)


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, block_idx, position) of each block; null boxes count as 0."""

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def flush() -> list[tuple]:
            return [(*key, b.at, k) for k, b in enumerate(page_order(held))] if held else []

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.doc_id, r.page_number) != key:
                    out += flush()
                    key, held = (r.doc_id, r.page_number), []
                held.append(Block(r.x0, r.y0, r.x1, r.y1, r.text, r.block_idx))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "block_idx", "position"])
        yield pd.DataFrame(flush(), columns=["doc_id", "page_number", "block_idx", "position"])

    own = blocks.select("doc_id", "page_number", "block_idx", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")], F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("doc_id", "page_number").sortWithinPartitions("doc_id", "page_number", "block_idx").mapInPandas(order, "doc_id string, page_number int, block_idx int, position int")


MIRROR = str.maketrans("()[]{}«»<>", ")(][}{»«><")


def _rtl(c: str) -> bool:
    return "֐" <= c <= "ࣿ" and c.isalpha() or "ﭐ" <= c <= "ﻼ"


def _ltr(c: str) -> bool:
    return c.isalpha() and not _rtl(c)


def _runs(chars: str) -> list[str]:
    out: list[str] = []
    for c in chars:
        if out and _rtl(out[-1][-1]) == _rtl(c):
            out[-1] += c
        else:
            out.append(c)
    return out


def _turned(chars: str, mirror: bool) -> str:
    """Reversed, numbers kept in their order."""
    import re

    back = chars[::-1].translate(MIRROR) if mirror else chars[::-1]
    return re.sub(r"\d[\d.,]*", lambda m: m.group()[::-1], back)


def logical_line(chars: list[tuple[str, float]]) -> str:
    """A line from its characters and their places, in the order in which it is read."""
    text = "".join(c for c, _ in sorted(chars, key=lambda c: c[1]))
    strong = next((c for c in text if _rtl(c) or _ltr(c)), "")
    runs = _runs(text)
    if not strong:
        return text
    if _rtl(strong) and sum(map(_rtl, text)) >= sum(map(_ltr, text)):
        return "".join(r[::-1] if _rtl(r[0]) else r if any(map(_ltr, r)) else _turned(r, False) for r in reversed(runs))
    out, k = [], 0
    while k < len(runs):
        if not _rtl(runs[k][0]):
            out.append(runs[k])
            k += 1
            continue
        end = k
        while end + 2 < len(runs) and not any(map(_ltr, runs[end + 1])):
            end += 2
        out.append(_turned("".join(runs[k : end + 1]), True))
        k = end + 1
    return "".join(out)


@F.pandas_udf(StringType())
def reading_line(chars: pd.Series) -> pd.Series:
    """A line from an array of struct(c, x0)."""
    return pd.Series([None if line is None else logical_line([(c["c"], c["x0"]) for c in line]) for line in chars], dtype=object)


#: Points between the middles of boxes of one scanned line, and the least confidence of a box.
LINE_GAP, LEAST_BOX = 25.0, 0.3


def scan_lines(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, x0, y0, x1, y1, boxes) of scanned boxes (doc_id, page_number, x0, y0, x1, y1, confidence): boxes whose middles
    follow each other within LINE_GAP from top to bottom make a line. Boxes of low or no confidence don't count."""
    kept = boxes.where(F.col("confidence") >= LEAST_BOX).withColumn("middle", (F.col("y0") + F.col("y1")) / 2)
    order = Window.partitionBy("doc_id", "page_number").orderBy("middle")
    new = F.coalesce(F.col("middle") - F.lag("middle").over(order) > LINE_GAP, F.lit(True)).cast("int")
    marked = kept.withColumn("new", new).withColumn("line_no", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)) - 1)
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("boxes")]
    return marked.groupBy("doc_id", "page_number", F.col("line_no").cast("int").alias("line_no")).agg(*edges)
