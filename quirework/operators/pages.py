"""Articles to pages: shared runs of characters, then a monotone walk.

A score is the share of the distinct runs of characters of the whole article that a page of its issue has. Articles and pages of
an issue meet in blocks of BLOCK by BLOCK, whose runs are counted by one matrix product; so a large issue spreads over many
tasks and a text is sent once a block, not once a pair. Only pages that a decision can depend on are kept. The walk goes from
article to article of one issue, in order, over its scored pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import replaced, strip

# Fixed values.
SIGNATURE, SHORT, GRAM, LONG = 40, 20, 4, 30
NEAR, NEAR_SHARE, LEAST_SHARE, LEAST, SECOND = 7, 0.9, 0.20, 3, 0.5


#: Articles, and pages, of a block.
BLOCK = 64


def flat(text: Column) -> Column:
    """Blanks single."""
    return strip(replaced(text, r"(?U)\s+", " "))


def run_numbers(texts: list[str]) -> list[np.ndarray]:
    """The distinct runs of GRAM = 4 characters of each text, in small letters, as numbers that texts of one call share."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) for t in low])
    if len(points) < GRAM:
        return [np.empty(0, np.int64) for _ in texts]
    twos = np.unique(points[:-1] << 32 | points[1:], return_inverse=True)[1]
    fours = np.unique(twos[:-2] << 32 | twos[2:], return_inverse=True)[1]
    return [np.unique(fours[e - len(t) : max(e - GRAM + 1, e - len(t))]) for t, e in zip(low, ends, strict=True)]


def shared_runs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many runs each of the left texts has in common with each of the right ones."""
    known = np.unique(np.concatenate([*left, np.empty(0, np.int64)]))

    def marks(side: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(side), len(known) + 1), np.float32)
        for row, own in zip(out, side, strict=True):
            row[np.searchsorted(known, own[np.isin(own, known, assume_unique=True)])] = 1
        return out

    return np.rint(marks(left) @ marks(right).T).astype(np.int64)


def printed_page(text: Column, page: Column) -> Column:
    """The printed number: the first lone number among the last characters, else the last anywhere, else the page's own."""
    lone = r"(?md)^[ \t]*([0-9]{1,4})[ \t]*$"
    tail = F.regexp_extract(F.right(text, F.lit(500)), lone, 1)
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(lone), F.lit(1)), F.lit(-1))
    return F.coalesce(F.when(tail != "", tail), last, page.cast("string")).cast("int")


PAIR = "doc_id string, article_idx int, page_number int, n int, score double, whole boolean, short boolean"
#: Pages below this share decide nothing: a near page needs NEAR_SHARE of a best one of LEAST_SHARE.
FLOOR = NEAR_SHARE * LEAST_SHARE


def _compared(articles: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one block."""
    long = [a if len(a[:SIGNATURE]) >= LONG else "" for a in articles["a"]]
    runs = run_numbers([*long, *side["p"]])
    own, theirs = runs[: len(long)], runs[len(long) :]
    both = shared_runs(own, theirs)
    out = []
    for i, (d, k, a) in enumerate(zip(articles["doc_id"], articles["article_idx"], articles["a"], strict=True)):
        n, sig = len(own[i]), a[:SIGNATURE]
        for j, (page, p) in enumerate(zip(side["page_number"], side["p"], strict=True)):
            whole, short = sig in p, sig[:SHORT] in p
            share = 0.0 if not n else 1.0 if whole else both[i, j] / n
            if share >= FLOOR or short:
                out.append((d, k, page, n, share, whole, short))
    return pd.DataFrame(out, columns=["doc_id", "article_idx", "page_number", "n", "score", "whole", "short"])


def page_pairs(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles and pages of their issue that share something: the number n of the article's runs and the score, both 0 where its
    signature is too short for them; whether the page has the signature (whole), and its beginning (short). Articles without text
    and pages without number or text pair with none."""
    own = articles.select("doc_id", "article_idx", flat(F.col("text")).alias("a"), F.floor(F.col("article_idx") / BLOCK).alias("ab")).where("a <> ''")
    side = pages.where("page_number IS NOT NULL AND text IS NOT NULL").select("doc_id", "page_number", F.translate("text", "\r\n", "  ").alias("p"), F.floor(F.col("page_number") / BLOCK).alias("pb"))
    block = [F.col("doc_id").alias("issue"), F.col("ab").alias("article_block"), F.col("pb").alias("page_block")]  # new columns, so that the sides differ
    left = own.join(side.select("doc_id", "pb").distinct(), "doc_id").select("doc_id", "article_idx", "a", *block)
    right = side.join(own.select("doc_id", "ab").distinct(), "doc_id").select("page_number", "p", *block)
    key = ["issue", "article_block", "page_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_compared, PAIR)


def page_scores(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, article_idx, page_number, n, score) of the pages that an article may stand on: 1 if the page has its signature, else the
    share of its runs there, from LEAST_SHARE on."""
    return page_pairs(articles, pages).where(F.col("score") >= LEAST_SHARE).select("doc_id", "article_idx", "page_number", "n", "score")


def article_pages(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, article_idx, pdf_page): pages never go back from article to article; a near page wins over a far one that is hardly
    better; what is short or finds none takes the next page with the beginning of its signature; what finds none in order is looked
    for on all pages at half its runs. Null where no page fits."""
    fields = F.struct("page_number", "score", "whole", "short")
    scores = page_pairs(articles, pages).groupBy("doc_id", "article_idx").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(fields)).alias("scores"))
    rows = articles.select("doc_id", "article_idx").join(scores, ["doc_id", "article_idx"], "left")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, last = None, 0
        for batch in batches:
            out = []
            for d, k, n, scores in zip(batch["doc_id"], batch["article_idx"], batch["n"], batch["scores"], strict=True):
                if d != doc:
                    doc, last = d, 0
                found = [(s["page_number"], s["score"]) for s in scores] if scores is not None and n else []
                low = max(1, last)
                ahead = [(p, s) for p, s in found if p >= low]
                best = max(ahead, key=lambda x: (x[1], -x[0]), default=None)
                page = None
                if best and best[1] * n >= max(LEAST, LEAST_SHARE * n):
                    near = max(((p, s) for p, s in ahead if p < low + NEAR), key=lambda x: (x[1], -x[0]), default=None)
                    page = near[0] if near and near[1] >= NEAR_SHARE * best[1] else best[0]
                if page is None and scores is not None:
                    page = min((s["page_number"] for s in scores if s["short"] and s["page_number"] >= low), default=None)
                last = page or last
                if page is None and found:
                    any_ = max(found, key=lambda x: (x[1], -x[0]))
                    first = min((s["page_number"] for s in scores if s["whole"]), default=any_[0])
                    page = first if any_[1] >= SECOND else None
                out.append((d, k, page))
            yield pd.DataFrame(out, columns=["doc_id", "article_idx", "pdf_page"]).astype({"pdf_page": "Int32"})

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "article_idx").mapInPandas(walk, "doc_id string, article_idx int, pdf_page int")


def coverage(mapped: DataFrame) -> DataFrame:
    """(doc_id, articles, coverage): share of articles with a page."""
    return mapped.groupBy("doc_id").agg(F.count("*").alias("articles"), F.round(F.avg(F.col("pdf_page").isNotNull().cast("double")), 6).alias("coverage"))
