"""Exact vector search, guarded by a least score.

Queries are a block of vectors against all rows: partitions of the index come as Arrow batches, each task keeps the k best of
every query with one matrix product, and a window over k rows a task and query takes the best of all. What is broadcast is the
block, whose size is checked; more queries go in further blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import let

# Fixed values.
LEAST_SCORE, TOP, LEAST_INDEXED = 0.82, 5, 20
#: Most query vectors in a block.
BLOCK = 4096


def inner(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    return let(F.sqrt(inner(v, v)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))


def nearest(index: DataFrame, query: list[float], k: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows with the highest inner product with one vector, ties by key, best first. Rows without a vector have no score. Filters of
    the index (as by language) come before, so that k rows come out if there are."""
    scored = index.where(F.col(vector).isNotNull()).withColumn("score", inner(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy(F.desc("score"), key).limit(k)


def nearest_oversampled(index: DataFrame, query: list[float], wanted: Column, k: int = TOP, times: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As a search that filters afterwards: the best times x k rows, of which the first k wanted ones; may be fewer than k."""
    return nearest(index, query, k * times, key, vector).where(wanted).orderBy(F.desc("score"), key).limit(k)


def search(index: DataFrame, queries: DataFrame, k: int = TOP, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_id, rank, key, score) of the k best rows for every query vector, ties by key. Queries go in blocks of BLOCK vectors."""
    spark = index.sparkSession
    numbered = queries.select(F.col(query_key).cast("bigint").alias("q"), vector).where(F.col(vector).isNotNull())
    number = numbered.count()
    parts = max(1, -(-number // BLOCK))
    own = index.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("v IS NOT NULL")
    found: DataFrame | None = None
    for part in range(parts):
        block = numbered.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part) if parts > 1 else numbered
        rows = block.orderBy("q").limit(4 * BLOCK).collect()  # the block is bounded
        shared = spark.sparkContext.broadcast((np.array([r["q"] for r in rows], np.int64), np.array([r[vector] for r in rows], np.float64)))
        hits = own.mapInArrow(_best_of(shared, k), "query_id bigint, id bigint, score double")
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id"), "rank", F.col("id").alias(key), "score")


def _best_of(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best_s, best_i = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            v = np.stack(batch.column("v").to_pylist()).astype(np.float64)
            s = np.hstack([best_s, q @ v.T])
            i = np.hstack([best_i, np.tile(ids, (len(q), 1))])
            order = np.lexsort((i, -s), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        if best_s.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_s.shape[1])), pa.array(best_i.ravel()), pa.array(best_s.ravel())], names=["query_id", "id", "score"])

    return run


def guarded(hits: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Hits with a score high enough, in their order."""
    return hits.where(F.col("score") >= least)


def indexed(articles: DataFrame, embed: Callable[[Column], Column], text: str = "text", least: int = LEAST_INDEXED) -> DataFrame:
    """Articles long enough with their vector."""
    return articles.where(F.length(F.trim(text)) >= least).withColumn("embedding", embed(F.concat(F.lit("passage: "), F.col(text))))


def hash_embedding(dim: int = 64) -> Callable[[Column], Column]:
    """An embedder without a model: words hashed to signed places, at unit length. Role prefixes are words like others."""

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        # words of one place lie together once sorted by place, so each place is a slice
        placed = F.array_sort(F.transform(hashed, lambda x: F.struct(F.pmod(x, F.lit(dim)).cast("int").alias("p"), F.when(F.shiftright(x, 40) % 2 == 0, 1.0).otherwise(-1.0).alias("s"))))
        spots = F.sequence(F.lit(0), F.lit(dim - 1))
        raw = let(placed, lambda all_: F.transform(spots, lambda i: F.aggregate(F.filter(all_, lambda x: x["p"] == i), F.lit(0.0), lambda t, x: t + x["s"])))
        return let(raw, unit)

    return embed


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the distinct words of two texts, times 100; two empty texts share nothing."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"(?U)\s+"), lambda w: w != ""))
    return F.coalesce(F.try_divide(F.lit(100.0) * F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b))).cast("double")), F.lit(0.0))


def label_accuracy(hits: DataFrame, index: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(label, queries, accuracy): share of hits, without the query itself, that have the query's label."""
    side = index.select(F.col(key).alias("i"), F.col(label).alias("l"))
    own = hits.where(F.col("query_id") != F.col(key)).join(side.withColumnRenamed("i", key).withColumnRenamed("l", "hit"), key).join(side.withColumnRenamed("i", "query_id").withColumnRenamed("l", "own"), "query_id")
    return own.groupBy(F.col("own").alias(label)).agg(F.countDistinct("query_id").alias("queries"), F.round(F.avg((F.col("hit") == F.col("own")).cast("double")), 6).alias("accuracy"))
