"""Filling containers of fixed capacity with whole texts.

The histogram of sizes has at most as many rows as the capacity, whatever the number of texts. Dynamic programming over
it chooses length buckets that minimise padding (the difference of each size to the upper end of its bucket). Batches
form inside each bucket by token budget: as many of its items as the capacity takes. With top_up, the room that a batch leaves
(one item of over half the capacity would leave up to half of it) goes to the largest smaller bucket that fits, and so on;
this is counted out on the histogram, so that a plan is a short list of patterns with multiplicities. Without top_up, batches
stay strictly inside their buckets. Items then find their container by their rank in the bucket; a bucket is ranked in slices, so
no task gets a whole bucket.

A text over the capacity is cut into full containers and one rest. Null and empty texts take no room and get no container
(null). Rows with equal sizes are interchangeable; their order is a hash of their key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.tokens import TOKENIZER, token_count
from quirework.sources.tables import cut, spread, table

CAPACITY = 2048
BUCKETS = 192
#: Slices of a bucket for ranking: at least so many, and more so that a slice of the fullest bucket holds about SLICE_ROWS rows.
SLICES = 64
SLICE_ROWS = 2_000_000
#: Most offsets, one for each bucket and slice, that are broadcast; more are joined.
MOST_OFFSETS = 200_000


def bucket_ends(sizes: np.ndarray, counts: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """Upper ends of at most so many buckets of ascending sizes, with the least padding."""
    n = len(sizes)
    if n <= most:
        return sizes.copy()
    number = np.concatenate([[0.0], np.cumsum(counts.astype(float))])
    volume = np.concatenate([[0.0], np.cumsum(counts.astype(float) * sizes)])
    # cost[i, j]: padding of a bucket with sizes i .. j
    cost = sizes[None, :] * (number[1:][None, :] - number[:-1][:, None]) - (volume[1:][None, :] - volume[:-1][:, None])
    cost[np.tril_indices(n, -1)] = np.inf
    best, choice = cost[0].copy(), []
    for _ in range(most - 1):
        total = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        at = total.argmin(axis=0)
        choice.append(at)
        best = total[at, np.arange(n)]
    ends, j = [], n - 1
    for at in reversed(choice):
        ends.append(j)
        j = int(at[j]) - 1
        if j < 0:
            break
    if j >= 0:
        ends.append(j)
    return sizes[sorted(set(ends))]


def fill_plan(ends: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, top_up: bool = True) -> list[tuple[int, dict[int, int]]]:
    """Patterns (multiplicity, items by bucket): batches inside the largest bucket left, topped up by the largest that fit."""
    left = counts.astype(int).tolist()
    plan: list[tuple[int, dict[int, int]]] = []
    for k in range(len(ends) - 1, -1, -1):
        while left[k]:
            room, pattern, j = capacity, {}, k
            while j >= 0 and room:
                fits = min(room // int(ends[j]), left[j])
                if fits:
                    pattern[j] = fits
                    room -= fits * int(ends[j])
                j = min(j - 1, int(np.searchsorted(ends, room, "right")) - 1) if top_up else -1
            times = min(left[b] // c for b, c in pattern.items())
            for b, c in pattern.items():
                left[b] -= c * times
            plan.append((times, pattern))
    return plan


def items_of(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece_no, tokens): whole texts, and the pieces of those over the capacity."""
    sized = spread(documents.select("doc_id", "text")).select("doc_id", token_count(F.col("text"), tokenizer).alias("size"))
    pieces = F.when(F.col("size") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / capacity).cast("bigint")), lambda k: F.least(F.lit(capacity).cast("bigint"), F.col("size") - k * capacity))
    )
    return sized.select("doc_id", F.posexplode(pieces).alias("piece_no", "tokens"))


def pack(items: DataFrame, key: list[str], capacity: int = CAPACITY, buckets: int = BUCKETS, top_up: bool = True) -> DataFrame:
    """(*key, tokens, bucket, container_id) of each item; bucket is the upper end of its bucket."""
    items = cut(items.select(*key, "tokens"))
    histogram = items.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).orderBy("tokens").limit(capacity + 1).collect()
    sizes, counts = np.array([r["tokens"] for r in histogram], int), np.array([r["n"] for r in histogram], int)
    if len(sizes) and sizes[-1] > capacity:
        raise ValueError("an item is larger than a container")
    ends = bucket_ends(sizes, counts, buckets) if len(sizes) else np.array([capacity])
    of = np.searchsorted(ends, sizes)
    plan = fill_plan(ends, np.bincount(of, weights=counts, minlength=len(ends)).astype(int), capacity, top_up) if len(sizes) else []
    # for each bucket: the first rank, first container and items a container of each pattern
    starts: dict[int, list[tuple[int, int, int]]] = {}
    used, container = dict.fromkeys(range(len(ends)), 0), 0
    for times, pattern in plan:
        for b, c in pattern.items():
            starts.setdefault(b, []).append((used[b], container, c))
            used[b] += c * times
        container += times
    shared = items.sparkSession.sparkContext.broadcast((ends, {b: np.array(v) for b, v in starts.items()}))

    @F.pandas_udf("int")
    def bucket_of(tokens: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value[0], tokens).astype("int32"))

    @F.pandas_udf("bigint")
    def container_of(bucket: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(bucket), np.int64)
        own, ranks = bucket.to_numpy(), rank.to_numpy()
        for b in np.unique(own):
            at, rows = shared.value[1][int(b)], np.flatnonzero(own == b)
            k = np.searchsorted(at[:, 0], ranks[rows], "right") - 1
            out[rows] = at[k, 1] + (ranks[rows] - at[k, 0]) // at[k, 2]
        return pd.Series(out)

    slices = max(SLICES, int(counts.max()) // SLICE_ROWS + 1) if len(counts) else SLICES
    placed = items.where("tokens > 0").withColumn("b", bucket_of("tokens")).withColumn("slice", F.pmod(F.xxhash64(*key), F.lit(slices)))
    offsets = placed.groupBy("b", "slice").agg(F.count("*").alias("n"))
    offsets = offsets.select("b", "slice", (F.sum("n").over(Window.partitionBy("b").orderBy("slice")) - F.col("n")).alias("offset"))  # a row for each slice
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("b", "slice").orderBy(F.desc("tokens"), *key)))
    ranked = ranked.join(F.broadcast(offsets) if len(ends) * slices <= MOST_OFFSETS else offsets, ["b", "slice"]).withColumn("rank", F.col("offset") + F.col("k") - 1)
    named = F.create_map(*[F.lit(x) for k, e in enumerate(ends) for x in (k, int(e))])
    done = ranked.select(*key, "tokens", named[F.col("b")].alias("bucket"), container_of("b", "rank").alias("container_id"))
    none = items.where("tokens = 0 OR tokens IS NULL").select(*key, "tokens", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("bigint").alias("container_id"))
    return done.unionByName(none)


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each text, or piece of an oversized one, with its container of 2 048 tokens."""
    return pack(items_of(table(spark, folder, "documents")), ["doc_id", "piece_no"])


def _fill(placed: DataFrame) -> DataFrame:
    per = placed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return per.groupBy("items").agg(F.count("*").alias("containers"), F.round(F.avg(F.col("tokens") / CAPACITY), 6).alias("used"), F.max("tokens").alias("fullest"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how many items they hold, with the share of room used."""
    return _fill(p8_containers(spark, folder))


def p8_inside(spark: SparkSession, folder: str) -> DataFrame:
    """The same for batches strictly inside their buckets."""
    return _fill(pack(items_of(table(spark, folder, "documents")), ["doc_id", "piece_no"], top_up=False))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_inside": p8_inside}
SQL: dict[str, str] = {}
