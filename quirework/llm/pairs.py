"""Pairs of rows of a group whose stored texts differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that one task pairs with the group; a larger group is split into parts of about so many.
PART = 20_000


def differing_pairs(rows: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """(*keep, id_a, id_b), id_a < id_b, of rows with equal keys and different raw.

    rows: the key columns, id, raw. Groups of exact copies alone drop out before the join, by an aggregate with partial
    sums. The left rows of a large group are spread over parts by a hash, each of which meets all right rows of the group.
    """
    parts = F.ceil(F.count("*") / PART).cast("int")
    mixed = rows.groupBy(*key).agg(F.min("raw").alias("low"), F.max("raw").alias("high"), parts.alias("parts")).where("low <> high").select(*key, "parts")
    kept = rows.join(mixed, key).select(*key, "id", "raw", "parts")
    left = kept.select(*key, F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("id_a"), F.col("raw").alias("raw_a"))
    right = kept.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    return left.join(right, [*key, "part"]).where("id_a < id_b AND raw_a <> raw_b").select(*keep, "id_a", "id_b")
