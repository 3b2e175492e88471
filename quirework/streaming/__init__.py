"""The row-wise operators over files as they arrive. No event time, no state: each file is worked on by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes what the transformation makes of new rows; once: of those there are, then it ends. A restart goes on where it stopped."""
    writer = transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
