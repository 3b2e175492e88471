"""Parquet tables of a data folder, and the folder for cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Rows of a scan over all cores. A scan of few small files has fewer partitions than there are cores, which leaves most of them idle
    while rows are worked on one by one; only such a frame is shuffled. For frames that are scans, before any shuffle."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    few = frame._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return frame.repartition(cores) if few else frame


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where none is set and the master is local.

    On a cluster without a shared folder this raises, because a machine-local folder loses data with its machine.
    """
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quirework-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame, eager: bool = True) -> DataFrame:
    """The frame read back from the checkpoint folder, so that its plan starts there."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager)
