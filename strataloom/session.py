"""The Spark session that the engine expects."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(master: str | None = None, **more: str) -> SparkSession:
    """A session with UTC and adaptive execution; local masters get few shuffle partitions."""
    builder = SparkSession.builder.config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
        if master.startswith("local") and "spark.sql.shuffle.partitions" not in more:
            builder = builder.config("spark.sql.shuffle.partitions", "8")
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only a local master gets a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="strataloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def dealt(rows: DataFrame, n: int, each: int, *keys: str) -> DataFrame:
    """rows by the hash of keys in as many tasks as n rows need with each in one, which adaptive execution leaves as they are: what
    a task holds of narrow rows is many times their bytes in a shuffle, by which it would put partitions together."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // each)), *keys)
