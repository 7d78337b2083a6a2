"""Streams run to the end of what is there, with SQL over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import jobs
from .registry import query


def _finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The rows that a stream gives until it has read all there is, kept in the shared folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    out = f"{base}/out"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/micro={n}")

    run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).select(*stream.columns)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    got = _finished(spark, jobs.windowed_counts(jobs.event_stream(spark, f"{d}/events.parque[t]")), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query('SELECT event_type AS trigger, count(*) AS fires, sum((value > 50)::INT)::BIGINT AS "references" FROM events GROUP BY 1')
def stream_trigger_counters(spark: SparkSession, d: str) -> DataFrame:
    fires = jobs.event_stream(spark, f"{d}/events.parque[t]").select(F.col("event_type").alias("trigger"), (F.col("value") > 50).alias("referenced"))
    return _finished(spark, jobs.fire_counters(fires), "complete")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_distinct_events(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, jobs.distinct_events(jobs.event_stream(spark, f"{d}/events.parque[t]")).select("event_id", "user_id", "event_type"), "append")
