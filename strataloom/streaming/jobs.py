"""Streams: chat turns in batches by count or time, incremental counters, windows with watermarks, replication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import TURN_LINES, conversation_turns

BATCHES = "session_id STRING, batch INT, n INT, first_ts STRING, last_ts STRING, text STRING, batch_key STRING"
STATE = "batch INT, turns ARRAY<STRUCT<content: STRING, timestamp: STRING>>"


def turn_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New chat lines of folder/*/*.jsonl as turns; what was read is in the checkpoint, not in a state file of its own."""
    lines = spark.readStream.schema(TURN_LINES).option("maxFilesPerTrigger", files_per_trigger).json(f"{folder}/*/*.jsonl")
    return conversation_turns(lines)


def turn_batches(turns: DataFrame, count: int = 10, wait_ms: int = 120_000) -> DataFrame:
    """Turns(session_id, content, timestamp) of each session in batches of count, or of what is there after wait_ms.

    State is what a session has not given out yet, fewer than count turns. batch numbers go on, so a later batch never takes
    an earlier one's place; batch_key tells a repeated batch from a new one."""
    from hashlib import sha256

    def close(session: str, batch: int, part: list) -> dict:
        last = part[-1]["timestamp"]
        return {
            "session_id": session, "batch": batch, "n": len(part), "first_ts": part[0]["timestamp"], "last_ts": last, "text": "\n".join(t["content"] for t in part),
            "batch_key": sha256(f"{session}:{batch}:{len(part)}:{last}".encode()).hexdigest()[:16],
        }

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, held = (state.get if state.exists else (0, []))
        held = [{"content": t["content"], "timestamp": t["timestamp"]} for t in held]
        out = []
        if state.hasTimedOut:
            if held:
                out.append(close(key[0], batch, held))
                batch, held = batch + 1, []
        else:
            fresh = pd.concat(list(frames))
            held += [{"content": c, "timestamp": t} for c, t in sorted(zip(fresh["content"], fresh["timestamp"], strict=True), key=lambda x: (x[1] or "", x[0]))]
            while len(held) >= count:
                out.append(close(key[0], batch, held[:count]))
                batch, held = batch + 1, held[count:]
        state.update((batch, [(t["content"], t["timestamp"]) for t in held]))
        if held:
            state.setTimeoutDuration(wait_ms)
        if out:
            yield pd.DataFrame(out)

    return turns.groupBy("session_id").applyInPandasWithState(run, BATCHES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_batches(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, summarise: Callable[[DataFrame], DataFrame] | None = None):
    """Each micro-batch as its own folder by number, which a repeated one overwrites: exactly once on any store.

    available_now reads what is there and ends; turns that wait for more stay in the state until the next run. Batches without
    data are off then: with a processing-time timeout Spark would run them for ever."""

    def put(batch: DataFrame, n: int) -> None:
        (summarise(batch) if summarise else batch).write.mode("overwrite").parquet(f"{path}/micro={n}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.trigger(processingTime="30 seconds").start()
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and type; rows later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fire_counters(fires: DataFrame) -> DataFrame:
    """Running fires and references of each trigger, for update or complete mode."""
    return fires.groupBy("trigger").agg(F.count(F.lit(1)).alias("fires"), F.sum(F.col("referenced").cast("long")).alias("references"))


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def replicate(changes: DataFrame, target, checkpoint: str):
    """A stream of change rows into a VersionedTable by key: of several rows for one key in a micro-batch the last counts."""

    def put(batch: DataFrame, n: int) -> None:
        target.upsert(batch, order=F.struct("created_at", F.col("text_hash")))

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
