"""Feedback and usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_if(condition) -> F.Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def feedback_matrix(feedback: DataFrame, chunks: DataFrame | None = None, limit: int | None = 50) -> DataFrame:
    """Signals of each chunk with their total and net share; the most rated first."""
    s = F.col("signal")
    out = feedback.groupBy("chunk_id").agg(count_if(s == "positive").alias("positive"), count_if(s == "negative").alias("negative"), count_if(s == "neutral").alias("neutral"), F.count(F.lit(1)).alias("total"))
    out = out.withColumn("net", F.round((F.col("positive") - F.col("negative")) / F.greatest("total", F.lit(1)), 2))
    if chunks is not None:
        out = out.join(chunks.select("chunk_id", "repo"), "chunk_id", "left")
    return out.orderBy(F.desc("total"), "chunk_id").limit(limit) if limit else out


def task_feedback(feedback: DataFrame, path: str, limit: int, needle: str | None = None) -> DataFrame:
    """The newest rows that say in their metadata what they answered, by that context."""
    rows = feedback.withColumn("query_context", F.get_json_object("metadata", path)).where("query_context IS NOT NULL")
    if needle:
        rows = rows.where(F.col("query_context").ilike(f"%{needle}%"))
    newest = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return newest.groupBy("query_context").agg(F.sort_array(F.collect_list(F.struct("id", "signal"))).alias("feedback"))


def team_activity(events: DataFrame, start, end) -> DataFrame:
    return events.where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def uncategorized_rate(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.avg(F.when(F.coalesce(F.size("category_labels"), F.lit(0)) <= 0, 1.0).otherwise(0.0)), F.lit(1.0)).alias("rate"))


def stats_summary(chunks: DataFrame, feedback: DataFrame) -> DataFrame:
    """Chunks, sources and signals in one row; stars 4 and 5 are positive, 1 and 2 negative, 3 neutral."""
    s, stars = F.col("signal"), F.col("signal").try_cast("int")
    signals = feedback.agg(
        count_if((s == "positive") | (stars >= 4)).alias("positive"), count_if((s == "negative") | (stars <= 2)).alias("negative"), count_if((s == "neutral") | (stars == 3)).alias("neutral")
    )
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("repo").alias("sources"))
    return counts.join(F.broadcast(signals))


def label_cube(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts for every subset of the columns, with how many columns each row sums over."""
    return rows.cube(*columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping"))


def trigger_stats(events: DataFrame, threshold: float = 0.10, least: int = 50) -> DataFrame:
    """Fires and references of each trigger; inactive once, at some time, it had fired least times with a smaller share.

    Rows (trigger, event_id, referenced). Running sums along a trigger would put a hot one in a single task, so they are made in two steps:
    within blocks of event ids, and over the blocks' sums.
    """
    blocks = events.withColumn("_b", F.floor(F.col("event_id") / 4096))
    sums = blocks.groupBy("trigger", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("referenced").alias("_r"))
    before = Window.partitionBy("trigger").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("trigger", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"))
    run = Window.partitionBy("trigger", "_b").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.join(sums, ["trigger", "_b"]).withColumns({"_f": F.count(F.lit(1)).over(run) + F.col("_n0"), "_g": F.sum("referenced").over(run) + F.col("_r0")})
    off = (F.col("_f") >= least) & (F.col("_g") / F.col("_f") < threshold)
    return rows.groupBy("trigger").agg(F.max("_f").alias("fires"), F.max("_g").alias("references"), (~F.max(off)).alias("active"))


def unrated(chunks: DataFrame, feedback: DataFrame) -> DataFrame:
    return chunks.join(feedback.select("chunk_id"), "chunk_id", "left_anti")


def best_signal(feedback: DataFrame) -> DataFrame:
    """The last positive signal of a chunk, else its first."""
    last = F.max_by(F.when(F.col("signal").isin("positive", "4", "5"), F.col("signal")), F.when(F.col("signal").isin("positive", "4", "5"), F.col("id")))
    return feedback.groupBy("chunk_id").agg(F.coalesce(last, F.min_by("signal", "id")).alias("signal"))


def month_costs(sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of each month; prices(model, price) are for a million tokens."""
    rows = sessions.join(F.broadcast(prices), "model", "left")
    cost = (F.col("input_tokens") + F.col("output_tokens")) / 1e6 * F.coalesce("price", F.lit(0.0))
    return rows.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost"), F.count(F.lit(1)).alias("sessions")
    )


def gpu_summary(samples: DataFrame) -> DataFrame:
    return samples.agg(F.max("memory_used_mb").alias("peak_mb"), F.round(F.avg("gpu_util_pct"), 2).alias("avg_util"), F.round(F.avg("power_draw_w"), 2).alias("avg_power"), F.max("temperature_c").alias("max_temp"), F.count(F.lit(1)).alias("n"))
