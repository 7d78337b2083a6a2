"""Topic transitions, decay and trigger lookups over ordered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import topic_words
from ..functions.vectors import cosine


def transitions(rows: DataFrame, session: str, order: str, topic: str) -> DataFrame:
    """Counts of steps from one topic to another within a session; steps to itself don't count."""
    nxt = F.lead(topic).over(Window.partitionBy(session).orderBy(order))
    pairs = rows.select(F.col(topic).alias("from_topic"), nxt.alias("to_topic")).where("from_topic <> to_topic")
    return pairs.groupBy("from_topic", "to_topic").agg(F.count(F.lit(1)).alias("count"))


def next_topics(counts: DataFrame, top_k: int = 3) -> DataFrame:
    """The likeliest next topics of each, with their probabilities."""
    p = F.round(F.col("count") / F.sum("count").over(Window.partitionBy("from_topic")), 6)
    rows = counts.withColumn("probability", p)
    rank = F.row_number().over(Window.partitionBy("from_topic").orderBy(F.desc("probability"), "to_topic"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_k).select("from_topic", "to_topic", "probability", "rank")


def topics_of(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(id, topic, pos): topics of an index(word, cluster) in the order of their first words in texts(id, text)."""
    words = texts.select("id", F.posexplode(topic_words(F.col("text"))).alias("pos", "word"))
    return words.join(index.select("word", "cluster"), "word").groupBy("id", F.col("cluster").alias("topic")).agg(F.min("pos").alias("pos"))


def decay_score(age_days: Column, sticky: Column, matches: Column, half_life: float = 14.0) -> Column:
    """0.5, or 0.9 for sticky entries, and 0.3 in the first day, fading with age; sticky ones keep 0.9; 0.2 a match up to 3."""
    age = F.coalesce(age_days, F.lit(365.0))
    base = F.when(sticky, 0.9).otherwise(0.5) + F.when(age < 1, 0.3).otherwise(0.0)
    faded = base * F.exp(-age / half_life)
    return F.round(F.when(sticky, F.greatest(faded, F.lit(0.9))).otherwise(faded) + 0.2 * F.least(matches, F.lit(3)), 4)


def trigger_scan(messages: DataFrame, index: DataFrame, clusters: DataFrame, vectors: DataFrame | None = None, inactive: DataFrame | None = None, threshold: float = 0.75, most: int = 3) -> DataFrame:
    """(id, cluster, pos): up to three clusters by words in the message's order; for messages without one, by cosine."""
    hits = topics_of(messages, index).withColumnRenamed("topic", "cluster")
    if vectors is not None:
        near = messages.join(hits, "id", "left_anti").join(vectors, "id").select("id", "vector").join(F.broadcast(clusters))
        score = cosine(F.col("vector"), F.col("embedding"))
        near = near.select("id", "cluster", score.alias("s")).where(F.col("s") >= threshold)
        hits = hits.union(near.select("id", "cluster", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "cluster")).alias("pos")))
    if inactive is not None:
        hits = hits.join(inactive.select("cluster"), "cluster", "left_anti").select("id", "cluster", "pos")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("pos", "cluster"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most)
