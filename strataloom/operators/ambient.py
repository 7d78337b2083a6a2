"""What an answer tells about the context that it was given, recent texts as context, and a table of jobs to claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

# Fixed value: from this cosine on a context counts as referred to.
REFERENCED = 0.65


def context_feedback(answers: DataFrame) -> DataFrame:
    """Rows of the feedback log of answers(trigger_ids, context_text, response, context_vector, response_vector, led_to_retrieval):
    the cosine of context and response, to 4 places, and whether that is a reference. Without a context, response or vector
    it is 0. Of the context 500 characters are kept."""
    told = (F.length("context_text") > 0) & (F.length("response") > 0) & F.col("context_vector").isNotNull() & F.col("response_vector").isNotNull()
    score = F.when(told, F.round(cosine(F.col("context_vector"), F.col("response_vector")), 4)).otherwise(0.0)
    return answers.withColumn("relevance_score", score).select(
        "trigger_ids", F.substring("context_text", 1, 500).alias("context_text"), (F.col("relevance_score") >= REFERENCED).alias("was_referenced"), "led_to_retrieval", "relevance_score"
    )


def recent_texts(chunks: DataFrame, sources: DataFrame, source_type: str, limit: int, repo: str = "") -> DataFrame:
    """(text, captured_at) of the newest active chunks of a kind of source, of one repo or of all; 500 characters each."""
    wanted = sources.where(F.col("source_type") == source_type)
    if repo:
        wanted = wanted.where(F.col("repo") == repo)
    rows = chunks.where("is_active").join(wanted.select("source_id", "captured_at"), "source_id")
    newest = rows.orderBy(F.desc_nulls_last("captured_at"), "chunk_id").limit(limit)
    return newest.select("chunk_id", F.substring("text", 1, 500).alias("text"), F.coalesce("captured_at", F.lit("")).alias("captured_at"))


def capability_match(required: Column, capabilities: list[str]) -> Column:
    """Whether each of the capabilities that a job requires, with commas between, is at hand; an empty list requires none."""
    needed = F.filter(F.transform(F.split(F.coalesce(required, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.forall(needed, lambda x: F.array_contains(F.array(*[F.lit(c) for c in capabilities]).cast("array<string>"), x))


def claimable(jobs: DataFrame, scope: str, capabilities: list[str] | None = None, workspace: str | None = None) -> DataFrame:
    """Queued jobs of a scope that a worker may take, numbered by turn: the oldest is the next, ties by id."""
    rows = jobs.where((F.col("status") == "queued") & (F.col("scope") == scope))
    if workspace:
        rows = rows.where(F.col("workspace_id") == workspace)
    if capabilities is not None:
        rows = rows.where(capability_match(F.col("capability_required"), capabilities))
    return rows


def claimed(jobs: DataFrame, worker: str, now: Column, scope: str = "local", capabilities: list[str] | None = None, most: int = 1) -> DataFrame:
    """jobs after a worker has claimed the oldest it may take: these run from now on, all others stay as they are. Written as a
    new version of the table, a claim fails where another came before it."""
    own = claimable(jobs, scope, capabilities).orderBy("created_at", "job_id").limit(most).select("job_id", F.lit(True).alias("_own"))
    rows = jobs.join(own, "job_id", "left")
    of = lambda value, name: F.when(F.col("_own"), value).otherwise(F.col(name)).alias(name)
    news = {"status": F.lit("running"), "started_at": now, "worker_id": F.lit(worker)}
    return rows.select(*[of(news[c], c) if c in news else F.col(c) for c in jobs.columns])


def newest_by(rows: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """The newest rows of each group, ties by id: what a listing shows."""
    w = Window.partitionBy(group).orderBy(F.desc(order), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
