"""Hybrid retrieval: scope, symbolic and vector scores, recency, feedback and advice in one plan, and budgeted context."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.nearest import Nearest
from ..functions.vectors import clamped

WEIGHTS = {"vector": 0.30, "symbolic": 0.20, "recency": 0.10, "affinity": 0.10, "feedback": 0.05, "advice": 0.25}


def in_scope(chunks: DataFrame, sources: DataFrame | None = None, repo: str | None = None, categories: list[str] | None = None, source_type: str | None = None, workspace: str | None = None, org: str | None = None) -> DataFrame:
    """Active chunks that a caller may see: public ones, those of the org, private ones of the own workspace."""
    rows = chunks.where("is_active") if "is_active" in chunks.columns else chunks
    if sources is not None:
        rows = rows.join(sources.select("source_id", "repo", "source_type", "visibility", "org_id"), "source_id")
    if workspace is not None and "visibility" in rows.columns:
        seen = (F.col("visibility") == "public") | ((F.col("visibility") == "private") & (F.col("workspace_id") == workspace))
        if org is not None:
            seen = seen | ((F.col("visibility") == "org") & (F.col("org_id") == org))
        rows = rows.where(seen)
    elif workspace is not None:
        rows = rows.where(F.col("workspace_id") == workspace)
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    if source_type is not None:
        rows = rows.where(F.col("source_type") == source_type)
    if categories:
        wanted = F.array(*[F.lit(c.lower()) for c in categories])
        rows = rows.where(F.arrays_overlap(F.transform("category_labels", lambda x: F.lower(x)), wanted))
    return rows


def symbolic_score(terms: list[str], text: Column, source: Column, labels: Column) -> Column:
    """Share of the terms in the text, 0.2 more if one is part of the source, 0.1 if one is a word of a label; 1 at most."""
    if not terms:
        return F.lit(0.0)
    query = F.array(*[F.lit(t) for t in terms])
    overlap = F.size(F.array_intersect(query, tokens(text))) / F.lit(len(terms))
    in_source = F.exists(query, lambda t: F.contains(F.lower(source), t))
    in_labels = F.arrays_overlap(query, tokens(F.array_join(labels, ",")))
    return F.least(F.lit(1.0), overlap + F.when(in_source, 0.2).otherwise(0.0) + F.when(in_labels, 0.1).otherwise(0.0))


def recency_score(created: Column, now: Column) -> Column:
    """1 for new chunks down to 0 at 30 days; 0 without a date."""
    days = (F.unix_micros(now) - F.unix_micros(created)) / 86_400_000_000
    return F.coalesce(F.greatest(F.lit(0.0), 1 - days / 30.0), F.lit(0.0))


def final_score(vector: Column, symbolic: Column, recency: Column, affinity: Column, feedback: Column, advice: Column, compacted: Column | None = None) -> Column:
    w = WEIGHTS
    score = w["vector"] * vector + w["symbolic"] * symbolic + w["recency"] * recency + w["affinity"] * affinity + w["feedback"] * (2 * feedback - 1) + w["advice"] * advice
    return score if compacted is None else F.when(compacted, F.least(F.lit(1.0), score + 0.10)).otherwise(score)


def reasons(vector: Column, symbolic: Column, recency: Column, affinity: Column, advice: Column) -> Column:
    # fixed values: the names of the reasons and from where on they count
    why = [
        F.when(vector > 0.5, "embedding_similarity"), F.when(symbolic > 0.3, "token_overlap"), F.when(recency > 0.8, "recent_chunk"),
        F.when(affinity > 0, "source_affinity_match"), F.when(advice > 0.7, "llm_advisor_high"),
    ]
    return F.filter(F.array(*why), lambda x: x.isNotNull())


def feedback_scores(feedback: DataFrame) -> DataFrame:
    """(chunk_id, feedback_score): share of positive less negative signals, as 0 to 1; stars count in the divisor only."""
    net = F.sum(F.when(F.col("signal") == "positive", 1).when(F.col("signal") == "negative", -1).otherwise(0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), net / F.count(F.lit(1)) * 0.5 + 0.5))
    return feedback.groupBy("chunk_id").agg(score.alias("feedback_score"))


def hybrid_search(chunks: DataFrame, feedback: DataFrame, terms: list[str], top_k: int = 8, vectors: DataFrame | None = None, advice: DataFrame | None = None, affinity_source: str | None = None, now: Column | None = None) -> DataFrame:
    """Ranked chunks(chunk_id, repo, text, category_labels, ...): the scores are left joins and expressions, the end a top-k.

    vectors: (chunk_id, score_vector); advice: (chunk_id, advice). Missing parts have the neutral values 0, 0.5 for advice.
    """
    rows = chunks.join(feedback_scores(feedback), "chunk_id", "left")
    vector, advised = F.lit(0.0), F.lit(0.5)
    if vectors is not None:
        rows, vector = rows.join(vectors, "chunk_id", "left"), F.coalesce("score_vector", F.lit(0.0))
    if advice is not None:
        rows, advised = rows.join(advice, "chunk_id", "left"), F.coalesce("advice", F.lit(0.5))
    recent = recency_score(F.col("created_at"), now) if now is not None and "created_at" in chunks.columns else F.lit(0.0)
    near = F.when(F.col("source_id") == affinity_source, 1.0).otherwise(0.0) if affinity_source is not None and "source_id" in chunks.columns else F.lit(0.0)
    text = F.concat_ws(" ", "text", "summary") if "summary" in chunks.columns else F.col("text")
    symbolic = symbolic_score(terms, text, F.col("source_id" if "source_id" in chunks.columns else "repo"), F.col("category_labels"))
    opinion = F.coalesce("feedback_score", F.lit(0.5))
    scored = rows.select(
        "chunk_id", "text", F.round(symbolic, 6).alias("score_symbolic"), F.round(opinion, 6).alias("feedback_score"),
        F.round(final_score(vector, symbolic, recent, near, opinion, advised), 6).alias("score_final"), reasons(vector, symbolic, recent, near, advised).alias("reasons"),
    )
    return scored.orderBy(F.desc("score_final"), "chunk_id").limit(top_k)


#: Queries that are broadcast at once: with vectors of some hundred numbers some megabytes.
QUERY_BLOCK = 8192


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact nearest vectors(id, embedding) for each of a stated set of queries(query_id, query): by cosine, ties by id.

    Queries go in blocks of a bounded size, each of which is a scan of the vectors, dealt out to all cores. A task keeps the
    best k of each query while it scans, and the rank is taken of what the tasks kept.
    """
    spark = vectors.sparkSession
    blocks = -(-queries.count() // block) or 1
    tasks = spark.sparkContext.defaultParallelism
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    rows = vectors.select("id", "embedding")
    rows = rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = []
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        asked = spark.sparkContext.broadcast(own.select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow())
        best = rows.mapInArrow(functools.partial(_scan, asked, k, least), f"query_id {kinds[0]}, id {kinds[1]}, score double")
        found.append(best.withColumn("rank", rank).where(F.col("rank") <= k))
    return functools.reduce(DataFrame.unionByName, found)


def _scan(asked, k: int, least: float | None, batches):
    """The best k of each asked query among the batches' vectors."""
    best = Nearest(asked.value["query"].combine_chunks(), k, least)
    for b in batches:
        best.add(b.column("id"), b.column("embedding"))
    yield from best.rows(asked.value["query_id"])


def vector_hits(distances: DataFrame, candidates: DataFrame) -> DataFrame:
    """Hits (chunk_id, distance) of candidates only, as scores from 0 to 1."""
    return distances.join(candidates.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", clamped(1 - F.col("distance")).alias("score_vector"))


def budget_prefix(rows: DataFrame, group: str, order: list, size: Column, budget: int) -> DataFrame:
    """Rows of each group, in order, until the running size first goes beyond the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_run", F.sum(size).over(w)).where(F.col("_run") <= budget).drop("_run")


def compressed(results: DataFrame, budget: int) -> DataFrame:
    """(context): the best hit of each source, each within an equal share of what is left of the budget, as one text; the first
    entry that does not fit ends it, and without any it is empty.

    A fold over the at most top_k results: what an entry takes depends on what all before it took.
    """
    first = Window.partitionBy("source_id").orderBy(F.desc("score_final"), "chunk_id")
    best = results.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    labels = F.array_join("category_labels", ", ") if "category_labels" in results.columns else F.lit("")
    rows = best.select((-F.col("score_final")).alias("s"), "chunk_id", "source_id", F.when(labels == "", "?").otherwise(labels).alias("labels"), "text", F.coalesce("summary", F.lit("")).alias("summary"))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("s", "chunk_id", "source_id", "labels", "text", "summary"))).alias("xs"))
    head = "## Memory Context\n"
    start = F.struct(F.lit("").alias("text"), F.lit(len(head) + 1).alias("used"), F.size("xs").alias("left"), F.lit(False).alias("full"))

    def add(acc, x):
        share = F.greatest(F.lit(100), F.floor((F.lit(budget) - acc["used"]) / F.greatest(acc["left"], F.lit(1))).cast("int"))
        body = F.when((F.length(x["text"]) > 500) & (x["summary"] != ""), x["summary"]).otherwise(x["text"])
        body = F.when(F.length(body) > share, F.concat(F.substring(body, F.lit(1), share - 3), F.lit("..."))).otherwise(body)
        entry = F.concat(F.lit("\n- ["), x["labels"], F.lit("] "), x["source_id"], F.lit("\n  "), body)
        fits = ~acc["full"] & (acc["used"] + F.length(entry) <= budget)
        return F.struct(
            F.when(fits, F.concat(acc["text"], entry)).otherwise(acc["text"]).alias("text"), F.when(fits, acc["used"] + F.length(entry)).otherwise(acc["used"]).alias("used"),
            (acc["left"] - 1).alias("left"), (~fits).alias("full"),
        )

    body = F.aggregate("xs", start, add)["text"]
    return listed.select(F.when(body == "", "").otherwise(F.concat(F.lit(head), body)).alias("context"))
