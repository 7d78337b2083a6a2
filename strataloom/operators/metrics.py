"""Retrieval and prediction metrics from tables of ranks and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_ranks(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rr) of ranked(query_id, id, rank): one by the rank of the first relevant id, 0 without one."""
    hits = ranked.join(relevant.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return ranked.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def mrr(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    return reciprocal_ranks(ranked, relevant).agg(F.round(F.avg("rr"), 6).alias("mrr"))


def recall_at_k(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Mean share of the relevant ids among the first k; a query without any counts 1."""
    n = relevant.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hit = ranked.where(F.col("rank") <= k).select("query_id", "id").distinct().join(relevant.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
    rows = queries.select("query_id").join(n, "query_id", "left").join(hit, "query_id", "left")
    return rows.agg(F.round(F.avg(F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("h", F.lit(0)) / F.col("n"))), 6).alias("recall"))


def judged_by_label(ranked: DataFrame, queries: DataFrame, labels: DataFrame) -> DataFrame:
    """ranked(query_id, id, rank) with hit: whether the id has the query's label. Labels are looked up for the ranked rows only, so
    that no pairs of a label are made. queries: (query_id, label), labels: (id, label)."""
    rows = ranked.join(labels.select("id", F.col("label").alias("_of")), "id").join(queries.select("query_id", "label"), "query_id")
    return rows.select("query_id", "id", "rank", (F.col("label") == F.col("_of")).alias("hit"))


def label_mrr(judged: DataFrame) -> DataFrame:
    first = judged.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    rr = F.when(F.col("first") == 0, float("inf")).otherwise(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))  # as SQL divides by a rank of 0
    return first.agg(F.round(F.avg(rr), 6).alias("mrr"))


def label_recall(judged: DataFrame, queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Mean share of the other ids of a query's label among the first k; queries whose label has no other id don't count."""
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    hits = judged.where((F.col("rank") <= k) & F.col("hit")).groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
    rows = queries.join(sizes, "label").join(hits, "query_id", "left")
    return rows.agg(F.round(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")), 6).alias("recall"))


def category_precision(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Share of queries with an expected category of which one of the first k hits' labels contains it, or is in it."""
    e, x = F.lower("expected"), F.lower("label")
    hit = ranked.where(F.col("rank") <= k).join(expected, "query_id").groupBy("query_id").agg(F.max(F.when(x.contains(e) | e.contains(x), 1.0).otherwise(0.0)).alias("hit"))
    return expected.where("expected IS NOT NULL").join(hit, "query_id", "left").agg(F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)), 6).alias("precision"))


def set_f1(pairs: DataFrame) -> DataFrame:
    """Recall, precision and F1 of arrays truth and suggested."""
    both = F.size(F.array_intersect("truth", "suggested"))
    r = F.when(F.size("truth") > 0, both / F.size(F.array_distinct("truth"))).otherwise(0.0)
    p = F.when(F.size("suggested") > 0, both / F.size(F.array_distinct("suggested"))).otherwise(0.0)
    out = pairs.withColumns({"recall": F.round(r, 4), "precision": F.round(p, 4)})
    return out.withColumn("f1", F.round(F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0), 4))


def bench_scores(runs: DataFrame) -> DataFrame:
    """Score of (name, files, findings, parse_errors, high): findings a file times parsed share times high share, best 100."""
    files = F.greatest("files", F.lit(1))
    raw = F.col("findings") / files * (1 - F.col("parse_errors") / files) * F.greatest(F.col("high") / F.greatest("findings", F.lit(1)), F.lit(0.1))
    top = runs.select(raw.alias("_raw")).agg(F.max("_raw").alias("_top"))
    scored = runs.withColumn("_raw", raw).join(F.broadcast(top)).withColumn("score", F.when(F.col("_top") > 0, F.round(100 * F.col("_raw") / F.col("_top"))).otherwise(0.0).cast("int")).drop("_raw", "_top")
    s = F.col("score")
    return scored.withColumn("stars", F.when(s >= 90, 5).when(s >= 70, 4).when(s >= 50, 3).when(s >= 25, 2).otherwise(1))


def findings_summary(findings: DataFrame, least: str = "low") -> DataFrame:
    """Totals by severity of the findings that are sure enough; unknown severities count in the total only."""
    rank = {"high": 0, "medium": 1, "low": 2}
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.lower(F.coalesce("confidence", F.lit("medium")))], F.lit(1))
    s = F.lower("severity")
    return findings.where(level <= rank[least]).agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum(F.when(s == x, 1)), F.lit(0)).alias(x) for x in ("critical", "warning", "info")])


def top_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    order = lambda c, m, d: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.lower(c)], F.lit(d))
    sev, conf = order(F.col("severity"), {"critical": 0, "warning": 1, "info": 2}, 2), order(F.col("confidence"), {"high": 0, "medium": 1, "low": 2}, 1)
    return findings.orderBy(sev, conf, "filename", "pos").limit(n)


def keyword_hits(rows: DataFrame, keywords: str = "keywords", answer: str = "answer") -> DataFrame:
    """rows with hit_ratio: the share of keywords that the answer contains."""
    found = F.size(F.filter(keywords, lambda k: F.contains(F.lower(F.col(answer)), F.lower(k))))
    return rows.withColumn("hit_ratio", F.round(F.when(F.size(keywords) > 0, found / F.size(keywords)).otherwise(0.0), 2))


def first_ranks(scores: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
