"""Writes that are more than a table's own: merges of nodes and caches, exports of findings and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_node(old: DataFrame, new: DataFrame) -> DataFrame:
    """Node upsert that keeps what the new row leaves empty."""
    keys = ["id", "workspace_id"]
    both = old.alias("o").join(new.alias("n"), keys, "full")
    full = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    labels = F.array_union(F.coalesce("o.labels", F.array().cast("array<string>")), F.coalesce("n.labels", F.array().cast("array<string>"))).alias("labels")
    text = [full(c) for c in ("repo_slug", "type", "cluster_id", "summary", "turbulence_tier")]
    return both.select(*keys, *text, labels, F.coalesce("n.loc", "o.loc").alias("loc")).select(*old.columns)


def superseded(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """chunks with old_id inactive and superseded by new_id."""
    found = chunks.join(pairs.select(F.col("old_id").alias("chunk_id"), "new_id"), "chunk_id", "left")
    return found.withColumns({"is_active": F.col("is_active") & F.col("new_id").isNull(), "superseded_by": F.coalesce("new_id", "superseded_by")}).drop("new_id").select(*chunks.columns)


def upserted_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of known pairs are replaced, not added."""
    return new.unionByName(old.join(new, ["from_topic", "to_topic"], "left_anti"))


def llm_call_rows(calls: DataFrame) -> DataFrame:
    """Model calls as log rows, with prompt and response cut."""
    return calls.withColumns({"prompt": F.substring("prompt", 1, 500), "response": F.substring("response", 1, 800)})


def export_findings(findings: DataFrame, path: str) -> None:
    """Findings as CSV or JSON by the path's suffix."""
    if path.endswith(".csv"):
        findings.write.mode("overwrite").option("header", "true").csv(path)
    elif path.endswith(".json"):
        findings.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"neither .csv nor .json: {path}")


def write_jsonl(rows: DataFrame, path: str) -> int:
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.text(path).where("trim(value) <> ''").count()


def merged_overview(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries over the cached ones of the same file."""
    return new.unionByName(old.join(new, "filename", "left_anti"), allowMissingColumns=True)
