"""Exact dedup of chunks within a workspace, references to other sources, and unions with precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_dedup(chunks: DataFrame) -> DataFrame:
    """chunks with the smallest chunk_id of each text of a workspace as canonical_id. The groups meet as a sum and a join, so
    that a text with very many copies is not one task's window."""
    first = chunks.groupBy("workspace_id", "text_hash").agg(F.min("chunk_id").alias("canonical_id"))
    return chunks.join(first, ["workspace_id", "text_hash"]).withColumn("is_duplicate", F.col("chunk_id") != F.col("canonical_id"))


def source_refs(chunks: DataFrame) -> DataFrame:
    """(canonical_id, also_in): the other sources that hold a chunk's text, in order."""
    marked = resolve_dedup(chunks)
    own = marked.where("NOT is_duplicate").select("canonical_id", F.col("repo").alias("own"))
    others = marked.where("is_duplicate").select("canonical_id", "repo").distinct().join(own, "canonical_id").where("repo <> own")
    return others.groupBy("canonical_id").agg(F.sort_array(F.collect_set("repo")).alias("also_in"))


def unchanged_skipped(sources: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Sources whose content is new or changed; all of them with force."""
    return sources if force else sources.join(known, ["source_id", "content_hash"], "left_anti")


def union_by_priority(frames: list[DataFrame], key: str, order: list) -> DataFrame:
    """All frames as one; of rows with one key that of the first frame stays, within it the first by order."""
    tagged = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    all_ = tagged[0]
    for t in tagged[1:]:
        all_ = all_.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_p", *order)
    return all_.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def merge_annotations(existing: DataFrame, batches: list[DataFrame]) -> DataFrame:
    """Annotations by prompt_hash: existing ones stay; label skip and a quality below 0.5 go (defaults good and 1)."""
    usable = []
    for b in batches:
        label, quality = (F.coalesce(c, F.lit(v)) for c, v in (("label", "good"), ("quality", 1.0)))
        usable.append(b.withColumns({"label": label, "quality": quality}).where((F.col("label") != "skip") & (F.col("quality") >= 0.5)))
    return union_by_priority([existing, *usable], "prompt_hash", ["label"])


def split_train(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """rows with validation: a fixed share by a seeded hash of the key, at least one row if there is any."""
    ranked = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000))
    first = rows.agg(F.min(F.struct(ranked, F.col(key))).alias("m")).select(F.col("m").getField(key).alias("_k"))
    return rows.join(F.broadcast(first)).withColumn("validation", (ranked < int(share * 10_000)) | (F.col(key) == F.col("_k"))).drop("_k")
