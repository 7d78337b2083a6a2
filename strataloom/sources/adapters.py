"""The given tables in the shapes of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_hash
from ..operators.graph import common_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: one chunk a document, its source as repo, its language as workspace and only label."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("repo"), F.col("lang").alias("workspace_id"), "text",
        text_hash(F.coalesce("text", F.lit(""))).alias("text_hash"), F.array("lang").alias("category_labels"), F.col("n_chars").alias("size"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a feedback log: quality 1 is positive, 0 negative; toxic rows add a neutral signal."""
    labels = table(spark, sf_dir, "labels")
    quality = labels.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("signal"))
    return quality.union(labels.where("toxic = 1").select("doc_id", F.lit("neutral")))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of suppliers: an edge for each two that serve one part, from the smaller to the larger key, with a weight."""
    return common_edges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("n"), F.col("l_partkey").alias("t")))


def file_versions(spark: SparkSession, sf_dir: str, month: int) -> DataFrame:
    """A snapshot of files: each customer's last order up to a month of 1997 as its version."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.make_date(F.lit(1997), F.lit(month), F.lit(1)).cast("timestamp"))
    return orders.groupBy(F.col("o_custkey").alias("filename")).agg(
        F.sha2(F.max("o_orderkey").cast("string"), 256).alias("hash"), F.count(F.lit(1)).alias("size")
    )
