"""The queries of this package, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, near_dedup, packing, quality, substring_dedup, suffix_dedup, tiff, token_counts, url_filter
from .common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), 2048)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_weights(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 1024)


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_documents(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.earlier_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(documents(spark, sf_dir))


QUERIES = (
    op1_minhash_near_dedup,
    op2_token_counts,
    op3_suffix_array_dedup,
    op4_quality_classifier,
    op5_source_mixing,
    op6_packing,
    op7_tiff_media,
    op8_substring_dedup,
    op9_url_filter,
    op10_exact_dedup,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": mixing.ORACLE, "op9_url_filter": url_filter.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
