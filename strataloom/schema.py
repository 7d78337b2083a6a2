"""Schemas of the store: sources, chunks, feedback, graph, runs, and additive evolution of old data to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fields(schema: str) -> list[T.StructField]:
    """The fields of a schema string; needs a running session."""
    return T.StructType.fromDDL(schema).fields


SOURCES = (
    "source_id STRING, source_type STRING, repo STRING, path STRING, branch STRING, commit STRING, content_hash STRING, "
    "captured_at TIMESTAMP, visibility STRING, org_id STRING, workspace_id STRING"
)
CHUNKS = (
    "chunk_id STRING, source_id STRING, parent_chunk_id STRING, chunk_level STRING, ordinal INT, start_offset INT, end_offset INT, "
    "text STRING, text_hash STRING, summary STRING, category_labels ARRAY<STRING>, category_version STRING, embedding_model STRING, "
    "embedding_id STRING, quality_score DOUBLE, dedup_key STRING, category_source STRING, category_confidence DOUBLE, igio_axis STRING, "
    "igio_confidence DOUBLE, igio_classified_at TIMESTAMP, created_at TIMESTAMP, workspace_id STRING, superseded_by STRING, is_active BOOLEAN"
)
FEEDBACK = ("id LONG, chunk_id STRING, signal STRING, metadata STRING, created_at TIMESTAMP")
SOURCE_REFS = ("canonical_chunk_id STRING, source_id STRING, workspace_id STRING, created_at TIMESTAMP")
FILE_VERSIONS = ("snapshot_id LONG, filename STRING, hash STRING, size LONG, analyzed_at TIMESTAMP, run_key STRING")
NODES = ("id STRING, repo_slug STRING, workspace_id STRING, type STRING, cluster_id STRING, labels ARRAY<STRING>, summary STRING, turbulence_tier STRING, loc INT")
EDGES = ("source STRING, target STRING, repo_slug STRING, workspace_id STRING, type STRING, weight DOUBLE, context STRING, validated BOOLEAN")
FINDINGS = "ARRAY<STRUCT<type: STRING, severity: STRING, confidence: STRING, line_hint: STRING, evidence_excerpt: STRING, fix_suggestion: STRING, needs_explikation: BOOLEAN>>"
RUNS = (
    "run_id STRING, timestamp STRING, repo_url STRING, model STRING, mode STRING, timing_seconds DOUBLE, files_checked INT, "
    "diff_summary STRUCT<changed: INT, added: INT, removed: INT, unchanged: INT>, "
    f"results ARRAY<STRUCT<filename: STRING, category: STRING, potential_smells: {FINDINGS}, codierungen: {FINDINGS}, _parse_error: BOOLEAN, error: STRING>>"
)
OVERVIEW = (
    "filename STRING, category STRING, file_summary STRING, dependencies ARRAY<STRING>, functions ARRAY<STRUCT<name: STRING, inputs: ARRAY<STRING>, "
    "outputs: ARRAY<STRING>, calls: ARRAY<STRING>>>, external_deps ARRAY<STRING>, content_hash STRING"
)
TURNS = ("session_id STRING, role STRING, content STRING, timestamp STRING")
GPU_SAMPLES = ("timestamp STRING, gpu_util_pct DOUBLE, memory_used_mb DOUBLE, memory_total_mb DOUBLE, power_draw_w DOUBLE, temperature_c DOUBLE")
TRAINING_LOG = (
    "timestamp STRING, run_id STRING, model STRING, label STRING, call_type STRING, prompt_hash STRING, prompt STRING, raw_response STRING, parsed_ok BOOLEAN, findings_count INT"
)
VISIBILITIES = ("private", "org", "public")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of schema, missing ones null: additive evolution on read."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields(schema)])
