"""Readers with fixed schemas: repositories, chat logs, runs, caches, samples, training logs, vectors, digests."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import unix_lines
from ..schema import GPU_SAMPLES, OVERVIEW, RUNS, TRAINING_LOG

TURN_LINES = "type STRING, sessionId STRING, timestamp STRING, message STRUCT<content: VARIANT>"


def repository_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every text file below a folder: filename, content, hash, hash_short, size, line_estimate."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.col("content").cast("string")
    return described(files.where(~F.col("path").rlike(r"/[.][^/]+/")).select(F.col("path").alias("filename"), text.alias("content")))


def described(files: DataFrame) -> DataFrame:
    body = F.regexp_replace(unix_lines(F.col("content")), "\n+$", "")
    files = files.withColumn("content", body)
    digest = F.sha2("content", 256)
    return files.select(
        "filename", "content", digest.alias("hash"), F.substring(digest, 1, 16).alias("hash_short"), F.octet_length("content").cast("long").alias("size"),
        (F.regexp_count("content", F.lit("\n")) + 1).cast("int").alias("line_estimate"),
    )


def split_digest(df: DataFrame, column: str = "digest") -> DataFrame:
    """The files of a one-string repository digest, between lines of 48 equals signs; binary and empty ones are left out."""
    mark = "=" * 48
    parts = F.regexp_extract_all(unix_lines(F.col(column)), F.lit(f"(?s){mark}\nFILE: ([^\n]+)\n{mark}\n(.*?)(?=\n{mark}\nFILE: |\\z)"), 0)
    one = df.select(F.posexplode(parts).alias("pos", "part"))
    one = one.select(
        F.trim(F.regexp_extract("part", f"^{mark}\nFILE: ([^\n]+)\n", 1)).alias("filename"), F.regexp_extract("part", f"(?s)^{mark}\n[^\n]+\n{mark}\n(.*)$", 1).alias("content")
    )
    return described(one.where(~F.trim("content").isin("[Binary file]", "[Empty file]", "")))


def tree_paths(tree: str) -> list[str]:
    """Flat paths of an ASCII tree, by the depth of its indents."""
    out, stack = [], []
    for line in tree.splitlines():
        m = re.match(r"^((?:[│ ]\s{3}|\|\s{3}|\s{4})*)(?:[├└|`][─-]+ )?(.+?)\s*$", line)
        if not m or not m[2].strip():
            continue
        depth = len(m[1]) // 4 + bool(re.search("[├└`]|\\|-", line))
        name = m[2].strip()
        stack = stack[:depth]
        if name.endswith("/"):
            stack.append(name.rstrip("/"))
        else:
            out.append("/".join([*stack[1:], name] if depth and len(stack) > 1 else [name]))
    return out


def turn_text(content: Column) -> Column:
    """The text of a message: a string, or the texts of its blocks."""
    blocks = F.try_variant_get(content, "$", "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return F.coalesce(joined, F.try_variant_get(content, "$", "string"))


def conversation_turns(lines: DataFrame, most: int = 2000) -> DataFrame:
    """Turns of chat lines (a stream or a table): user and assistant only, with some text, cut to most characters."""
    text = turn_text(F.col("message.content"))
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:[.][^./]*)?$", 1)
    turns = lines.where(F.col("type").isin("user", "assistant")).withColumn("content", F.substring(text, 1, most))
    return turns.where(F.length(F.trim("content")) > 0).select(F.coalesce("sessionId", stem).alias("session_id"), F.col("type").alias("role"), "content", "timestamp")


def chat_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Chat logs exactly one folder below; lines that are not JSON are skipped."""
    lines = spark.read.schema(TURN_LINES).option("mode", "DROPMALFORMED").json(f"{folder}/*/*.jsonl")
    return conversation_turns(lines)


def issue_sources(issues: DataFrame, repo: str) -> DataFrame:
    """Issues as sources with their text; rows without a number are left out."""
    text = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return issues.where("number IS NOT NULL").select(
        F.concat(F.lit(f"issue:{repo}:"), F.col("number").cast("string")).alias("source_id"), F.lit("github_issue").alias("source_type"), F.lit(repo).alias("repo"),
        F.concat(F.lit("issue/"), F.col("number").cast("string")).alias("path"), text.alias("text"), F.sha2(text, 256).alias("content_hash"),
    )


def images(spark: SparkSession, folder: str, most_bytes: int = 5 << 20, most: int | None = None) -> DataFrame:
    """Image files outside dotted folders and up to a size, in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= most_bytes)
    files = files.where(F.col("path").rlike(r"(?i)[.](png|jpe?g|gif|webp|bmp|svg)$") & ~F.col("path").rlike(r"/[.][^/]+/")).select("path", "length", "modificationTime")
    return files.orderBy("path").limit(most) if most else files.orderBy("path")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Text papers of a folder with a status; PDFs are listed, and read only where a PDF library is installed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,txt}").load(folder)
    text = F.when(F.col("path").endswith(".txt"), F.col("content").cast("string")).otherwise(pdf_text("content"))
    files = files.select("path", text.alias("text"))
    return files.withColumn("status", F.when(F.col("text").isNull(), "unreadable").when(F.trim("text") == "", "empty").otherwise("ok"))


@F.udf(StringType(), useArrow=True)
def pdf_text(content: bytes) -> str:
    try:
        import io

        from pypdf import PdfReader

        return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
    except Exception:  # no library, or no PDF: the row's status says so
        return None


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Saved runs, files that do not parse left out."""
    read = spark.read.schema(RUNS).option("multiLine", "true").option("mode", "DROPMALFORMED").json(folder)
    return read.withColumn("file", F.col("_metadata.file_name")).where("run_id IS NOT NULL")


def overview(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OVERVIEW).option("multiLine", "true").json(path).where("filename IS NOT NULL")


def gpu_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples with six numeric columns; all other rows are dropped."""
    return spark.read.schema(GPU_SAMPLES).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", "true").csv(path)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_LOG).option("mode", "DROPMALFORMED").json(path)


def last_per_repo(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Context files, of which the last by name wins for each repo."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{folder}/*.json").withColumn("_file", F.col("_metadata.file_name"))
    return rows.groupBy("repo").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("repo", "_file")]), "_file").alias("r")).select("repo", "r.*")


def keyword_index(spark: SparkSession, path: str) -> DataFrame:
    """(word, cluster, pos) of a JSON map from words to lists of clusters."""
    text = spark.read.text(path, wholetext=True)
    words = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("word", "clusters"))
    return words.select("word", F.posexplode("clusters").alias("pos", "cluster"))


def changes_since(chunks: DataFrame, cursor_time, cursor_id: str, limit: int, workspace: str | None = None) -> DataFrame:
    """A page of changes after a cursor of time and id, public or of the own workspace, oldest first."""
    after = (F.col("created_at") > F.lit(cursor_time)) | ((F.col("created_at") == F.lit(cursor_time)) & (F.col("chunk_id") > F.lit(cursor_id)))
    rows = chunks.where(after)
    if workspace is not None:
        rows = rows.where((F.col("visibility") == "public") | (F.col("workspace_id") == workspace))
    return rows.orderBy("created_at", "chunk_id").limit(limit)


def _yaml(text: str):
    """The small part of YAML that rule files use, where no YAML library is installed: maps, lists and scalars."""
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        pass
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def scalar(x: str):
        x = x.strip()
        if x[:1] in "\"'" and x[-1:] == x[:1]:
            return x[1:-1]
        if x.startswith("[") and x.endswith("]"):
            return [scalar(y) for y in x[1:-1].split(",") if y.strip()]
        return {"true": True, "false": False, "null": None, "": None}.get(x, int(x) if re.fullmatch("-?[0-9]+", x) else x)

    def block(i: int, depth: int):
        if i < len(lines) and lines[i][1].startswith("- "):
            out = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1].startswith("- "):
                body = lines[i][1][2:]
                if re.match(r"[^\"'\[][^:]*:(\s|$)", body):
                    lines[i] = (depth + 2, body)
                    value, i = block(i, depth + 2)
                else:
                    value, i = scalar(body), i + 1
                out.append(value)
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == depth and ":" in lines[i][1]:
            key, _, rest = lines[i][1].partition(":")
            if rest.strip():
                out[key.strip()], i = scalar(rest), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > depth or lines[i + 1][1].startswith("- ") and lines[i + 1][0] == depth):
                out[key.strip()], i = block(i + 1, lines[i + 1][0])
            else:
                out[key.strip()], i = None, i + 1
        return out, i

    return block(0, lines[0][0])[0] if lines else None


def codebook(path: str) -> list[dict]:
    """Rules of a YAML file: a list, or the list under categories."""
    data = _yaml(Path(path).read_text(encoding="utf-8")) or []
    return data.get("categories", []) if isinstance(data, dict) else data


def codebook_profile(root: str, profile: str = "generic") -> tuple[list[str], list[dict]]:
    """The union of the excludes and categories that a profile names, from files below root only; names must be plain."""
    if not re.fullmatch("[A-Za-z0-9_-]+", profile):
        raise ValueError(f"not a profile name: {profile}")
    base = Path(root).resolve()

    def inside(*parts: str) -> Path:
        p = base.joinpath(*parts).resolve()
        if base not in p.parents:
            raise ValueError(f"outside the codebooks: {p}")
        return p

    head = inside("profiles", f"{profile}.yaml")
    if not head.exists():
        return [], codebook(str(inside("codebook.yaml")))
    spec = _yaml(head.read_text(encoding="utf-8")) or {}
    excludes, rules = [], []
    for name in spec.get("excludes") or []:
        excludes += [x for x in ignore_patterns(str(inside("excludes", f"{name}.txt"))) if x not in excludes]
    for name in spec.get("categories") or []:
        rules += codebook(str(inside("categories", f"{name}.yaml")))
    return excludes, rules


def ignore_patterns(path: str) -> list[str]:
    """The lines of an ignore file but for blank ones and comments; none if it is not there."""
    if not os.path.exists(path):
        return []
    return [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip() and not x.strip().startswith("#")]


DEFAULT_LABELS = ["api", "data", "ui", "config", "test", "docs", "logic"]


def resolve_labels(codebook_name: str, source_type: str, books: dict[str, list[str]]) -> list[str]:
    """The labels of a named codebook; auto is social for talk and code for the rest; unknown names give the defaults."""
    if codebook_name == "auto":
        codebook_name = "social" if source_type in ("conversation_summary", "github_issue", "paper") else "code"
    labels = [x for x in books.get(codebook_name, []) if re.fullmatch("[A-Za-z0-9äöüß_-]{2,30}", x)]
    return labels or DEFAULT_LABELS


def query_set(path: str) -> list[dict]:
    data = _yaml(Path(path).read_text(encoding="utf-8"))
    return data["queries"] if isinstance(data, dict) else data or []


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A codebook as a small table in its order."""
    rows = [(i, r.get("name"), r.get("description"), list(r.get("patterns") or []), r.get("risk_level")) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "priority INT, name STRING, description STRING, patterns ARRAY<STRING>, risk_level STRING")


def sampled_instances(rows: DataFrame, n: int, seed: int, repos: list[str] | None = None) -> DataFrame:
    """n rows drawn by a seeded hash of their ids, in the order of these."""
    picked = rows.where(F.col("repo").isin(repos)) if repos else rows
    return picked.orderBy(F.xxhash64(F.lit(seed), "instance_id"), "instance_id").limit(n).orderBy("instance_id")


def to_json_text(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)
