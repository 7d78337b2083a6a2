"""Retrieval with all its terms and scopes, feedback of answers, repositories' kinds, jobs and file states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles
from ..functions.vectors import clamped, cosine
from ..operators import ambient, diff, retrieval
from ..sources.adapters import chunks, feedback, table
from .registry import query
from .store import _FB, _SYM, TERMS

_COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"
_VEC = f"SELECT e.vec_id, greatest(0.0, least(1.0, {_COS.format('e.embedding', 'q.embedding')})) AS v FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 2 = 0"


@query(f"""SELECT doc_id, round(sym, 6) AS score_symbolic, round(fb, 6) AS feedback_score, round(0.30 * v + 0.20 * sym + 0.10 * age + 0.10 * near + 0.05 * (2 * fb - 1) + 0.25 * adv, 6) AS score_final,
 array_to_string(list_filter([CASE WHEN v > 0.5 THEN 'embedding_similarity' END, CASE WHEN sym > 0.3 THEN 'token_overlap' END, CASE WHEN age > 0.8 THEN 'recent_chunk' END, CASE WHEN near > 0 THEN 'source_affinity_match' END, CASE WHEN adv > 0.7 THEN 'llm_advisor_high' END], lambda x: x IS NOT NULL), ',') AS reasons
 FROM (SELECT doc_id, {_SYM} AS sym, coalesce(feedback_score, 0.5) AS fb, coalesce(v, 0.0) AS v, greatest(0.0, 1 - (n_chars % 40) / 30.0) AS age, CASE WHEN source = 'src1' THEN 1.0 ELSE 0.0 END AS near, coalesce(a.quality::DOUBLE, 0.5) AS adv
 FROM documents LEFT JOIN ({_FB}) ON chunk_id = doc_id LEFT JOIN ({_VEC}) ON vec_id = doc_id LEFT JOIN labels a USING (doc_id)) ORDER BY score_final DESC, doc_id LIMIT 50""")
def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term varies: vectors of half of the documents, an age of up to 40 days, the source, feedback, advice by labels."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    rows = chunks(spark, d).withColumns({"source_id": F.col("repo"), "created_at": now - F.make_dt_interval(days=(F.col("size") % 40).cast("int"))})
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    vectors = e.where("vec_id % 2 = 0").join(F.broadcast(one)).select(F.col("vec_id").alias("chunk_id"), clamped(cosine(F.col("embedding"), F.col("q"))).alias("score_vector"))
    advice = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").cast("double").alias("advice"))
    found = retrieval.hybrid_search(rows, feedback(spark, d), TERMS, 50, vectors, advice, "src1", now)
    return found.select(F.col("chunk_id").alias("doc_id"), "score_symbolic", "feedback_score", "score_final", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT doc_id FROM documents WHERE n_chars % 5 <> 0 AND lang = 'en' AND (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND source = 'src1') OR (doc_id % 3 = 2 AND doc_id % 2 = 0))""")
def scope_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Active chunks of a category that workspace src1 of org o0 may see: public, its own private ones, those of its org."""
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("source_id"), F.col("source").alias("workspace_id"), F.array("lang").alias("category_labels"), (F.col("n_chars") % 5 != 0).alias("is_active"))
    kind = F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "private").otherwise("org")
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("r").alias("repo"), F.lit("note").alias("source_type"), kind.alias("visibility"), F.concat(F.lit("o"), (F.col("doc_id") % 2).cast("string")).alias("org_id"))
    return retrieval.in_scope(rows, sources, repo="r", categories=["EN"], source_type="note", workspace="src1", org="o0").select("doc_id")


@query(f"""SELECT a.vec_id AS id, round(CASE WHEN a.vec_id % 7 = 0 THEN 0.0 ELSE {_COS.format("a.embedding", "b.embedding")} END, 4) AS relevance_score,
 round(CASE WHEN a.vec_id % 7 = 0 THEN 0.0 ELSE {_COS.format("a.embedding", "b.embedding")} END, 4) >= 0.65 AS was_referenced FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def context_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a context and the next one as its answer; every seventh context is empty."""
    e = table(spark, d, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("context_vector"), F.when(F.col("vec_id") % 7 == 0, "").otherwise("c").alias("context_text"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("response_vector"), F.lit("r").alias("response"))
    got = ambient.context_feedback(a.join(b, "vec_id").withColumns({"trigger_ids": F.array(F.col("vec_id").cast("string")), "led_to_retrieval": F.lit(False)}))
    return got.select(F.col("trigger_ids")[0].cast("long").alias("id"), "relevance_score", "was_referenced")


@query("""SELECT c.doc_id AS chunk_id, left(c.text, 500) AS text, lpad(n_chars::VARCHAR, 8, '0') AS captured_at FROM documents c WHERE doc_id % 4 = 1 AND source = 'src1' AND doc_id % 10 <> 3 ORDER BY captured_at DESC, chunk_id LIMIT 5""")
def recent_conversations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 4 == 1, "conversation_summary").otherwise("note")
    sources = docs.select(F.col("doc_id").alias("source_id"), F.col("source").alias("repo"), kind.alias("source_type"), F.lpad(F.col("n_chars").cast("string"), 8, "0").alias("captured_at"))
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("source_id"), "text", (F.col("doc_id") % 10 != 3).alias("is_active"))
    return ambient.recent_texts(rows, sources, "conversation_summary", 5, "src1")


_FILES = "SELECT s_nationkey AS repo, CASE s_suppkey % 11 WHEN 0 THEN 'app/Http/' || s_name || '.php' WHEN 1 THEN 'pyproject.toml' WHEN 2 THEN 'src/a.PY' WHEN 3 THEN 'docs/' ELSE 'lib/' || s_name || '.ts' END AS filename FROM supplier"


def _files(spark: SparkSession, d: str) -> DataFrame:
    rows, n = table(spark, d, "supplier"), F.col("s_suppkey") % 11
    name = F.when(n == 0, F.concat(F.lit("app/Http/"), "s_name", F.lit(".php"))).when(n == 1, "pyproject.toml").when(n == 2, "src/a.PY").when(n == 3, "docs/").otherwise(F.concat(F.lit("lib/"), "s_name", F.lit(".ts")))
    return rows.select(F.col("s_nationkey").alias("repo"), name.alias("filename"))


@query(f"SELECT repo, CASE WHEN bool_or(starts_with(filename, 'app/Http/')) THEN 'laravel' WHEN bool_or(filename = 'pyproject.toml') THEN 'python' ELSE 'universal' END AS profile FROM ({_FILES}) GROUP BY repo")
def repo_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profiles(_files(spark, d))


@query(f"SELECT repo, CASE lower(regexp_extract(filename, '[.]([^./]+)$', 1)) WHEN 'php' THEN 'PHP' WHEN 'toml' THEN 'TOML' WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' END AS language, count(*) AS files FROM ({_FILES}) WHERE NOT ends_with(filename, '/') GROUP BY ALL")
def repo_languages(spark: SparkSession, d: str) -> DataFrame:
    return profiles.languages(_files(spark, d))


_NEEDS = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'gpu' WHEN 2 THEN 'gpu, big' ELSE 'web' END"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    needs = F.get(F.array(*[F.lit(x) for x in ("", "gpu", "gpu, big", "web")]), (F.col("o_orderkey") % 4).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    scope = F.when(F.col("o_custkey") % 2 == 0, "local").otherwise("cloud")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), scope.alias("scope"), needs.alias("capability_required"), F.col("o_orderpriority").alias("workspace_id"), F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("string").alias("started_at"), F.lit("").alias("worker_id"),
    )


@query(f"SELECT o_orderkey AS job_id, {_NEEDS} AS capability_required FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 1 AND o_orderpriority = '1-URGENT' AND o_orderkey % 4 < 3")
def claimable_jobs(spark: SparkSession, d: str) -> DataFrame:
    return ambient.claimable(_jobs(spark, d), "cloud", ["gpu", "big"], "1-URGENT").select("job_id", "capability_required")


@query("""WITH own AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 10)
 SELECT o_orderkey AS job_id, CASE WHEN o_orderkey IN (FROM own) THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status, CASE WHEN o_orderkey IN (FROM own) THEN 'w1' ELSE '' END AS worker_id FROM orders""")
def claimed_jobs(spark: SparkSession, d: str) -> DataFrame:
    return ambient.claimed(_jobs(spark, d), "w1", F.lit("now"), most=10).select("job_id", "status", "worker_id")


@query("""SELECT l_orderkey AS snapshot_id, l_linenumber AS filename, CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 AND bool_or(l_linestatus = 'F') OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag) THEN 'now' END AS analyzed_at FROM lineitem""")
def files_marked(spark: SparkSession, d: str) -> DataFrame:
    """Files of each snapshot, of which those of one run key with an even number have been analysed."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("filename"), F.when(F.col("l_returnflag") == "A", F.lit(None)).otherwise(F.col("l_returnflag")).alias("run_key"), F.lit(None).cast("string").alias("analyzed_at"), "l_linestatus")
    done = rows.where("l_linestatus = 'F' AND filename % 2 = 0 AND run_key IS NULL").select("snapshot_id", "filename", "run_key")
    return diff.mark_analyzed(rows, done, F.lit("now")).select("snapshot_id", "filename", "analyzed_at")
