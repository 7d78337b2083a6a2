"""Search, feedback, statistics, dedup and training pairs over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, feedback as fb, retrieval, training
from ..sources.adapters import chunks, feedback, table
from .registry import query

TERMS = ["erthhe", "the", "src1", "en"]
_TOK = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1))"
_TERMS = "['erthhe', 'the', 'src1', 'en']"
_SYM = f"""least(1.0, len(list_intersect({_TERMS}, {_TOK})) / 4.0
 + CASE WHEN len(list_filter({_TERMS}, lambda t: contains(lower(source), t))) > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN len(list_intersect({_TERMS}, regexp_extract_all(lower(lang), '([a-z0-9]+)', 1))) > 0 THEN 0.1 ELSE 0.0 END)"""
_SIGNALS = "SELECT doc_id AS chunk_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS signal FROM labels UNION ALL SELECT doc_id, 'neutral' FROM labels WHERE toxic = 1"
_FB = f"SELECT chunk_id, greatest(0.0, least(1.0, sum(CASE signal WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) / count(*) * 0.5 + 0.5)) AS feedback_score FROM ({_SIGNALS}) GROUP BY chunk_id"


@query(f"""SELECT doc_id, round({_SYM}, 6) AS score_symbolic, round(coalesce(feedback_score, 0.5), 6) AS feedback_score,
 round(0.2 * {_SYM} + 0.05 * (2 * coalesce(feedback_score, 0.5) - 1) + 0.25 * 0.5, 6) AS score_final
 FROM documents LEFT JOIN ({_FB}) ON chunk_id = doc_id ORDER BY score_final DESC, doc_id LIMIT 8""")
def hybrid_search_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.hybrid_search(chunks(spark, d), feedback(spark, d), TERMS, 8)
    return found.select(F.col("chunk_id").alias("doc_id"), "score_symbolic", "feedback_score", "score_final")


@query("SELECT doc_id, text FROM documents WHERE lang IN ('en', 'de') AND source = 'src1'")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.in_scope(chunks(spark, d), repo="src1", categories=["EN", "de"]).select(F.col("chunk_id").alias("doc_id"), "text")


@query(f"SELECT doc_id, round({_SYM}, 6) AS score FROM documents")
def symbolic_score(spark: SparkSession, d: str) -> DataFrame:
    score = retrieval.symbolic_score(TERMS, F.col("text"), F.col("repo"), F.col("category_labels"))
    return chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), F.round(score, 6).alias("score"))


@query(f"""SELECT chunk_id, count(*) FILTER (signal = 'positive') AS positive, count(*) FILTER (signal = 'negative') AS negative, count(*) FILTER (signal = 'neutral') AS neutral,
 count(*) AS total, round((count(*) FILTER (signal = 'positive') - count(*) FILTER (signal = 'negative')) / count(*), 2) AS net FROM ({_SIGNALS}) GROUP BY chunk_id""")
def feedback_matrix(spark: SparkSession, d: str) -> DataFrame:
    return fb.feedback_matrix(feedback(spark, d), limit=None)


@query(f"SELECT chunk_id, round(feedback_score, 6) AS feedback_score FROM ({_FB})")
def feedback_score(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.feedback_scores(feedback(spark, d)).withColumn("feedback_score", F.round("feedback_score", 6))


@query("""SELECT query_context, list(struct_pack(id := event_id, signal := event_type) ORDER BY event_id)::VARCHAR IS NOT NULL AS some, count(*) AS n, min(event_id) AS first_id
 FROM (SELECT *, json_extract_string(props, '$.k') AS query_context FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY query_context""")
def task_feedback_matrix(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("signal"), F.col("props").alias("metadata"), F.col("ts").alias("created_at"))
    out = fb.task_feedback(log, "$.k", 500)
    return out.select("query_context", F.col("feedback").isNotNull().alias("some"), F.size("feedback").cast("long").alias("n"), F.col("feedback")[0]["id"].alias("first_id"))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id")
def team_activity(spark: SparkSession, d: str) -> DataFrame:
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return fb.team_activity(table(spark, d, "events"), day("2024-01-05"), day("2024-01-20"))


@query("SELECT round(avg(CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents d LEFT JOIN labels l USING (doc_id)")
def uncategorized_rate(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id", F.array(F.col("quality").cast("string")).alias("category_labels"))
    rows = table(spark, d, "documents").select("doc_id").join(labelled, "doc_id", "left")
    return fb.uncategorized_rate(rows).withColumn("rate", F.round("rate", 6))


@query(f"""SELECT count(*) AS chunks, count(DISTINCT source) AS sources, (SELECT count(*) FROM labels WHERE quality = 1) AS positive,
 (SELECT count(*) FROM labels WHERE quality <> 1) AS negative, (SELECT count(*) FROM labels WHERE toxic = 1) AS neutral FROM documents""")
def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    return fb.stats_summary(chunks(spark, d), feedback(spark, d))


@query("SELECT lang, quality, toxic, count(*) AS n, grouping(lang) * 4 + grouping(quality) * 2 + grouping(toxic) AS grouping FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, quality, toxic)")
def label_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return fb.label_cube(rows, "lang", "quality", "toxic")


@query("SELECT doc_id, min(doc_id) OVER w AS canonical_id, doc_id <> min(doc_id) OVER w AS is_duplicate FROM documents WINDOW w AS (PARTITION BY lang, text)")
def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.resolve_dedup(chunks(spark, d)).select(F.col("chunk_id").alias("doc_id"), "canonical_id", "is_duplicate")


@query("""SELECT canonical_id, list_sort(list(DISTINCT source)) AS also_in FROM (SELECT source, first_value(source) OVER w AS own, min(doc_id) OVER (PARTITION BY lang, text) AS canonical_id
 FROM documents WINDOW w AS (PARTITION BY lang, text ORDER BY doc_id)) WHERE source <> own GROUP BY canonical_id""")
def source_refs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.source_refs(chunks(spark, d))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unrated_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return fb.unrated(chunks(spark, d), feedback(spark, d)).select(F.col("chunk_id").alias("doc_id"))


@query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS text_hash, 'chk_' || sha256(source || ':file:0')[1:16] AS chunk_id, regexp_replace(source, '[^A-Za-z0-9]', '_', 'g') AS node FROM documents")
def hashes_and_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), "text_hash", T.chunk_id(F.col("repo"), F.lit("file"), F.lit(0)).alias("chunk_id"), T.mermaid_id(F.col("repo")).alias("node"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1))) AS tokens FROM documents")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_sort(T.tokens(F.col("text"))).alias("tokens"))


@query("""SELECT page_id, CASE WHEN s = '' THEN 'repo' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://[^/]*', ''), '[.]git$', ''), '/', '-'), '[^a-z0-9-]', '', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def url_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.repo_slug(F.col("url")).alias("slug"))


@query("""SELECT doc_id AS chunk_id, substr(text, 1, 800) AS text, lang AS labels, quality_score FROM (SELECT *, n_chars / 100000.0 AS quality_score FROM documents)
 LEFT JOIN labels USING (doc_id) WHERE length(text) >= 50 AND (quality IS NULL OR quality = 1)""")
def category_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("quality_score", F.col("size") / 100000.0)
    ratings = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.lit(0).alias("id"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("signal"))
    return training.category_pairs(c, ratings)


@query("""WITH r AS (SELECT doc_id, source, lang, substr(coalesce(text, ''), 1, 500) AS part, CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN -1.0 END AS rating FROM documents LEFT JOIN labels USING (doc_id)),
 w AS (SELECT *, sum(length(part)) OVER (PARTITION BY source ORDER BY coalesce(rating, 0) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM r WHERE part <> ''),
 c AS (SELECT source, string_agg('### [file] ' || split_part(source, '/', -1) || chr(10) || part, chr(10) || chr(10) ORDER BY coalesce(rating, 0) DESC, doc_id) AS context FROM w WHERE run <= 3000 GROUP BY source),
 a AS (SELECT source, round(coalesce(avg(rating), 0), 6) AS avg_rating, count(*) AS chunks, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS l, count(DISTINCT lang) AS n FROM r GROUP BY source)
 SELECT source AS source_id, avg_rating, chunks, context, '<memory_context>' || chr(10) || context || chr(10) || '</memory_context>' || chr(10) || chr(10) || 'Aufgabe: Analysiere den Code in `' || source || '` (Kategorien: ' || l || ') und beschreibe die Hauptverantwortlichkeiten.' AS prompt,
 'Der Memory-Kontext für `' || source || '` enthält ' || chunks || ' Chunk(s) über ' || n || ' Kategorie(n). Erkannte Labels: ' || l || '.' AS completion FROM a JOIN c USING (source)""")
def context_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumns({"source_id": F.col("repo"), "chunk_level": F.lit("file")})
    ratings = feedback(spark, d).where("signal <> 'neutral'")
    return training.context_pairs(c, ratings).drop("labels")


@query("""SELECT doc_id, CASE WHEN lang <> 'en' AND n_chars <= 1000 THEN '5' WHEN lang <> 'en' OR n_chars <= 1000 THEN '4' ELSE '2' END AS signal FROM documents ANTI JOIN labels USING (doc_id)""")
def auto_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Languages but English count as labels, short texts as functions."""
    labels = F.when(F.col("workspace_id") == "en", F.array().cast("array<string>")).otherwise(F.col("category_labels"))
    c = chunks(spark, d).withColumns({"category_labels": labels, "chunk_level": F.when(F.col("size") <= 1000, "function").otherwise("file"), "quality_score": F.col("size") / 10000.0})
    return training.auto_feedback(c, feedback(spark, d)).withColumnRenamed("chunk_id", "doc_id")


@query("""SELECT DISTINCT h AS prompt_hash FROM (SELECT sha256(role || chr(10) || text)[1:16] AS h FROM conversations) WHERE h NOT IN (SELECT sha256(role || chr(10) || text)[1:16] FROM conversations WHERE turn = 0)""")
def batch_export_diff(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("turn", F.col("role").alias("system"), F.col("text").alias("user"))
    done = turns.where("turn = 0").select(training.prompt_hash(F.col("system"), F.col("user")).alias("prompt_hash"))
    return training.export_diff(turns, done).select("prompt_hash")


@query("""WITH a AS (SELECT doc_id AS prompt_hash, lang AS label, 0 AS p FROM documents WHERE lang = 'en'), b AS (SELECT doc_id AS prompt_hash, CASE WHEN toxic = 1 THEN 'skip' ELSE 'good' END AS label, 1 AS p FROM labels WHERE toxic = 0 AND quality >= 0.5)
 SELECT prompt_hash, label FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY p, label) AS n FROM (FROM a UNION ALL FROM b)) WHERE n = 1""")
def merge_annotations(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("prompt_hash"), F.col("lang").alias("label"))
    new = table(spark, d, "labels").select(F.col("doc_id").alias("prompt_hash"), F.when(F.col("toxic") == 1, "skip").alias("label"), F.col("quality").cast("double").alias("quality"))
    return dedup.merge_annotations(old, [new]).select("prompt_hash", "label")


@query("""SELECT chunk_id, coalesce(arg_max(signal, id) FILTER (signal = 'positive'), arg_min(signal, id)) AS signal FROM
 (SELECT user_id AS chunk_id, event_id AS id, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS signal FROM events) GROUP BY chunk_id""")
def best_signals(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    return fb.best_signal(table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("id"), kind.alias("signal")))


@query("""SELECT strftime(ts, '%Y-%m') AS month, sum(value::BIGINT) AS input_tokens, sum(user_id) AS output_tokens, round(sum((value::BIGINT + user_id) / 1e6 * CASE event_type WHEN 'click' THEN 3.0 WHEN 'view' THEN 0.5 ELSE 0.0 END), 6) AS cost,
 count(*) AS sessions FROM (SELECT * REPLACE (floor(value) AS value) FROM events) GROUP BY 1""")
def month_costs(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 3.0), ("view", 0.5)], "model string, price double")
    rows = table(spark, d, "events").select("ts", F.col("event_type").alias("model"), F.floor("value").cast("long").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return fb.month_costs(rows, prices)


@query("""WITH r AS (SELECT event_type AS trigger, count(*) OVER w AS f, sum((value > 95)::INT) OVER w AS g FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))
 SELECT trigger, max(f) AS fires, max(g)::BIGINT AS "references", NOT bool_or(f >= 50 AND g / f < 0.1) AS active FROM r GROUP BY trigger""")
def trigger_stats(spark: SparkSession, d: str) -> DataFrame:
    return fb.trigger_stats(table(spark, d, "events").select(F.col("event_type").alias("trigger"), "event_id", (F.col("value") > 95).cast("int").alias("referenced")))


@query("""SELECT conv_id, turn, excerpt FROM (SELECT conv_id, turn, substr(text, 1, 500) AS excerpt, sum(length(substr(text, 1, 500))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM conversations) WHERE run <= 3000""")
def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 500).alias("excerpt"))
    return retrieval.budget_prefix(turns, "conv_id", ["turn"], F.length("excerpt"), 3000)


@query("SELECT doc_id, text FROM documents WHERE (n_chars, doc_id) > (500, 50) ORDER BY n_chars, doc_id LIMIT 200")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    after = (F.col("n_chars") > 500) | ((F.col("n_chars") == 500) & (F.col("doc_id") > 50))
    return table(spark, d, "documents").where(after).orderBy("n_chars", "doc_id").limit(200).select("doc_id", "text")


@query("""SELECT event_id, round(greatest(0.0, 1 - (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000 / 30.0), 9) AS recency FROM events""")
def recency_scores(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-31").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.round(retrieval.recency_score(F.col("ts").cast("timestamp"), now), 9).alias("recency"))
