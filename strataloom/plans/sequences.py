"""Diffs, windows, transitions and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import text as T
from ..operators import chunkers, diff, metrics, transitions, turbulence
from ..sources.adapters import chunks, file_versions, table
from .registry import query

_SNAP = "SELECT o_custkey AS filename, sha256(max(o_orderkey)::VARCHAR) AS hash, count(*) AS size FROM orders WHERE o_orderdate < DATE '1997-{:02d}-01' GROUP BY o_custkey"
_STATUS = "CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' ELSE 'unchanged' END"


@query(f"SELECT coalesce(a.filename, b.filename) AS filename, {_STATUS} AS status FROM ({_SNAP.format(3)}) a FULL JOIN ({_SNAP.format(9)}) b ON a.filename = b.filename")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.snapshot_diff(file_versions(spark, d, 3), file_versions(spark, d, 9))


_FIND = "SELECT o_custkey || '::' || o_orderpriority || '::' AS key, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE year(o_orderdate) = {} GROUP BY 1"


@query(f"""SELECT key, status FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.s IS NULL THEN 'new' WHEN b.s IS NULL THEN 'resolved' WHEN a.s <> b.s THEN 'severity_changed' END AS status
 FROM ({_FIND.format(1996)}) a FULL JOIN ({_FIND.format(1997)}) b ON a.key = b.key) WHERE status IS NOT NULL""")
def run_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("filename"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("severity"), F.lit("").alias("evidence_excerpt"), F.col("o_orderkey").alias("pos"), F.year("o_orderdate").alias("y"))
    return diff.run_compare(rows.where("y = 1996"), rows.where("y = 1997")).select("key", "status")


@query(f"""WITH n AS ({_SNAP.format(9)}), h AS (SELECT o_custkey AS filename, sha256(o_orderkey::VARCHAR) AS hash, arg_max(o_orderdate, o_orderkey) AS analyzed_at FROM orders WHERE o_orderdate < DATE '1997-03-01' GROUP BY 1, 2)
 SELECT n.filename, h.analyzed_at FROM n LEFT JOIN h USING (filename, hash)""")
def carry_forward_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderdate < '1997-03-01'")
    history = o.select(F.col("o_custkey").alias("filename"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"), F.lit("r").alias("run_key"), F.col("o_orderdate").alias("analyzed_at"), F.col("o_orderkey").alias("snapshot_id"))
    return diff.carry_forward(file_versions(spark, d, 9).withColumn("run_key", F.lit("r")), history).select("filename", "analyzed_at")


@query("""SELECT c.c_custkey AS key, d.day AS "at", o.o_orderkey, o.o_totalprice FROM customer c CROSS JOIN (VALUES (TIMESTAMP '1995-06-30'), (TIMESTAMP '1997-06-30')) d(day)
 LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey AND o_orderdate <= d.day ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true""")
def asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("t")).agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("r"))
    snaps = last.select("key", F.col("t").cast("timestamp").alias("t"), "r.*")
    days = F.array(F.lit("1995-06-30").cast("timestamp"), F.lit("1997-06-30").cast("timestamp"))
    dates = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.explode(days).alias("at"))
    return diff.as_of(snaps, dates, "key", "t").select("key", F.col("at").cast("timestamp_ntz").alias("at"), "o_orderkey", "o_totalprice")


_PAIRS = "SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE year(l_shipdate) = {}"


@query(f"SELECT *, 'added' AS change FROM ({_PAIRS.format(1997)} EXCEPT {_PAIRS.format(1996)}) UNION ALL SELECT *, 'removed' FROM ({_PAIRS.format(1996)} EXCEPT {_PAIRS.format(1997)})")
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.year("l_shipdate").alias("y"))
    return diff.graph_diff(rows.where("y = 1996"), rows.where("y = 1997"), ["source", "target"])


@query("SELECT o_orderkey AS filename, o_totalprice AS size FROM orders ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 100")
def risk_topk(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("filename"), F.col("o_totalprice").alias("size"), "o_orderpriority")
    return diff.select_top(files, F.col("o_orderpriority") == "1-URGENT", 100).where("selected").select("filename", "size")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 5")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return diff.beyond_newest(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_orderkey")


_SEQ = "SELECT user_id AS file, event_id AS pos, event_type AS category FROM events"
_TURB = f"""SELECT file, pos, CASE WHEN count(*) OVER (PARTITION BY file) < 2 THEN 0.0 ELSE
 len(list_filter(generate_series(1, len(l) - 1), lambda i: l[i] <> l[i + 1])) / greatest(1, len(l) - 1) * (len(list_distinct(l)) / 6.0) END AS score
 FROM (SELECT *, list(category) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM ({_SEQ}))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return turbulence.turbulence(table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), F.col("event_type").alias("category")))


@query(f"SELECT file, count(*) AS n, round(avg(score), 3) AS turbulence, CASE WHEN count(*) < 3 THEN 'stable' WHEN round(avg(score), 3) < 0.2 THEN 'skip' WHEN round(avg(score), 3) < 0.5 THEN 'light' ELSE 'deep' END AS tier FROM ({_TURB}) GROUP BY file")
def turbulence_score(spark: SparkSession, d: str) -> DataFrame:
    return turbulence.file_scores(_scored(spark, d))


@query(f"""WITH s AS ({_TURB}), h AS (SELECT *, score > 0.6 AS hot, max(score) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS peak FROM s),
 n AS (SELECT *, CASE WHEN hot AND NOT coalesce(lag(hot) OVER (PARTITION BY file ORDER BY pos), false) THEN 1 ELSE 0 END AS fresh FROM h),
 z AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS zone FROM n)
 SELECT file, zone, min(pos) AS start, max(pos) AS "end", round(arg_max(peak, pos), 3) AS peak_score, round(max(score), 3) AS zone_max FROM z WHERE hot GROUP BY file, zone""")
def hot_zones(spark: SparkSession, d: str) -> DataFrame:
    return turbulence.hot_zones(_scored(spark, d), least=0.6)


@query(f"SELECT tier, count(*) AS files FROM (SELECT CASE WHEN count(*) < 3 THEN 'stable' WHEN round(avg(score), 3) < 0.2 THEN 'skip' WHEN round(avg(score), 3) < 0.5 THEN 'light' ELSE 'deep' END AS tier FROM ({_TURB}) GROUP BY file) GROUP BY tier")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return turbulence.file_scores(_scored(spark, d)).groupBy("tier").agg(F.count(F.lit(1)).alias("files"))


_TRANS = "SELECT from_topic, to_topic, count(*) AS count FROM (SELECT event_type AS from_topic, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS to_topic FROM events) WHERE from_topic <> to_topic GROUP BY ALL"


@query(_TRANS)
def topic_transitions(spark: SparkSession, d: str) -> DataFrame:
    return transitions.transitions(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_topic ORDER BY probability DESC, to_topic) AS rank FROM
 (SELECT from_topic, to_topic, round(count / sum(count) OVER (PARTITION BY from_topic), 6) AS probability FROM ({_TRANS}))) WHERE rank <= 3""")
def next_topics(spark: SparkSession, d: str) -> DataFrame:
    return transitions.next_topics(transitions.transitions(table(spark, d, "events"), "user_id", "event_id", "event_type"))


@query("""SELECT event_id, round((CASE WHEN s THEN greatest(b * exp(-a / 14.0), 0.9) ELSE b * exp(-a / 14.0) END) + 0.2 * least(user_id % 5, 3), 4) AS score FROM (SELECT *, CASE WHEN s THEN 0.9 ELSE 0.5 END + CASE WHEN a < 1 THEN 0.3 ELSE 0.0 END AS b
 FROM (SELECT *, event_type = 'purchase' AS s, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000 AS a FROM events))""")
def decay_score(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    return table(spark, d, "events").select("event_id", transitions.decay_score(age, F.col("event_type") == "purchase", F.col("user_id") % 5).alias("score"))


@query("""SELECT id, topic, min(pos) AS pos FROM (SELECT doc_id AS id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_-]+)', 1), lambda x: trim(x, '-')), lambda x: regexp_matches(x, '^[a-z][a-z0-9_-]{2,}$')) AS w FROM documents))
 JOIN (VALUES ('and', 'joining'), ('or', 'joining'), ('the', 'naming'), ('le', 'naming'), ('der', 'naming')) i(word, topic) USING (word) GROUP BY id, topic""")
def topics_of_texts(spark: SparkSession, d: str) -> DataFrame:
    index = spark.createDataFrame([("and", "joining"), ("or", "joining"), ("the", "naming"), ("le", "naming"), ("der", "naming")], "word string, cluster string")
    return transitions.topics_of(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), index)


RULES = [("feed", ["re:utm_source=feed"]), ("html", ["*.html"]), ("german", ["**/de/**"]), ("query", ["re:[?]"])]


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)utm_source=feed') THEN 'feed' WHEN regexp_matches(url, '(?i)[.]html$') THEN 'html' WHEN regexp_matches(url, '(?i)de/.*$') THEN 'german'
 WHEN regexp_matches(url, '[?]') THEN 'query' ELSE 'uncategorized' END AS category FROM pages""")
def rule_categorize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", globs.categorize(F.col("url"), RULES).alias("category"))


@query("SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '(?i)[.]html$') OR regexp_matches(url, '(?i)#top'))")
def glob_exclude(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(~globs.matches(F.col("url"), ["*.html", "re:#top"])).select("page_id", "url")


def _igio_sql() -> str:
    case = " ".join(f"WHEN regexp_matches(text, '(?i{m}){p}') THEN '{a}:{c}'" for a, c, m, p in T.IGIO_RULES)
    return f"SELECT doc_id, split_part(x, ':', 1) AS axis, coalesce(try_cast(split_part(x, ':', 2) AS DOUBLE), 0.0) AS confidence FROM (SELECT doc_id, CASE {case} ELSE '' END AS x FROM documents)"


@query(_igio_sql())
def igio_fast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.igio_axis(F.col("text")).alias("a")).select("doc_id", "a.axis", "a.confidence")


@query()
def code_density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.code_density(F.col("text")), 6).alias("density"), T.natural_words(F.col("text")).alias("words"))


@query()
def prefilter_conversation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.skip_reason(F.col("text"), F.lit("conversation_summary")).alias("reason"))


@query("""SELECT p_partkey, label, regexp_matches(label, '^[a-z0-9äöüß_-]{2,30}$') AND (length(label) < 5 OR list_max(list_transform(list_distinct(string_split(label, '')), lambda c: len(list_filter(string_split(label, ''), lambda x: x = c)))) <= 0.6 * length(label)) AS plausible
 FROM (SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS label FROM part)""")
def plausible_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_type", " ", "_")).alias("label"))
    return rows.withColumn("plausible", T.plausible_label(F.col("label")))


@query("""SELECT doc_id, 'section' AS level, i - 1 AS ordinal, trim('L ' || part) AS name, regexp_replace('## L ' || part, '\\s+$', '') AS text FROM
 (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))""")
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """documents have no headings: each line becomes one here."""
    body = F.concat(F.lit("## L "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## L ")), F.lit("\n"))
    got = chunkers.markdown_chunks(table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), body.alias("text")))
    return got.select(F.col("source_id").alias("doc_id"), "level", "ordinal", "name", "text")


@query()
def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("notes.md").alias("filename"), "text")
    return chunkers.structural_chunks(docs).select("source_id", "level", "ordinal", "chunk_id", "text_hash")


_CUT = r"regexp_matches(lines[i + 1], '^\s*$') OR regexp_matches(lines[i + 1], '^\s*((function|public|private|protected|class|def) .*\S|<\?php)')"
_END = f"least(n, CASE WHEN {{0}} + 15 >= n THEN n ELSE coalesce(list_max(list_filter(range({{0}} + 11, {{0}} + 16), lambda i: {_CUT})), {{0}} + 15) END)"


@query(f"""WITH RECURSIVE t AS (SELECT doc_id AS file, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN lines[:-2] ELSE lines END AS lines FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS text, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS lines FROM documents)),
 l AS (SELECT file, lines, len(lines) AS n FROM t WHERE len(lines) > 0),
 b AS (SELECT file, lines, n, 0::BIGINT AS s, ({_END.format("0")})::BIGINT AS e FROM l UNION ALL SELECT file, lines, n, e, ({_END.format("e")})::BIGINT FROM b WHERE e < n)
 SELECT file, (s + 1)::INTEGER AS start_line, e::INTEGER AS end_line, array_to_string(lines[s + 1:e], chr(10)) AS code FROM b""")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """documents with a line for each sentence."""
    lines = F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))
    return chunkers.line_blocks(table(spark, d, "documents").select(F.col("doc_id").alias("file"), lines.alias("text")))


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    got = rows.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return got.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "events")


@query("SELECT time_bucket(INTERVAL 60 SECOND, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def activation_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "60 seconds").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


@query("""SELECT count(*) AS total, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'info') AS info FROM
 (SELECT CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'warning' WHEN 'P' THEN 'info' END AS s, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE 2 END AS c FROM orders) WHERE c <= 1""")
def findings_summary(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "warning").when(F.col("o_orderstatus") == "P", "info")
    sure = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    return metrics.findings_summary(table(spark, d, "orders").select(severity.alias("severity"), sure.alias("confidence")), "medium")


@query("SELECT conv_id, turn, role, round(len(list_filter(['the', 'and', 'xyz'], lambda k: contains(lower(text), k))) / 3, 2) AS hit_ratio FROM conversations")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("keywords", F.array(*[F.lit(k) for k in ("the", "and", "xyz")]))
    return metrics.keyword_hits(rows, answer="text").select("conv_id", "turn", "role", "hit_ratio")


@query("SELECT lang, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def workspace_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy(F.col("workspace_id").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text_hash").alias("texts"))
