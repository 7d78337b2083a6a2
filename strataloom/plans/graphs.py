"""Vectors, graphs and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import diff, graph, metrics, retrieval, turbulence
from ..sources.adapters import order_edges, table
from .registry import query

_COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"


@query(f"""SELECT vec_id AS id, round({_COS.format("e.embedding", "q.embedding")}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    score = F.round(cosine(F.col("embedding"), F.col("q")), 6)
    return e.join(F.broadcast(one)).select(F.col("vec_id").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(20)


_KNN = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
 (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS.format("q.embedding", "e.embedding")}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= {{}}"""


def _knn(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), e.select(F.col("vec_id").alias("id"), "embedding"), k)


@query(_KNN.format(5))
def vector_knn_join(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, 5)


@query("SELECT label, i - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(f"""WITH m AS (SELECT label, list(mean ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
 SELECT a.label AS source, b.label AS target, round({_COS.format("a.v", "b.v")}, 6) AS weight FROM m a JOIN m b ON a.label < b.label WHERE {_COS.format("a.v", "b.v")} >= -1""")
def concept_links(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of the mean vectors of all pairs of the few groups, which are a bounded vocabulary."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = rows.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    a, b = means.select(F.col("label").alias("source"), F.col("v").alias("va")), means.select(F.col("label").alias("target"), F.col("v").alias("vb"))
    return a.join(b, F.col("source") < F.col("target")).select("source", "target", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("weight"))


_RANKED = _KNN.format(11)


def _judged(spark: SparkSession, d: str):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    queries = labels.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label")
    ranked = _knn(spark, d, 11).where("id <> query_id").withColumn("rank", F.col("rank") - 1)
    return queries, labels, metrics.judged_by_label(ranked, queries, labels)


_REL = "SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id"


@query(f"SELECT round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM (SELECT r.query_id, min(r.rank - 1) FILTER (l.id IS NOT NULL) AS first FROM ({_RANKED}) r LEFT JOIN ({_REL}) l USING (query_id, id) WHERE r.id <> r.query_id GROUP BY r.query_id)")
def mrr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_mrr(_judged(spark, d)[2])


@query(f"""SELECT round(avg(coalesce(h, 0) / n), 6) AS recall FROM (SELECT query_id, count(*) AS n FROM ({_REL}) GROUP BY query_id) LEFT JOIN
 (SELECT query_id, count(*) AS h FROM ({_RANKED}) r JOIN ({_REL}) l USING (query_id, id) WHERE r.rank - 1 <= 5 GROUP BY query_id) USING (query_id)""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    queries, labels, judged = _judged(spark, d)
    return metrics.label_recall(judged, queries, labels, 5)


@query("""SELECT k, round(CASE WHEN len(t) > 0 THEN b / len(t) ELSE 0 END, 4) AS recall, round(CASE WHEN len(s) > 0 THEN b / len(s) ELSE 0 END, 4) AS precision, round(CASE WHEN b > 0 THEN 2 * (b / len(t)) * (b / len(s)) / (b / len(t) + b / len(s)) ELSE 0 END, 4) AS f1
 FROM (SELECT *, len(list_intersect(t, s)) AS b FROM (SELECT o_custkey AS k, coalesce(list(DISTINCT o_orderpriority) FILTER (year(o_orderdate) = 1996), []) AS t, coalesce(list(DISTINCT o_orderpriority) FILTER (year(o_orderdate) = 1997), []) AS s FROM orders GROUP BY 1))""")
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    p = lambda y: F.collect_set(F.when(F.year("o_orderdate") == y, F.col("o_orderpriority")))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(p(1996).alias("truth"), p(1997).alias("suggested"))
    return metrics.set_f1(rows).select("k", "recall", "precision", "f1")


_RUNS = "SELECT l_suppkey AS name, count(DISTINCT l_orderkey) AS files, count(*) AS findings, count(*) FILTER (l_returnflag = 'R') AS pe, count(*) FILTER (l_discount > 0.05) AS high FROM lineitem GROUP BY 1"


@query(f"""SELECT name, score, CASE WHEN score >= 90 THEN 5 WHEN score >= 70 THEN 4 WHEN score >= 50 THEN 3 WHEN score >= 25 THEN 2 ELSE 1 END AS stars FROM (SELECT name, round(100 * raw / max(raw) OVER ())::INT AS score FROM
 (SELECT name, findings / greatest(files, 1) * (1 - pe / greatest(files, 1)) * greatest(high / greatest(findings, 1), 0.1) AS raw FROM ({_RUNS})))""")
def bench_score_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(
        F.countDistinct("l_orderkey").alias("files"), F.count(F.lit(1)).alias("findings"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("parse_errors"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("high")
    )
    return metrics.bench_scores(rows).select("name", "score", "stars")


_LP = "SELECT DISTINCT l_partkey AS t, l_suppkey AS n FROM lineitem"
_EDGES = f"SELECT a.n AS source, b.n AS target, count(*) AS weight FROM ({_LP}) a JOIN ({_LP}) b ON a.t = b.t AND a.n < b.n GROUP BY ALL"


@query(_EDGES)
def shared_type_edges(spark: SparkSession, d: str) -> DataFrame:
    return order_edges(spark, d)


@query(f"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n) AS r FROM ({_LP})) WHERE r <= 10)
 SELECT a.n AS source, b.n AS target, list_reduce(list_sort(list(DISTINCT a.t::VARCHAR)), lambda x, y: CASE WHEN contains(x, y) THEN x ELSE x || ',' || y END) AS context, 'label_cooccurrence' AS type, round(sum(0.5::DOUBLE), 3) AS weight FROM c a JOIN c b ON a.t = b.t AND a.n < b.n GROUP BY a.n, b.n""")
def label_cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged_edges(graph.shared_token_edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "label_cooccurrence", 0.5, most=10))


_TYPED = "SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS type, l_quantity AS weight, l_linestatus AS context FROM lineitem"


@query(f"SELECT source, target, type, round(sum(weight), 3) AS weight, string_agg(DISTINCT context, ',' ORDER BY context) AS context FROM ({_TYPED}) GROUP BY source, target, type")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged_edges(_typed(spark, d))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), F.col("l_linestatus").alias("context"))


@query(f"SELECT k.type, coalesce(count(e.type), 0) AS edges, coalesce(round(avg(weight), 3), 0.0) AS avg_weight FROM (VALUES ('A'), ('N'), ('R'), ('X')) k(type) LEFT JOIN ({_TYPED}) e ON e.type = k.type GROUP BY k.type")
def edge_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_stats(_typed(spark, d), ["A", "N", "R", "X"])


@query(f"SELECT least(source, target) AS a, greatest(source, target) AS b, type, max(weight) AS weight FROM ({_TYPED}) GROUP BY ALL")
def strongest_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.strongest_undirected(_typed(spark, d))


@query(f"SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source AS id, 1 AS o, 0 AS i FROM ({_EDGES}) UNION ALL SELECT target, 0, 1 FROM ({_EDGES}) UNION ALL SELECT s_suppkey, 0, 0 FROM supplier) GROUP BY id")
def degree_table(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(order_edges(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("""WITH g AS (SELECT o_orderkey, o_custkey, CASE WHEN date_diff('day', lag(o_orderdate) OVER w, o_orderdate) <= 180 THEN 0 ELSE 1 END AS fresh, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY r ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT o_orderkey AS id, min(o_orderkey) OVER w AS component FROM i WINDOW w AS (PARTITION BY o_custkey, n) QUALIFY count(*) OVER w > 1""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders hang together where the next comes within 180 days."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.lag("o_orderkey").over(w).alias("target"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))
    return graph.components(rows.where("days <= 180").select("source", "target"))


@query(f"""SELECT (SELECT count(DISTINCT s_nationkey) FROM supplier) AS clusters, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) = 1)) AS singletons,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)) AS largest, count(*) AS edges, count(*) FILTER (a.s_nationkey = b.s_nationkey) AS internal, count(*) - count(*) FILTER (a.s_nationkey = b.s_nationkey) AS external
 FROM ({_EDGES}) e LEFT JOIN supplier a ON a.s_suppkey = source LEFT JOIN supplier b ON b.s_suppkey = target""")
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    return graph.cluster_quality(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cluster")), order_edges(spark, d))


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY weight DESC, other) AS rank FROM (SELECT CASE WHEN source = 5 THEN 'out' ELSE 'in' END AS direction, CASE WHEN source = 5 THEN target ELSE source END AS other, weight FROM ({_EDGES}) WHERE source = 5 OR target = 5)) WHERE rank <= 5""")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(order_edges(spark, d), 5)


@query("""SELECT split_part(cluster, '/', 1) AS cluster, count(*) AS size, split_part(min(id), '/', 2) AS name FROM (SELECT n_name || '/' || s_name AS id, n_name AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY cluster""")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_name", "s_name").alias("id"), F.col("n_name").alias("cluster"))
    return graph.cluster_names(rows)


@query()
def louvain_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Communities of suppliers by common parts, over the graph of all suppliers, which is one group; a connected component is in one task."""
    e = order_edges(spark, d).select(F.lit("all").alias("grp"), "source", "target", F.col("weight").cast("double").alias("weight"))
    return graph.louvain(e, "grp")


@query()
def redundant_names(spark: SparkSession, d: str) -> DataFrame:
    """Like names of parts among different brands, each name of a brand once."""
    rows = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("ord"))
    return turbulence.redundancies(rows.select("ord", F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_name").alias("code")))


@query("""SELECT l_suppkey AS source, l_partkey AS target, count(*) AS n, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS type FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) > 1""")
def repeated_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linestatus").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").alias("validated")
    )
    return diff.edge_conflicts(rows)


@query("""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def passage_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that contain a passage: those with the passage's longest inner word are candidates, the text decides.

    Passages of fewer than three words have no inner word; all texts are scanned for each of these few."""
    inner = F.slice(F.split("text", " "), 2, F.size(F.split("text", " ")) - 2)
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    every, long = table(spark, d, "benchmark"), F.size(F.split("text", " ")) >= 3
    passages = every.where(long).select("item_id", F.col("text").alias("passage"), longest.alias("word"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    likely = words.join(passages.select("item_id", "word"), "word").select("doc_id", "item_id").join(passages.select("item_id", "passage"), "item_id")
    found = docs.join(likely, "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    short = every.where(~long).select("item_id", F.col("text").alias("passage"))
    return found.unionByName(docs.join(short, F.contains("text", F.col("passage"))).select("item_id", "doc_id"))
