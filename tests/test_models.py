from pyspark.sql import functions as F

from strataloom.functions import models
from strataloom.operators import reports


def test_stub_is_pure_and_distinct_texts_are_sent_once(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in models.embedded(rows, "text").collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and got[3] is None
    assert models.stub_vector("a b") == models.stub_vector("b a")


def test_failed_call_is_neutral(spark):
    def call(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["rejected" if "wrong" in p else "ok" for p in prompts]

    rows = spark.createDataFrame([(1, "bad"), (2, "wrong"), (3, "fine")], "id int, text string")
    judged = models.verdicts(rows, F.col("text"), models.Model(reply=call))
    assert {r.id: r.verdict for r in judged.collect()} == {1: "error", 2: "rejected", 3: "confirmed"}
    assert sorted(r.id for r in models.kept(judged).collect()) == [1, 3]


def test_categories(spark):
    def call(prompts):
        return ["1. thought\nKategorien: API, [neu]queue, aaaaaaa, [neu]api" if "x" in p else "" for p in prompts]

    rows = spark.createDataFrame([("x", "src/a.py"), ("y", "src/db/a.py"), ("x", "tests/test_a.py"), ("y", "zz")], "text string, path string")
    run = lambda mode: {r.path: (r.category_labels, r.category_source, r.category_confidence) for r in models.categorized(rows, ["api", "tests"], F.col("text"), F.col("path"), models.Model(reply=call), mode).collect()}
    got = run("hybrid")
    assert got["src/a.py"] == (["api", "[neu]queue", "api"], "hybrid", 1.0) and got["tests/test_a.py"][0] == ["api", "[neu]queue", "api", "tests"]
    assert got["src/db/a.py"] == (["data_access"], "fallback", 0.5) and got["zz"] == ([], "fallback", 0.0)
    assert run("deductive")["src/a.py"][0] == ["api"]
    assert run("inductive")["src/a.py"][0] == ["API", "[neu]queue", "aaaaaaa", "[neu]api"]


def test_views_and_advice(spark):
    rows = spark.createDataFrame([("s", "c", "One. Two.")], "source_id string, chunk_id string, text string")
    assert [r.level for r in models.views(rows).orderBy("ordinal").collect()] == ["view_facts", "view_decisions", "view_entities", "view_keywords", "view_full"]
    assert models.advice(rows, "q").first().advice == 0.5
    assert models.advice(rows, "q", models.Model(reply=lambda p: [" 0.7 "] * len(p))).first().advice == 0.7


def test_reports(spark):
    found = spark.createDataFrame([("a.py", "smell", "critical", "high", 0), ("b.py", "smell", "odd", None, 0)], "filename string, type string, severity string, confidence string, pos int")
    changes = spark.createDataFrame([("a.py", "added")], "filename string, status string")
    text = reports.findings_report(found, changes, "r", "run1")
    assert "added: 1" in text and "2 in all: 1 critical" in text
    nodes = spark.createDataFrame([("a", "c1", "deep"), ("b", "c1", "deep"), ("d", None, "skip")], "id string, cluster_id string, turbulence_tier string")
    edges = spark.createDataFrame([("a", "b", 2.0), ("d", "a", 1.0)], "source string, target string, weight double")
    text = reports.node_context(nodes, edges, "a")
    assert text == "Cluster: b\nUsed by: d\nUses: b\nHot neighbours: b"
    assert reports.node_context(nodes, edges, "zz") == ""


def test_recap(spark):
    rows = spark.createDataFrame([("1", "issue:o/r:7", "x", "issue", 0.9), ("2", "s", "see #7 now", "goal", 0.5), ("3", "s", "see #77", "goal", 0.9)], "chunk_id string, source_id string, text string, igio_axis string, igio_confidence double").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    got = reports.recap(rows, "7").collect()
    assert sorted(r.chunk_id for r in got) == ["1", "2"]
    assert "- see #7 now" in reports.recap_markdown("7", got)


def test_conflict_merge(spark):
    schema = "source string, target string, type string, weight double, validated boolean"
    a = spark.createDataFrame([("a", "b", "t", 1.0, True), ("a", "c", "t", 1.0, False), ("a", "d", "t", 1.0, True)], schema)
    b = spark.createDataFrame([("a", "b", "t", 2.0, False), ("a", "c", "t", 2.0, True), ("a", "d", "t", 2.0, True)], schema)
    got = {r.target: (r.weight, r.validated, r.review) for r in reports.conflict_merge(a, b).collect()}
    assert got == {"b": (1.0, True, False), "c": (2.0, True, False), "d": (2.0, True, True)}
