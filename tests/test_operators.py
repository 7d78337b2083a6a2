import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from strataloom.functions import profiles
from strataloom.operators import ambient, chunkers, dedup, diff, feedback, graph, metrics, retrieval, training, turbulence
from strataloom.sources import readers
from strataloom.sources.tables import upserted
from strataloom.streaming import jobs


def test_scope_keeps_tenants_apart(spark):
    rows = [("a", "s1", True), ("b", "s2", True), ("c", "s3", True), ("d", "s1", False)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_id string, is_active boolean").withColumns({"workspace_id": F.when(F.col("chunk_id") == "b", "w2").otherwise("w1"), "category_labels": F.array(F.lit("Api"))})
    sources = spark.createDataFrame([("s1", "r", "repo_file", "private", None), ("s2", "r", "repo_file", "private", None), ("s3", "r", "repo_file", "org", "o1")], "source_id string, repo string, source_type string, visibility string, org_id string")
    ids = lambda **k: sorted(r.chunk_id for r in retrieval.in_scope(chunks, sources, **k).collect())
    assert ids(workspace="w1") == ["a"]
    assert ids(workspace="w1", org="o1") == ["a", "c"]
    assert ids(workspace="w2") == ["b"]
    assert ids(categories=["api"]) == ["a", "b", "c"]
    assert ids(categories=["ui"]) == []


def test_compressed_context(spark):
    rows = [("c1", "s1", 0.9, "x" * 200, ""), ("c2", "s1", 0.8, "y", ""), ("c3", "s2", 0.7, "z" * 600, "short summary")]
    df = spark.createDataFrame(rows, "chunk_id string, source_id string, score_final double, text string, summary string")
    text = retrieval.compressed(df, 400).first().context
    assert text == "## Memory Context\n\n- [?] s1\n  " + "x" * 187 + "...\n- [?] s2\n  short summary"
    assert len(text) <= 400
    assert retrieval.compressed(df, 20).first().context == ""


def test_recency(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    ages = [F.lit(x).cast("timestamp") for x in ("2024-02-01", "2024-01-17", "2023-01-01")]
    got = spark.range(1).select(*[retrieval.recency_score(a, now) for a in ages], retrieval.recency_score(F.lit(None).cast("timestamp"), now)).first()
    assert list(got) == [1.0, 0.5, 0.0, 0.0]


def test_as_of(spark):
    snaps = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("j", 9, "c")], "key string, t int, v string")
    dates = spark.createDataFrame([("k", 0), ("k", 4), ("k", 5), ("j", 1)], "key string, at int")
    got = {(r.key, r["at"]): r.v for r in diff.as_of(snaps, dates, "key", "t").collect()}
    assert got == {("k", 0): None, ("k", 4): "a", ("k", 5): "b", ("j", 1): None}


def test_conflicts(spark):
    t = dt.datetime
    rows = [(1, "a", "b", "x", True, t(2024, 1, 1)), (2, "a", "b", "y", True, t(2024, 1, 2)), (3, "a", "b", "z", False, t(2024, 1, 3)), (4, "a", "c", "x", True, t(2024, 1, 1))]
    edges = spark.createDataFrame(rows, "id long, source string, target string, type string, validated boolean, discovered_at timestamp")
    assert [tuple(r) for r in diff.edge_conflicts(edges).collect()] == [("a", "b", 2, "x")]
    assert sorted(r.id for r in diff.resolved_conflicts(edges).collect()) == [2, 3, 4]


def test_turbulence_cases(spark):
    def score(cats):
        rows = spark.createDataFrame([("f", i, c) for i, c in enumerate(cats)], "file string, pos int, category string")
        return turbulence.file_scores(turbulence.turbulence(rows)).first()

    assert score(["A"] * 10).turbulence == 0
    assert score(["A"]).tier == "stable"
    wild = score(["D", "U", "K", "C", "S"] * 4)
    assert wild.turbulence > 0.7 and wild.tier == "deep"


def test_heuristic_category_ties(spark):
    got = lambda code: spark.createDataFrame([(code,)], "c string").select(turbulence.heuristic_category(F.col("c"))).first()[0]
    assert got("plain") == "Logik"
    assert got("env") == "Logik"
    assert got("return [") == "Logik"
    assert got("$a->save(); User::find(1)") == "Daten"
    assert got("an agent") == "KI"


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "source int, target int")
    assert {r.id: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    clique = lambda ns: [(a, b, 1.0) for a in ns for b in ns if a < b]
    got = graph.communities([*clique([1, 2, 3, 4]), *clique([5, 6, 7, 8]), (4, 5, 1.0)])
    assert {got[n] for n in (1, 2, 3, 4)} == {1} and {got[n] for n in (5, 6, 7, 8)} == {5}
    files = spark.createDataFrame([("app/user_service.py",), ("app/service.py",), ("tests/test_service.py",)], "file string")
    deps = spark.createDataFrame([("x.py", "service"), ("x.py", "pkg\\\\my_user_service::run"), ("x.py", "zz")], "file string, dep string")
    assert sorted((r.context, r.target) for r in graph.resolved_imports(files, deps).collect()) == [("pkg\\\\my_user_service::run", "app/user_service.py"), ("service", "app/service.py")]
    assert [(r.source, r.target) for r in graph.coverage_edges(files).collect()] == [("tests/test_service.py", "app/service.py")]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("p", "c", 1)], "query_id string, id string, rank int")
    relevant = spark.createDataFrame([("q", "b")], "query_id string, id string")
    queries = spark.createDataFrame([("q",), ("p",)], "query_id string")
    assert metrics.mrr(ranked, relevant).first().mrr == 0.25
    assert metrics.recall_at_k(queries, ranked, relevant, 1).first().recall == 0.5
    assert metrics.recall_at_k(queries, ranked, relevant, 2).first().recall == 1.0
    sets = spark.createDataFrame([(["a", "b"], ["b", "c", "d"])], "truth array<string>, suggested array<string>")
    got = metrics.set_f1(sets).first()
    assert (got.recall, got.precision, got.f1) == (0.5, 0.3333, 0.4)


def test_python_and_js_chunks(spark):
    py = "import os\n\n@wrap\ndef f(x):\n    return x\n\nclass A:\n    def g(self): pass\n"
    assert [(p[0], p[2]) for p in chunkers.python_pieces(py)] == [("function", "f"), ("class", "A")]
    assert chunkers.python_pieces("def (") == []
    js = "function a() { if (1) { x() } }\nconst b = (y) => { return y }\nexport class C { m() {} }"
    assert [(p[0], p[2]) for p in chunkers.js_pieces(js)] == [("function", "a"), ("function", "b"), ("class", "C")]
    docs = spark.createDataFrame([("s", "a.py", py), ("t", "b.md", "no head"), ("u", "c.yaml", "a: 1\nb:\n  c: 2\n"), ("v", "x.py", None)], "source_id string, filename string, text string")
    got = {}
    for r in chunkers.structural_chunks(docs).collect():
        got.setdefault(r.source_id, []).append(r.name)
    assert got == {"s": ["f", "A"], "t": ["b.md"], "u": ["a", "b"], "v": ["x.py"]}


def test_markdown_and_paper(spark):
    docs = spark.createDataFrame([("m", "before\n# One\ntext\n## Two\nmore\n#### not\n")], "source_id string, text string")
    assert [(r.ordinal, r.name) for r in chunkers.markdown_chunks(docs).orderBy("ordinal").collect()] == [(0, "One"), (1, "Two")]
    paper = spark.createDataFrame([("p", "Title\nAbstract\nshort\n1 Introduction\nlong\nConclusion\nend")], "source_id string, text string")
    assert [r.level for r in chunkers.paper_chunks(paper).orderBy("ordinal").collect()] == ["abstract", "1", "conclusion"]
    keys = spark.createDataFrame([("j", '{"b": 1, "a": {"x": 2}}'), ("k", "[1]")], "source_id string, text string")
    assert [r.name for r in chunkers.json_chunks(keys).orderBy("ordinal").collect()] == ["a", "b"]


def test_smart_split():
    text = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(60)) + "def check_password():\n    return 1\n"
    got = chunkers.smart_split(text, "a.py", 300)
    assert len(got["blocks"]) == 61 and got["selected"][-1]["name"] == "check_password" and sum(len(b["text"]) for b in got["selected"]) <= 300
    assert got["skipped_summary"].startswith("Skipped (")
    assert chunkers.smart_split("x" * 500, "a.txt", 100)["selected"][0]["text"] == "x" * 100


def plain_blocks(text, size):
    """By the rule: of the ends that a block may have, the last one before a blank or defining line, else a full block."""
    lines, out, a = text.splitlines(), [], 0
    while a < len(lines):
        may = [e for e in range(a + size - 4, a + size + 1) if a + 5 < e < len(lines) and (not lines[e].strip() or lines[e].strip().startswith(chunkers.BLOCK_STARTS))]
        b = len(lines) if a + size >= len(lines) else max(may, default=a + size)
        out.append((a + 1, b, "\n".join(lines[a:b])))
        a = b
    return out


def test_line_blocks(spark):
    import random

    rng = random.Random(2)
    some = ["x", "", "  ", "def f():", "def ", " class A:", "<?php", "public x", "y = 1", "functions"]
    texts = ["a\n" * 30, "x\n" * 12 + "def f():\n" + "y\n" * 20, "", None, "one", "\n", "a\r\nb\rc"] + ["\n".join(rng.choices(some, k=rng.randrange(1, 80))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    for size in (15, 3, 8):
        got = {}
        for r in chunkers.line_blocks(docs, size).orderBy("file", "start_line").collect():
            got.setdefault(r.file, []).append((r.start_line, r.end_line, r.code))
        assert got == {i: plain_blocks(t, size) for i, t in enumerate(texts) if t}
    assert chunkers.line_blocks(docs.where("file = 1")).select("start_line", "end_line").collect() == [(1, 12), (13, 27), (28, 33)]


def test_components_fail_rather_than_stop_short(spark):
    edges = spark.range(60).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert graph.components(edges).select("component").distinct().count() == 1
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=1)


def test_verdicts(spark):
    members = spark.createDataFrame([(i, "a") for i in range(6)] + [(i, "b") for i in range(6, 9)], "id long, cluster string")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.1), (6, 7, 1.0), (5, 6, 9.0)], "source long, target long, weight double")
    verdicts = spark.createDataFrame([("a", graph.SPLIT), ("b", graph.SPLIT), ("c", graph.SPLIT)], "cluster string, action string")
    got = {r.id: r.cluster for r in graph.after_verdicts(members, verdicts, edges).collect()}
    assert got == {0: "0", 1: "0", 2: "0", 3: "3", 4: "3", 5: "3", 6: "b", 7: "b", 8: "b"}


def test_jobs_and_context(spark):
    jobs = spark.createDataFrame([(1, "queued", "local", "", 5), (2, "queued", "cloud", "gpu, big", 1), (3, "queued", "local", "", 2), (4, "running", "local", "", 1), (5, "queued", "cloud", "gpu,", 2)], "job_id long, status string, scope string, capability_required string, created_at long")
    jobs = jobs.withColumns({"started_at": F.lit(None).cast("long"), "worker_id": F.lit("")})
    assert {r.job_id: r.status for r in ambient.claimed(jobs, "w", F.lit(9)).collect()} == {1: "queued", 2: "queued", 3: "running", 4: "running", 5: "queued"}
    cloud = ambient.claimed(jobs, "w", F.lit(9), "cloud", ["gpu"]).where("worker_id = 'w'").collect()
    assert [(r.job_id, r.started_at) for r in cloud] == [(5, 9)]
    rows = spark.createDataFrame([(["a"], "c" * 600, "r", [1.0, 0.0], [1.0, 1.0], True), ([], "", "r", [1.0], [1.0], False), ([], "c", "r", None, [1.0], False)], "trigger_ids array<string>, context_text string, response string, context_vector array<double>, response_vector array<double>, led_to_retrieval boolean")
    got = ambient.context_feedback(rows).collect()
    assert [(r.relevance_score, r.was_referenced, len(r.context_text)) for r in got] == [(0.7071, True, 500), (0.0, False, 0), (0.0, False, 1)]
    tree = spark.createDataFrame([("a\n\u251c\u2500\u2500 artisan\n\u2514\u2500\u2500 composer.json",), ("x.py\nsetup.py",), ("x.py",)], "tree string")
    assert [r.p for r in tree.select(profiles.tree_profile(F.col("tree")).alias("p")).collect()] == ["laravel", "python", "universal"]


def test_redundancies(spark):
    """Against all pairs by difflib; the first of pairs with the same files and names counts."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    names = ["load_user", "load_users", "loadUser", "save_user", "x", "xy", "parse", "block_1", "render_page", "renderPages", "ä_ö", "nicht_erkannt"]
    rows = [(i, rng.choice("abc"), rng.choice(names), "code of " + rng.choice(names)) for i in range(40)]
    want, seen = {}, set()
    for i, f, n, c in rows:
        for j, g, m, e in rows:
            key = tuple(sorted((f"{f}:{n}", f"{g}:{m}")))
            if i >= j or f == g or key in seen or {n, m} & {"block_1", "nicht_erkannt"}:
                continue
            seen.add(key)
            name = SequenceMatcher(None, n.lower(), m.lower()).ratio()
            if name >= 0.7:
                want[i, j] = round(0.35 * name + 0.65 * SequenceMatcher(None, c.lower(), e.lower()).ratio(), 2)
    got = {(r.ord, r.other): r.score for r in turbulence.redundancies(spark.createDataFrame(rows, "ord int, file string, name string, code string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.011 for k in want)


def test_redundant_names_query(spark, sf):
    """The registered query against all pairs by difflib, from the reference's threshold of 0.7 up."""
    from difflib import SequenceMatcher

    from strataloom.plans import QUERIES

    first = {}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        first[r.p_brand, r.p_name] = min(r.p_partkey, first.get((r.p_brand, r.p_name), r.p_partkey))
    rows, want = sorted((k, *x) for x, k in first.items()), {}
    ratio = {(x, y): SequenceMatcher(None, x.lower(), y.lower()).ratio() for x in {r[2] for r in rows} for y in {r[2] for r in rows}}
    for i, f, n in rows:
        for j, g, m in rows:
            if i < j and f != g and ratio[n, m] >= 0.7:
                want[i, j] = ratio[n, m]
    assert any(x < 0.9 for x in want.values())
    got = {(r.ord, r.other): r.score for r in QUERIES["redundant_names"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.011 for k in want)


def test_louvain_over_all_suppliers(spark, sf, tmp_path):
    """Every supplier with an edge is in one community, named after its smallest member, that no single move improves."""
    from strataloom.plans import QUERIES

    # two cliques of suppliers of all nations, with one part in common
    lines = [(p, s) for p in range(6) for s in range(5)] + [(p, s) for p in range(10, 16) for s in range(5, 10)] + [(99, 0), (99, 9)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, s) for s in range(10)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.id: r.cluster for r in QUERIES["louvain_clusters"](spark, str(tmp_path)).collect()}
    assert got == {s: 0 if s < 5 else 5 for s in range(10)}
    links = {(r.source, r.target): float(r.weight) for r in QUERIES["shared_type_edges"](spark, sf).collect()}
    rows = QUERIES["louvain_clusters"](spark, sf).collect()
    of = {r.id: r.cluster for r in rows}
    assert len(rows) == len(of) and of.keys() == {x for pair in links for x in pair} and rows
    for c in set(of.values()):
        assert c == min(x for x in of if of[x] == c)
    total, degree = sum(links.values()), {n: sum(w for pair, w in links.items() if n in pair) for n in of}
    to = lambda n, c: sum(w for (a, b), w in links.items() if n in (a, b) and of[b if a == n else a] == c)
    gain = lambda n, c: to(n, c) - 1.2 * degree[n] * sum(degree[x] for x in of if of[x] == c and x != n) / (2 * total)
    for n in of:
        assert all(gain(n, c) <= gain(n, of[n]) + 1e-9 for c in set(of.values()))


def test_short_passages(spark, tmp_path):
    """Passages of one or two words, and an empty one, as the query's SQL finds them."""
    import duckdb

    from strataloom.plans import ORACLES, QUERIES

    docs = [(1, "the quick brown fox"), (2, "a quicker fox"), (3, ""), (4, None), (5, "brown  fox quick")]
    items = [(1, "quick"), (2, "quick brown"), (3, "the quick brown"), (4, ""), (5, None), (6, "brown  fox"), (7, "x y")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted((r.item_id, r.doc_id) for r in QUERIES["passage_documents"](spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(ORACLES["passage_documents"]).fetchall()) and (1, 2) in got and (4, 3) in got


def test_edges_of_papers_and_files(spark):
    papers = spark.createDataFrame([("p", "see 10.1234/abc and (Miller et al., 2020)", ["a", "b"]), ("q", "10.1234/ABC [Lee, 2019]", ["b"]), ("r", "[Lee, 2019]", [])], "source_id string, text string, category_labels array<string>")
    assert sorted((r.source, r.target, r.context) for r in graph.citation_edges(papers).collect()) == [("p", "q", "10.1234/abc"), ("q", "r", "lee, 2019")]
    assert [(r.source, r.target, r.context) for r in graph.keyword_edges(papers).collect()] == [("p", "q", "b")]
    named = spark.createDataFrame([("src/a.py", "calls src/b.py, src/a.py and src/b.py")], "filename string, text string")
    assert [(r.source, r.target) for r in graph.mention_edges(named).collect()] == [("src/a.py", "src/b.py")]
    fn = "array<struct<name:string,inputs:array<string>,outputs:array<string>,calls:array<string>>>"
    files = [("store.py", "uses UserService", ["x"], []), ("main.py", "UserService; dispatch( SendJob", ["app\\MemoryStore"], [("run", [], [], ["store::get"])]), ("jobs.py", "SendJob ShouldQueue", [], [])]
    got = graph.overview_edges(spark.createDataFrame(files, f"filename string, file_summary string, dependencies array<string>, functions {fn}"))
    assert sorted((r.source, r.target, r.type, r.weight, r.context) for r in got.collect()) == [
        ("main.py", "jobs.py", "event_dispatch", 0.7, "SendJob"), ("main.py", "store.py", "call", 0.9, "run"), ("main.py", "store.py", "import", 1.0, "app\\MemoryStore"), ("main.py", "store.py", "shared_type", 0.8, "UserService"),
    ]
    parts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3)], "id string, cluster int")
    near = spark.createDataFrame([("b", 9), ("c", 9), ("d", 8)], "id string, cluster int")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    assert {r.id: r.cluster for r in graph.merged_communities(parts, near, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_digest(spark):
    mark = "=" * 48
    text = f"{mark}\nFILE: a.py\n{mark}\nx = 1\r\ny\n\n{mark}\nFILE: b.bin\n{mark}\n[Binary file]\n{mark}\nFILE: c.md\n{mark}\n# c\n"
    rows = readers.split_digest(spark.createDataFrame([(text,)], "digest string")).orderBy("filename").collect()
    assert [(r.filename, r.content, r.line_estimate) for r in rows] == [("a.py", "x = 1\ny", 2), ("c.md", "# c", 1)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, text string, offset int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "id int, text string, offset int")
    got = sorted(tuple(r) for r in upserted(old, new, ("id",), update=("text",)).collect())
    assert got == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]


def test_chat_logs_and_stream(spark, tmp_path):
    folder = tmp_path / "p" / "ws"
    folder.mkdir(parents=True)
    line = lambda i, kind="user", content="hello": json.dumps({"type": kind, "sessionId": "s", "timestamp": f"2024-01-01T00:00:{i:02d}", "message": {"content": content}})
    lines = [line(i) for i in range(12)] + [line(13, "system"), "broken", line(14, "assistant", [{"type": "text", "text": "block"}, {"type": "tool", "text": "no"}])]
    (folder / "a.jsonl").write_text("\n".join(lines))
    turns = readers.chat_logs(spark, str(tmp_path / "p"))
    assert sorted(r.content for r in turns.collect()) == ["block"] + ["hello"] * 12
    run = jobs.write_batches(jobs.turn_batches(jobs.turn_stream(spark, str(tmp_path / "p")), 5), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()
    assert [(r.batch, r.n) for r in got][:2] == [(0, 5), (1, 5)] and len({r.batch_key for r in got}) == len(got)


def test_annotations_and_split(spark):
    old = spark.createDataFrame([("h1", "good", 1.0)], "prompt_hash string, label string, quality double")
    new = spark.createDataFrame([("h1", "bad", 1.0), ("h2", "skip", 1.0), ("h3", None, None), ("h4", "good", 0.2)], "prompt_hash string, label string, quality double")
    got = {r.prompt_hash: r.label for r in dedup.merge_annotations(old, [new]).collect()}
    assert got == {"h1": "good", "h3": "good"}
    rows = spark.range(500).withColumnRenamed("id", "k")
    n = dedup.split_train(rows, "k", 0.1, 42).where("validation").count()
    assert 25 <= n <= 80
    assert dedup.split_train(rows.limit(1), "k", 0.0, 1).where("validation").count() == 1


def test_best_signal_and_triggers(spark):
    log = spark.createDataFrame([(1, "a", "negative"), (2, "a", "positive"), (3, "a", "negative"), (4, "b", "neutral")], "id int, chunk_id string, signal string")
    assert {r.chunk_id: r.signal for r in feedback.best_signal(log).collect()} == {"a": "positive", "b": "neutral"}
    fires = spark.createDataFrame([("t", i, 0) for i in range(60)] + [("u", i, i % 2) for i in range(60)], "trigger string, event_id long, referenced int")
    assert {r.trigger: r.active for r in feedback.trigger_stats(fires).collect()} == {"t": False, "u": True}


def test_formats(spark):
    log = spark.createDataFrame([("rules\nDatei: a.py", "out")], "prompt string, raw_response string")
    got = training.formatted(log, "alpaca").first()
    assert (got.instruction, got.input, got.output) == ("rules", "Datei: a.py", "out")
    with pytest.raises(ValueError):
        training.formatted(log, "other")
    rows = [("h1", "rules\n## Datei: a.py", "a long answer", "good"), ("h2", "no mark", "a long answer", "good"), ("h3", "x", "short", "good"), ("h4", "x", "a long answer", "poor")]
    got = {r.prompt_hash: [m.content for m in r.messages] for r in training.prepared(spark.createDataFrame(rows, "prompt_hash string, prompt string, raw_response string, quality string")).collect()}
    assert got["h1"] == ["rules", "## Datei: a.py", "a long answer"] and got["h2"][1] == "no mark" and set(got) == {"h1", "h2"}


def test_labelled_log(spark):
    log = spark.createDataFrame([(f, True, 1) for f in "abcd"] + [("e", False, 0), ("f", True, 0)], "filename string, parsed_ok boolean, findings_count int").withColumn("run_id", F.lit("r"))
    said = spark.createDataFrame([("a", "confirmed"), ("a", "refined"), ("b", "rejected"), ("c", "rejected"), ("c", "confirmed")], "filename string, verdict string").withColumn("run_id", F.lit("r"))
    got = {r.filename: r.label for r in training.labelled_log(log, said).collect()}
    assert got == {"a": "positive", "b": "negative", "c": "candidate", "d": "candidate", "e": "negative", "f": "neutral"}


def test_nearest_on_odd_vectors(spark):
    """Ties, copies, zeros, nulls, other lengths and halves of the last digit as the column expression has them; no row is made for each pair."""
    import random

    from pyspark.sql import Window

    from strataloom.functions.vectors import cosine
    from strataloom.operators import retrieval

    rng = random.Random(3)
    vec = lambda n=3: [float(rng.randint(-2, 2)) for _ in range(n)]
    rows = [(i, vec(rng.choice([1, 2, 3, 3, 3]))) for i in range(150)] + [(i, [1.0, 2.0, 2.0]) for i in range(150, 200)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, []), (204, [float("nan"), 1.0, 1.0]), (205, [1e-170, 0.0, 0.0]), (206, [1e200, 1e200, 0.0])]
    rng.shuffle(rows)
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = vectors.where("id % 7 = 0 OR id >= 200").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    plain = lambda d: sorted(map(repr, d.select("query_id", "id", F.col("score") + 0.0, "rank").collect()))
    for k, least, block, kind in ((4, None, 8192, "long"), (300, None, 10, "long"), (5, 0.5, 10, "string"), (1, -0.2, 8192, "string")):
        q, v = queries.withColumn("query_id", F.col("query_id").cast(kind)), vectors.withColumn("id", F.col("id").cast(kind))
        pairs = q.crossJoin(v).select("query_id", "id", F.round(cosine(F.col("query"), F.col("embedding")), 6).alias("score"))
        pairs = pairs if least is None else pairs.where(F.col("score") >= least)
        got = retrieval.nearest(q, v, k, least, block)
        assert plain(got) == plain(pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert not retrieval.nearest(queries.where("query_id < 0"), vectors, 3).collect()


def test_graph_diff_deals_out_its_rows(spark, monkeypatch):
    """Nulls, repeated rows and both directions as EXCEPT has them, in as many tasks as the rows need."""
    from strataloom.operators import diff

    monkeypatch.setattr(diff, "ROWS", 50, raising=False)
    old = [(i, i % 7) for i in range(400)] * 2 + [(None, 1), (None, 2)]
    new = [(i, i % 7) for i in range(200, 600)] + [(None, 2), (3, None), (3, None)]
    frame = lambda x: spark.createDataFrame(x, "source long, target long")
    got = diff.graph_diff(frame(old), frame(new), ["source", "target"])
    assert got.columns == ["source", "target", "change"]
    want = [(*x, "removed") for x in set(old) - set(new)] + [(*x, "added") for x in set(new) - set(old)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert got.rdd.getNumPartitions() == -(-(len(old) + len(new)) // 50)


def test_common_edges_of_hot_tokens(spark, monkeypatch, tmp_path):
    """Weights as counted by hand, with repeated rows, nulls and a token that most nodes have; pairs are dealt out by their number."""
    import itertools
    import random
    import re
    from collections import Counter

    from strataloom.plans import QUERIES

    monkeypatch.setattr(graph, "ROWS", 50, raising=False)
    monkeypatch.setattr(graph, "PAIRS", 64, raising=False)
    rng = random.Random(5)
    rows = [(rng.randrange(80), rng.randrange(30)) for _ in range(300)] + [(n, 99) for n in range(70)] + [(None, 99), (3, None), (4, None), (200, 77)]
    spark.createDataFrame([(t, n) for n, t in rows + rows[:50]], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(n, n % 3) for n in range(90)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    of = {}
    for n, t in rows:
        if n is not None and t is not None:
            of.setdefault(t, set()).add(n)
    want = Counter(p for ns in of.values() for p in itertools.combinations(sorted(ns), 2))
    got = QUERIES["shared_type_edges"](spark, str(tmp_path))
    assert {(r.source, r.target): r.weight for r in got.collect()} == want
    tasks = -(-sum(len(ns) * (len(ns) - 1) // 2 for ns in of.values()) // 64)
    assert re.search(rf"hashpartitioning\(t#\d+L?, part#\d+L?, {tasks}\)", got._jdf.queryExecution().executedPlan().toString())
    degrees = {r.id: (r.out_degree, r.in_degree) for r in QUERIES["degree_table"](spark, str(tmp_path)).collect()}
    outs, ins = Counter(a for a, _ in want), Counter(b for _, b in want)
    assert degrees == {n: (outs[n], ins[n]) for n in range(90)}
    one = QUERIES["cluster_quality"](spark, str(tmp_path)).first()
    assert (one.edges, one.internal) == (len(want), sum(a % 3 == b % 3 for a, b in want))


def test_louvain_by_components(spark):
    """Components of a group go to tasks of their own, and communities are those of the whole group; small groups are singletons."""
    import random
    import re

    rng = random.Random(2)
    links = []
    for k in range(12):  # components of two loosely tied cliques, some with loops and repeated edges
        ns = [100 * k + i for i in range(12)]
        links += [(a, b, 1.0 + (a + b) % 3) for h in (ns[:6], ns[6:]) for a in h for b in h if a < b] + [(ns[0], ns[6], 0.5), (ns[0], ns[6], 0.5), (ns[1], ns[1], 1.0)]
    rng.shuffle(links)
    rows = [("x", *e) for e in links] + [("y", 1, 2, 1.0), ("y", 2, 3, 1.0)]
    got = graph.louvain(spark.createDataFrame(rows, "grp string, source long, target long, weight double"), "grp")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and not re.search(r"Join \[grp#\d+\]", plan)  # by the group alone all of it would be in one task
    found = {(r.grp, r.id): r.cluster for r in got.collect()}
    want = graph.communities(links)
    assert found == {("x", n): c for n, c in want.items()} | {("y", n): n for n in (1, 2, 3)}
    assert want == {100 * k + i: 100 * k + i // 6 * 6 for k in range(12) for i in range(12)}


def test_components_of_odd_edges(spark):
    """Loops, nulls, repeated edges and strings, over tasks that share nodes, as a search finds them."""
    import random

    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in range(400, 450)] + [(500, 500), (600, None), (None, 601), (None, None), (0, 1), (0, 1)]
    root = {x: x for e in links for x in e if x is not None}
    for _ in range(len(links)):
        for a, b in links:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    for kind, name in (("long", int), ("string", lambda x: f"n{x:04}")):
        edges = [tuple(None if x is None else name(x) for x in e) for e in links]
        frame = spark.createDataFrame(edges, f"source {kind}, target {kind}")
        for tasks in (1, 5):
            found = graph.components(frame.repartition(tasks))
            assert sorted(map(tuple, found.collect())) == sorted((name(a), name(b)) for a, b in root.items())
    plan = graph.components(frame.repartition(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # what a task connects needs no rounds
