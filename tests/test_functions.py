import pytest
from pyspark.sql import functions as F

from strataloom.functions import globs
from strataloom.functions import text as T
from strataloom.functions.vectors import cosine
from strataloom.sources import readers


def value(spark, column, *args):
    df = spark.createDataFrame([tuple(args)], [f"c{i}" for i in range(len(args))])
    return df.select(column(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    "name, pattern, fits",
    [
        ("a.log", "*.log", True),
        ("logs/a.LOG", "*.log", True),
        ("a.log.txt", "*.log", False),
        ("x/.git/config", "**/.git/**", True),
        ("node_modules/a/b.js", "node_modules/*", True),
        ("src/x.py", "re:^src/", True),
        ("lib/src.py", "re:^src/", False),
        ("a/b/c.py", "a/*.py", False),
        ("a/b/c.py", "a/**.py", True),
    ],
)
def test_globs(spark, name, pattern, fits):
    assert value(spark, lambda c: globs.matches(c, [pattern]), name) is fits


@pytest.mark.parametrize("label, ok", [("api", True), ("größe", True), ("a", False), ("aaaaaa", False), ("aaaa", True), ("Ab", False), ("x" * 31, False)])
def test_plausible_label(spark, label, ok):
    assert value(spark, T.plausible_label, label) is ok


def test_cleaned_labels(spark):
    labels = ["api", "[neu]aaaaaaa", "[neu]queue"]
    assert value(spark, T.cleaned_labels, labels) == ["api", "[neu]queue"]
    assert value(spark, lambda c: T.cleaned_labels(c, strict=True), labels) == ["api"]


@pytest.mark.parametrize(
    "raw, want",
    [("git@github.com:a/b.git", ("a", "b", None)), ("https://github.com/a/b/tree/dev", ("a", "b", "dev")), ("a/b", ("a", "b", None)), ("no slug", None)],
)
def test_github_input(spark, raw, want):
    got = value(spark, T.github_input, raw)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("raw, want", [('{"a":1}', '{"a":1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('so {"a": 2} it is', '{"a": 2}'), ("none", None), ("{broken", None)])
def test_parsed_json(spark, raw, want):
    assert value(spark, T.parsed_json, raw) == want


@pytest.mark.parametrize("s, want", [("5", 1.0), ("1", -1.0), ("positive", 1.0), ("neutral", 0.1), ("what", 0.0)])
def test_signal_score(spark, s, want):
    assert value(spark, T.signal_score, s) == want


def test_density_and_words(spark):
    assert value(spark, T.code_density, "") == 0
    assert value(spark, T.code_density, "```\nx = 1\n```") == 1
    assert value(spark, T.natural_words, "Die Größe zählt\n```\ndef f(): pass\n```\nok\nimport foo") == 3


def test_skip_reason(spark):
    talk = F.lit("conversation_summary")
    assert value(spark, lambda c: T.skip_reason(c, talk), "short") == "too_short"
    assert value(spark, lambda c: T.skip_reason(c, F.lit("repo_file")), "short") == ""
    assert value(spark, lambda c: T.skip_reason(c, talk), "@@ -1,2 +1,3 @@\n" + "word " * 30) == "diff_output"
    assert value(spark, lambda c: T.skip_reason(c, talk), "import os\n" * 20) == "code_density=1.00 words=0"
    assert value(spark, lambda c: T.skip_reason(c, talk), "plain words of talk " * 10) == ""


def test_igio(spark):
    assert tuple(value(spark, T.igio_axis, "12 passed")) == ("outcome", 0.92)
    assert tuple(value(spark, T.igio_axis, "Traceback (most recent call last)")) == ("issue", 0.95)
    assert tuple(value(spark, T.igio_axis, "x\n## Plan")) == ("intervention", 0.75)
    assert tuple(value(spark, T.igio_axis, "nothing here")) == ("", 0.0)


def test_slugs_and_progress(spark):
    assert value(spark, T.repo_slug, "https://github.com/Owner/My.Repo.git") == "owner-myrepo"
    assert value(spark, T.repo_slug, "https://github.com/") == "repo"
    got = value(spark, T.progress, "Files:  45%|####    | 9/20 [00:10<00:12, 1.1it/s]")
    assert (got.label, got.pct, got.current, got.total, got.eta) == ("Files", 45, 9, 20, "00:12")
    assert value(spark, T.patched_files, "--- a/x.py\n+++ b/x.py\n--- a/y.py") == ["x.py", "y.py"]
    assert value(spark, T.related_ids, 'a <!-- related: ["c1","c2"] --> b') == ["c1", "c2"]


def test_cosine_edges(spark):
    assert value(spark, cosine, [0.0, 0.0], [1.0, 2.0]) == 0
    assert value(spark, cosine, [1.0, 0.0], [2.0, 0.0]) == 1
    assert value(spark, cosine, [1.0, 0.0, 9.0], [1.0, 0.0]) == pytest.approx(1 / 82**0.5)


def test_small_yaml():
    text = "categories:\n  - name: source\n    patterns:\n      - '*.py'\n      - '*.js'\n    risk_level: high\n  - name: config\n    patterns: ['*.yaml', '*.ini']\n"
    got = readers._yaml(text)["categories"]
    assert [r["name"] for r in got] == ["source", "config"]
    assert got[0]["patterns"] == ["*.py", "*.js"] and got[1]["patterns"] == ["*.yaml", "*.ini"]


def test_tree_paths():
    tree = "root/\n├── src/\n│   ├── a.py\n│   └── b.py\n└── README.md"
    assert readers.tree_paths(tree) == ["src/a.py", "src/b.py", "README.md"]


def test_axis_verdict(spark):
    got = lambda raw: (lambda r: r and (r.axis, round(r.confidence, 3), r.rationale))(value(spark, T.axis_verdict, raw))
    assert got('so: {"axis": "Goal", "confidence": 1.7, "rationale": "r"}') == ("goal", 1.0, "r")
    assert got('```json\n{"axis": "tests", "confidence": 0.5}\n```') == ("outcome", 0.4, "")
    assert got('{"axis": "weather", "confidence": 1}') is None and got("none") is None and got("{broken}") is None


def test_findings(spark):
    good = '{"datei": "a", "zeile": "3", "typ": "t", "begründung": "b", "empfehlung": "e"}'
    got = value(spark, T.extracted_findings, f'x ```json\n{{"findings": [{good}, {{"datei": "a"}}]}}\n```')
    assert [(r.type, r.line_hint, r.evidence_excerpt) for r in got] == [("t", "3", "b")]
    ask = lambda *a: value(spark, T.finding_query, *a)
    assert ask("redundanz", "see def load(x)", "a/b.py", "api") == "Funktion load ähnliche Implementierung"
    assert ask("zombie_code", "none", "a/b.py", "api") == "Aufruf b Referenz"
    assert ask("other", "", "", "") == "[uncategorized] unknown"


def test_path_labels(spark):
    assert value(spark, T.path_labels, "src/api/x.py") == ["api"] and value(spark, T.path_labels, "x/test_y.py") == ["tests"] and value(spark, T.path_labels, "zz") == []
    assert value(spark, T.file_label, "a/x.go") == "Go" and value(spark, T.file_label, "a/x_test.go") == "Test"
