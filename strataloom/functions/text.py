"""Scalar text functions as column expressions: tokens, hashes, slugs, densities, parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def chunk_id(source_id: Column, level: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("chk_"), F.substring(F.sha2(F.concat_ws(":", source_id, level, ordinal.cast("string")), 256), 1, 16))


def source_id(repo: Column, path: Column) -> Column:
    return F.concat_ws(":", F.lit("repo"), repo, path)


def source_fingerprint(source: Column) -> Column:
    """What follows the second colon as a slug; beyond 48 characters 40 of them and a hash of seven."""
    part = F.when(F.size(F.split(source, ":", 3)) == 3, F.element_at(F.split(source, ":", 3), -1)).otherwise(source)
    slug = F.translate(part, "/\\:", "---")
    short = F.concat(F.substring(slug, 1, 40), F.lit("-"), F.substring(F.sha2(slug, 256), 1, 7))
    return F.when(F.length(slug) > 48, short).otherwise(slug)


def memory_key(scope: Column, category: Column, source: Column, hash_: Column) -> Column:
    return F.concat_ws(":", scope, category, source_fingerprint(source), F.substring(F.element_at(F.split(hash_, ":"), -1), 1, 8))


def repo_slug(url: Column) -> Column:
    """The path of a URL with dashes, without .git; a-z, 0-9 and dashes only; "repo" if nothing is left."""
    path = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://[^/]*", ""), r"^git@[^:]*:", "")
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"[.]git$", ""), "/", "-"), "[^a-z0-9-]", "")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", F.lit("repo")).otherwise(slug)


def last_part(text: Column, mark: str = "/") -> Column:
    return F.element_at(F.split(F.regexp_replace(text, f"{mark}+$", ""), mark), -1)


def session_date(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)


def safe_id(value: Column, default: str = "default") -> Column:
    clean = F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9_-]", "_")
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def truncated(text: Column, most: int) -> Column:
    """Cut to most characters with a note of the full length."""
    note = F.concat(F.substring(text, 1, most), F.lit("\n[... truncated, "), F.length(text).cast("string"), F.lit(" characters in all]"))
    return F.when(F.length(text) > most, note).otherwise(text)


def mermaid_id(node: Column) -> Column:
    return F.regexp_replace(node, "[^A-Za-z0-9]", "_")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


# Lines that are code or a tool's output, fenced blocks, and the marks of a diff.
CODE_LINES = (
    r"^\s*<\?php\b",
    r"^\s*(import|from)\s+\w",
    r"^\s*(class|def|function|public|private|protected|interface|trait)\s+\w",
    r"^\s*(use|namespace)\s+[\w\\]+",
    r"^\s*[+\-]{3}\s+[ab]/",
    r"^\s*@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@",
    r"^\s*[\d]+→",
    r"^\s*[\}\]\)]\s*[,;]?\s*$",
    r"^\s*//",
    r"^\s*#\s*include\b",
)
FENCE = r"(?s)```[^\n]*\n.*?\n```"
DIFF = (r"(?m)^@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@", r"(?m)^---\s+[ab]/.*\n\+\+\+\s+[ab]/")
#: After each line's end, as str.splitlines sees it.
LINE_ENDS = r"(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85  ])|(?<=\r)(?!\n)"


def is_code_line(line: Column) -> Column:
    return line.rlike("(?U)" + "|".join(CODE_LINES))


def code_density(text: Column) -> Column:
    """Share of characters in fences and in lines that look like code, at most 1; 0 for empty text."""
    body = F.coalesce(text, F.lit(""))
    fenced = F.aggregate(F.regexp_extract_all(body, F.lit(FENCE), 0), F.lit(0), lambda acc, x: acc + F.length(x))
    lines = F.filter(F.split(F.regexp_replace(body, FENCE, ""), LINE_ENDS), lambda x: is_code_line(x))
    coded = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(x))
    return F.when(F.length(body) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (fenced + coded) / F.length(body)))


def natural_words(text: Column) -> Column:
    """Words of three letters or more outside fences and code lines."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, "")
    lines = F.filter(F.split(rest, LINE_ENDS), lambda x: ~is_code_line(x))
    return F.regexp_count(F.array_join(lines, ""), F.lit(r"(?U)\b[a-zA-ZäöüÄÖÜß]{3,}\b")).cast("int")


def skip_reason(text: Column, source_type: Column) -> Column:
    """Why a conversation summary is not worth a chunk; empty where it is, and for all other source types."""
    body = F.coalesce(text, F.lit(""))
    density, words = code_density(body), natural_words(body)
    diff = body.rlike(DIFF[0]) | body.rlike(DIFF[1])
    why = (
        F.when(F.length(body) < 80, "too_short")
        .when(diff, "diff_output")
        .when((density > 0.6) & (words < 40), F.format_string("code_density=%.2f words=%d", density, words))
        .when(density > 0.85, F.format_string("code_density=%.2f", density))
        .otherwise("")
    )
    return F.when(source_type == "conversation_summary", why).otherwise("")


def topic_words(text: Column) -> Column:
    """Lower-cased words of three or more of a-z, 0-9, _ and -, from a letter on, in order."""
    runs = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_-]+)"), 1), lambda x: F.trim(x, F.lit("-")))
    return F.filter(runs, lambda x: x.rlike("^[a-z][a-z0-9_-]{2,}$"))


def plausible_label(label: Column) -> Column:
    """2 to 30 of a-z, 0-9, umlauts, _ and -; from five on no character makes up more than 60 %."""
    chars = F.split(label, "")
    most = F.array_max(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c))))
    return label.rlike("^[a-z0-9äöüß_-]{2,30}$") & ((F.length(label) < 5) | (most <= 0.6 * F.length(label)))


def cleaned_labels(labels: Column, strict: bool = False) -> Column:
    """Labels without implausible, or with strict without all, model-made ones, which are marked [neu]."""
    made = lambda x: x.startswith("[neu]")
    if strict:
        return F.filter(labels, lambda x: ~made(x))
    return F.filter(labels, lambda x: ~made(x) | plausible_label(F.substring(x, 6, 10_000)))


def parsed_json(raw: Column) -> Column:
    """The JSON object in a model's reply as text: as it is, or in a fence, or from the first to the last brace; else null."""
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & (c != ""), c)
    return F.coalesce(valid(F.regexp_extract(raw, r"(?s)^\s*(\{.*\})\s*$", 1)), valid(fence), valid(braces))


# Where a prompt's file content starts, and the system text where it has none.
FILE_MARKS = ("## Datei:", "---\n\n## ", "```")
DEFAULT_SYSTEM = "Du bist ein erfahrener Code-Reviewer mit Fokus auf nachhaltige Software-Qualität."


def split_prompt(prompt: Column) -> Column:
    """(system, user): the prompt cut at the earliest mark past its start; a default system text where there is none."""
    at = F.least(*[F.when(F.instr(prompt, m) > 1, F.instr(prompt, m)) for m in FILE_MARKS])
    user = stripped(F.substring(prompt, at, F.length(prompt)))
    none = at.isNull() | (user == "")
    return F.struct(
        F.when(none, F.lit(DEFAULT_SYSTEM)).otherwise(stripped(F.substring(prompt, F.lit(1), at - 1))).alias("system"),
        F.when(none, stripped(prompt)).otherwise(user).alias("user"),
    )


def label_line(response: Column) -> Column:
    """What follows "Kategorien:" or the like, else the whole response."""
    named = F.regexp_extract(response, r"(?im)^\s*(?:kategorien|categories|labels|kategorie|category)\s*[:\-]\s*(.+)$", 1)
    return F.when(named != "", stripped(named)).otherwise(response)


def progress(line: Column) -> Column:
    """label, pct, current, total and eta of a progress bar's line; null where it is none."""
    pattern = r"^\s*(.*?):?\s*([0-9]+)%\|[^|]*\|\s*([0-9]+)/([0-9]+)\s*\[[^<]*<([^,\]]+)"
    part = lambda i: F.regexp_extract(line, pattern, i)
    fields = F.struct(part(1).alias("label"), part(2).try_cast("int").alias("pct"), part(3).try_cast("long").alias("current"), part(4).try_cast("long").alias("total"), part(5).alias("eta"))
    return F.when(line.rlike(pattern), fields)


def patched_files(patch: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(.*)$"), 1)))


def related_ids(text: Column) -> Column:
    """The JSON array in a comment <!-- related: [...] -->; empty where there is none."""
    return F.coalesce(F.from_json(F.regexp_extract(text, r"<!--\s*related[^:]*:\s*(\[[^\]]*\])\s*-->", 1), "array<string>"), F.array().cast("array<string>"))


def github_input(raw: Column) -> Column:
    """owner, repo and branch of a slug, an https or an ssh address; null where it is none of them."""
    pattern = r"^(?:https?://github[.]com/|git@github[.]com:|ssh://git@github[.]com/)?([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:[.]git)?(?:/tree/([^?#]+))?/?$"
    part = lambda i: F.regexp_extract(F.trim(raw), pattern, i)
    return F.when(F.trim(raw).rlike(pattern), F.struct(part(1).alias("owner"), part(2).alias("repo"), F.nullif(part(3), F.lit("")).alias("branch")))


def signal_score(signal: Column) -> Column:
    """Stars become -1 to 1, positive 1, negative -1, neutral 0.1, the rest 0."""
    stars = signal.try_cast("int")
    return (
        F.when(stars.between(1, 5), (stars - 3) / 2.0).when(signal == "positive", 1.0).when(signal == "negative", -1.0).when(signal == "neutral", 0.1).otherwise(0.0)
    )


def is_positive(signal: Column) -> Column:
    return F.coalesce((signal == "positive") | (signal.try_cast("int") >= 4), F.lit(False))


def traffic_light(cost: Column, flat: float) -> Column:
    ratio = cost / flat
    return F.when(ratio < 0.5, "green").when(ratio < 0.85, "yellow").otherwise("red")


# Test paths in categorisation and in the judging of findings, and labels of paths where no model answers.
TEST_PATH = r"(?i)(?:^|/)(?:tests?|spec|__tests__)/|test_[^/]+\.py|[^/]+_test\.(py|js|ts)|[^/]+\.(?:test|spec)\.[a-z0-9]+|conftest"
TEST_FILE = r"(?i)(?:^|/)test[s]?[_\-].*\.(?:py|php|js|ts|go|java)$|(?:^|/)(?:tests?|spec|__tests?__|test)|_test\.(?:py|php|js|ts|go|java)$"
PATH_RULES = (
    ("tests", r"test_|_test\.|/tests/|conftest"),
    ("api", r"/api/|/routes/|/controllers/|router"),
    ("data_access", r"/models?/|/db/|/migration|repositor"),
    ("auth", r"/auth|/security|/guards?/|/policies?"),
    ("domain", r"/service|/domain|/usecase|/business"),
    ("middleware", r"/middleware|/pipeline"),
    ("config", r"config.*\.(py|yaml|yml|env)|settings\.|constants\."),
    ("utils", r"/utils?/|/helpers?/|/tools?/"),
    ("caching", r"/cache|redis|memcache"),
    ("logging", r"/log|monitor|metric|trace"),
)
FILE_LABELS = ((r"(?i)\.(?:php|blade\.php)$", "PHP/Laravel"), (r"(?i)\.py$", "Python/Django"), (r"(?i)\.(?:js|ts)$", "JavaScript/TypeScript"), (r"(?i)\.go$", "Go"))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def file_label(path: Column) -> Column:
    out = F.lit("Source")
    for pattern, name in reversed(FILE_LABELS):
        out = F.when(path.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(is_test_file(path), F.lit("Test")).otherwise(out)


def path_labels(path: Column) -> Column:
    """The label of the first rule that fits a path, as an array; empty where none does."""
    out = F.array().cast("array<string>")
    for name, pattern in reversed(PATH_RULES):
        out = F.when(path.rlike("(?i)" + pattern), F.array(F.lit(name))).otherwise(out)
    return out


# Axis, confidence, whether ^ stands at every line's start, and pattern, in the order in which they are tried.
IGIO_RULES = (
    ("outcome", 0.92, "", r"\b(\d+\s+passed|\d+\s+failed|tests? grün|tests? red)\b"),
    ("issue", 0.95, "", r"\bTraceback \(most recent call last\)"),
    ("issue", 0.78, "", r"\b(?:bug|broken|regression|TODO|FIXME)\b|\bfix(?:e[ds])?:"),
    ("intervention", 0.75, "m", r"^##?\s*Plan\b|\bImplemented\b|\brefactor(?:ed|ing)\b"),
)
# Words that models use for an axis.
AXIS_ALIASES = {
    "test": "outcome", "tests": "outcome", "testing": "outcome", "result": "outcome", "results": "outcome", "fix": "intervention", "fixes": "intervention",
    "refactor": "intervention", "implementation": "intervention", "bug": "issue", "problem": "issue", "question": "issue",
}
AXES = ("issue", "goal", "intervention", "outcome")


def igio_axis(text: Column) -> Column:
    """(axis, confidence) by the first rule that matches; an empty axis where none does."""
    axis, sure = F.lit(""), F.lit(0.0)
    for name, confidence, lines, pattern in reversed(IGIO_RULES):
        hit = text.rlike(f"(?iu{lines})" + pattern)
        axis, sure = F.when(hit, F.lit(name)).otherwise(axis), F.when(hit, F.lit(confidence)).otherwise(sure)
    return F.struct(axis.alias("axis"), sure.alias("confidence"))


def axis_verdict(raw: Column) -> Column:
    """(axis, confidence, rationale) of a model's reply: its outermost JSON object; other words for an axis cost 0.1, unknown
    ones make it null, a confidence is cut to 0..1 and a rationale to 200 characters."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    part = lambda k: F.get_json_object(body, f"$.{k}")
    said = F.lower(F.trim(F.coalesce(part("axis"), F.lit(""))))
    alias = F.create_map(*[F.lit(x) for kv in AXIS_ALIASES.items() for x in kv])[said]
    known = said.isin("", *AXES)
    sure = F.coalesce(part("confidence").try_cast("double"), F.lit(0.0)) - F.when(known, 0.0).otherwise(0.1)
    out = F.struct(F.when(known, said).otherwise(alias).alias("axis"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), F.substring(F.coalesce(part("rationale"), F.lit("")), 1, 200).alias("rationale"))
    return F.when(F.try_parse_json(body).isNotNull() & (body != "") & (known | alias.isNotNull()), out)


MENTIONED_FILE = r"\b((?:src|tests?|lib|app|config)/[A-Za-z0-9_/.-]+\.(?:py|js|ts|java|go|rs|rb|php|cpp|c|h|yaml|yml|json))\b"
# What to search for by the type of a finding; {f} is the function, {c} the category, {n} the file.
FINDING_QUERIES = {
    "redundanz": "Funktion {f} ähnliche Implementierung", "sicherheit": "Auth Validation User-Input {c}", "zombie_code": "Aufruf {f} Referenz", "inkonsistenz": "[{c}] Fehlerbehandlung Muster",
    "fehlerbehandlung": "Exception Try-Catch {c} Pattern", "overengineering": "[{c}] Abstraktion Vereinfachung", "unklar": "[{c}] {n} Kontext Abhängigkeit",
}


def finding_query(kind: Column, evidence: Column, filename: Column, category: Column) -> Column:
    """A search for what is like a finding: by its type, with the function that its evidence names, else the file's stem."""
    named = F.regexp_extract(F.coalesce(evidence, F.lit("")), r"(?iU)(?:def|function|public\s+function|private\s+function|protected\s+function|func)\s+(\w+)", 1)
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(filename, F.lit("")), "/"), -1), r"[.][^.]*$", "")
    form = F.create_map(*[F.lit(x) for kv in FINDING_QUERIES.items() for x in kv])[F.lower(F.trim(F.coalesce(kind, F.lit(""))))]
    out = F.coalesce(form, F.lit("[{c}] {n}"))
    full = lambda c, v: F.coalesce(F.nullif(c, F.lit("")), F.lit(v))
    for mark, value in (("{f}", F.when(named != "", named).otherwise(stem)), ("{c}", full(category, "uncategorized")), ("{n}", full(filename, "unknown"))):
        out = F.replace(out, F.lit(mark), value)
    return F.trim(out)


def extracted_findings(raw: Column) -> Column:
    """Findings of a model's JSON reply that have a file, a type, a reason and an advice, as an array."""
    item = "struct<datei: string, zeile: string, typ: string, `begründung`: string, empfehlung: string>"
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")), raw)
    listed = F.coalesce(F.from_json(body, f"struct<findings: array<{item}>>")["findings"], F.from_json(body, f"array<{item}>"))
    good = F.filter(listed, lambda f: (F.trim(f["datei"]) != "") & (F.trim(f["typ"]) != "") & (F.trim(f["begründung"]) != "") & (F.trim(f["empfehlung"]) != ""))
    return F.transform(good, lambda f: F.struct(f["typ"].alias("type"), F.coalesce(f["zeile"], F.lit("")).alias("line_hint"), F.substring(f["begründung"], 1, 200).alias("evidence_excerpt"), f["empfehlung"].alias("fix_suggestion"), F.lit("low").alias("confidence"), F.lit("info").alias("severity"), F.lit("freetext_extraction").alias("source")))
