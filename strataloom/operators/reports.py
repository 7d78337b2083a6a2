"""Reports as Markdown from small results: sorted, bounded by the caller, rendered on the driver."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("critical", "warning", "info")


def findings_report(findings: DataFrame, diff: DataFrame, repo: str, run_id: str, most: int = 200) -> str:
    """Counts of a diff and the first findings by severity; says how many were left out."""
    from .metrics import findings_summary, top_findings

    total = findings_summary(findings).first()
    changes = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    lines = [f"# Analysis of {repo}", "", f"Run {run_id}", "", "## Changes", ""]
    lines += [f"- {s}: {changes.get(s, 0)}" for s in ("added", "changed", "removed", "unchanged")]
    lines += ["", "## Findings", "", f"{total['total']} in all: " + ", ".join(f"{total[s]} {s}" for s in SEVERITIES), ""]
    rows = top_findings(findings, most).collect()
    lines += [f"- **{r['severity']}** `{r['filename']}` {r['type']} ({r['confidence'] or 'medium'})" for r in rows]
    if total["total"] > len(rows):
        lines.append(f"- ... {total['total'] - len(rows)} more")
    return "\n".join(lines)


def turbulence_report(scores: DataFrame, zones: DataFrame, pairs: DataFrame | None = None, most: int = 50) -> str:
    tiers = {r.tier: r["count"] for r in scores.groupBy("tier").count().collect()}
    lines = ["# Turbulence", ""] + [f"- {t}: {tiers.get(t, 0)} files" for t in ("deep", "light", "skip", "stable")] + ["", "## Hot zones", ""]
    rows = zones.orderBy(F.desc("zone_max"), "file", "start").limit(most).collect()
    lines += [f"- {r.file}: {r.start} to {r.end}, peak {r.peak_score}" for r in rows] or ["none"]
    if pairs is not None:
        lines += ["", "## Redundancies", ""] + [f"- {r.ord} and {r.other}: {r.score}" for r in pairs.orderBy(F.desc("score"), "ord", "other").limit(20).collect()]
    return "\n".join(lines)


def project_pages(chunks: DataFrame, sources: DataFrame, needle: str | None = None) -> DataFrame:
    """(repo, page): a Markdown page for each project with its counts by label and kind, made on the executors."""
    rows = chunks.join(sources.select("source_id", "repo", "source_type"), "source_id")
    if needle:
        rows = rows.where(F.contains("repo", F.lit(needle)))
    labels = rows.select("repo", F.explode("category_labels").alias("label")).groupBy("repo", "label").count()
    kinds = rows.groupBy("repo", "source_type").count()
    listed = lambda d, c: d.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col(c).alias("k")))), lambda x: F.concat(F.lit("- "), x["k"], F.lit(": "), (-x["n"]).cast("string"))), "\n").alias(c))
    rate = rows.groupBy("repo").agg(F.round(F.avg(F.when(F.size("category_labels") > 0, 1.0).otherwise(0.0)), 3).alias("rate"))
    page = F.concat(F.lit("# "), "repo", F.lit("\n\nCategorised: "), F.col("rate").cast("string"), F.lit("\n\n## Labels\n\n"), F.coalesce("label", F.lit("none")), F.lit("\n\n## Sources\n\n"), "source_type")
    return rate.join(listed(labels, "label"), "repo", "left").join(listed(kinds, "source_type"), "repo", "left").select("repo", page.alias("page"))


def recap(chunks: DataFrame, issue: str, most: int = 25) -> DataFrame:
    """Up to most chunks of each axis that mention an issue, the surest and newest first."""
    from pyspark.sql import Window

    says = [F.col("source_id").ilike(f"%issue:%:{issue}"), F.col("source_id").ilike(f"%issue/{issue}")]
    says += [F.col("text").rlike(f"#{issue}([^0-9]|$)"), F.col("text").rlike(f"(?i)issue {issue}([^0-9]|$)")]
    hit = says[0]
    for s in says[1:]:
        hit = hit | s
    rows = chunks.where(F.col("igio_axis").isin("issue", "goal", "intervention", "outcome") & hit)
    w = Window.partitionBy("igio_axis").orderBy(F.desc("igio_confidence"), F.desc("created_at"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def recap_markdown(issue: str, rows: list, plans: list[tuple[str, str]] = (), commits: list[tuple[str, str]] = ()) -> str:
    """A recap of collected rows(igio_axis, text) by axis, with plans (path, title) and commits (hash, subject)."""
    by = defaultdict(list)
    for r in rows:
        by[r["igio_axis"]].append(" ".join(r["text"].split())[:200])
    lines = [f"# Recap of issue {issue}"]
    for axis in ("issue", "goal", "intervention", "outcome"):
        lines += ["", f"## {axis.capitalize()}", ""] + ([f"- {t}" for t in by[axis]] or ["nothing found"])
    for name, items in (("Plans", plans), ("Commits", commits)):
        if items:
            lines += ["", f"## {name}", ""] + [f"- `{a}` {b}" for a, b in items]
    return "\n".join(lines)


def node_context(nodes: DataFrame, edges: DataFrame, filename: str, most_chars: int = 2000) -> str:
    """What is known around a file: mates of its cluster, its strongest edges, its turbulent neighbours."""
    from .graph import neighbourhood

    me = nodes.where(F.col("id") == filename).limit(1).collect()
    if not me:
        return ""
    mates = nodes.where((F.col("cluster_id") == me[0]["cluster_id"]) & (F.col("id") != filename)).orderBy("id").limit(8).collect() if me[0]["cluster_id"] else []
    near = neighbourhood(edges, filename, 5).orderBy("direction", "rank").collect()
    hot = nodes.join(neighbourhood(edges, filename, 50).select(F.col("other").alias("id")).distinct(), "id", "left_semi").where(F.col("turbulence_tier").isin("deep", "hot")).orderBy("id").limit(10).collect()
    lines = [f"Cluster: {', '.join(r['id'] for r in mates)}"] if mates else []
    lines += [f"{'Uses' if r['direction'] == 'out' else 'Used by'}: {r['other']}" for r in near]
    lines += [f"Hot neighbours: {', '.join(r['id'] for r in hot)}"] if hot else []
    return "\n".join(lines)[:most_chars]


def conflict_merge(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges (source, target, type, weight, validated) of two sides: validated ones win, two validated ones are for review."""
    keys = ["source", "target", "type"]
    both = current.alias("a").join(incoming.alias("b"), keys, "full")
    va, vb = F.coalesce("a.validated", F.lit(False)), F.coalesce("b.validated", F.lit(False))
    take_b = F.col("b.weight").isNotNull() & (vb | ~va)
    return both.select(*keys, F.when(take_b, F.col("b.weight")).otherwise(F.col("a.weight")).alias("weight"), (va | vb).alias("validated"), (va & vb).alias("review"))
