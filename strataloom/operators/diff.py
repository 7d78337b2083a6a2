"""Differences of versions: snapshots of files, findings of runs, graph snapshots, as-of lookups, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

#: Rows that one task holds at once.
ROWS = 1 << 20


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(filename, status) of (filename, hash, ...): added, removed, changed or unchanged, in one full join."""
    o, n = old.select("filename", F.col("hash").alias("old_hash")), new.select("filename", F.col("hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    return o.join(n, "filename", "full").select("filename", status.alias("status"))


def select_top(files: DataFrame, risky: Column, limit: int) -> DataFrame:
    """files with selected: the first limit by risk, size and name; all if limit is not positive."""
    if limit <= 0:
        return files.withColumn("selected", F.lit(True))
    chosen = files.orderBy(F.when(risky, 0).otherwise(1), F.desc("size"), "filename").limit(limit).select("filename")
    return files.join(chosen.withColumn("selected", F.lit(True)), "filename", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def carry_forward(new: DataFrame, history: DataFrame) -> DataFrame:
    """new versions with the analysis time of the latest row of the same name, hash and run key that has one."""
    keys = ["filename", "hash", "run_key"]
    last = history.where("analyzed_at IS NOT NULL").groupBy(*keys).agg(F.max_by("analyzed_at", "snapshot_id").alias("analyzed_at"))
    return new.drop("analyzed_at").join(last, keys, "left")


def mark_analyzed(versions: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """versions(snapshot_id, filename, run_key, analyzed_at, ...) with the time now on the rows that done(snapshot_id, filename)
    names with its run_key; a null run key is 'default'."""
    keys = ["snapshot_id", "filename", "_run"]
    hit = done.select("snapshot_id", "filename", F.coalesce("run_key", F.lit("default")).alias("_run")).distinct().withColumn("_hit", F.lit(True))
    rows = versions.withColumn("_run", F.coalesce("run_key", F.lit("default"))).join(hit, keys, "left")
    return rows.withColumn("analyzed_at", F.when(F.col("_hit"), now).otherwise(F.col("analyzed_at"))).select(*versions.columns)


def findings(runs: DataFrame, both_shapes: bool = False) -> DataFrame:
    """One row a finding: run_id, filename, category and its fields; files with an error have none."""
    items = F.coalesce("r.potential_smells", F.array().cast(runs.schema["results"].dataType.elementType["potential_smells"].dataType))
    if both_shapes:
        items = F.concat(items, F.coalesce("r.codierungen", F.array().cast(runs.schema["results"].dataType.elementType["codierungen"].dataType)))
    rows = runs.select("run_id", F.explode("results").alias("r")).where("r.error IS NULL")
    return rows.select("run_id", F.col("r.filename").alias("filename"), F.col("r.category").alias("category"), F.posexplode(items).alias("pos", "f")).select("run_id", "filename", "category", "pos", "f.*")


def run_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, status) of findings(filename, type, severity, evidence_excerpt, pos): new, resolved or severity_changed.

    Of findings with one key the last counts."""
    key = F.concat_ws("::", "filename", "type", F.substring(F.coalesce("evidence_excerpt", F.lit("")), 1, 80))
    last = lambda d, name: d.groupBy(key.alias("key")).agg(F.max_by("severity", "pos").alias(name))
    both = last(a, "before").join(last(b, "after"), "key", "full")
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").when(F.col("before") != F.col("after"), "severity_changed")
    return both.withColumn("status", status).where("status IS NOT NULL")


def as_of(snapshots: DataFrame, dates: DataFrame, key: str, ts: str) -> DataFrame:
    """For each (key, at) of dates the last snapshot row at or before it: events of both sides share one sorted window, so a
    key with very many snapshots is read once, and no pairs are made."""
    value = F.struct(*[c for c in snapshots.columns if c != key])
    left = snapshots.select(key, F.col(ts).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"))
    right = dates.select(key, F.col("at").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_v"].dataType).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = left.union(right).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return rows.where("_side = 1").select(key, F.col("_t").alias("at"), "_last.*")


def graph_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of columns with change: added or removed. Both sides meet once, in tasks of a bounded number of rows."""
    both = old.select(*columns, F.lit("removed").alias("side")).union(new.select(*columns, F.lit("added").alias("side")))
    sides = dealt(both, both.count(), ROWS, *columns).groupBy(*columns).agg(F.min(F.col("side") == "added").alias("_a"), F.max(F.col("side") == "added").alias("_z"))
    return sides.where("_a = _z").select(*columns, F.when(F.col("_z"), "added").otherwise("removed").alias("change"))


def beyond_newest(rows: DataFrame, group: str, order: list, keep: int) -> DataFrame:
    """Rows past the newest keep of each group: what retention deletes."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep).drop("_n")


def merged_conflict(current: Column, incoming: Column) -> Column:
    """The incoming value where it is not empty."""
    return F.coalesce(F.nullif(incoming, F.lit("")), current)


def edge_conflicts(edges: DataFrame) -> DataFrame:
    """Pairs with several validated edges: how many and the type of the first."""
    rows = edges.where("validated").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min_by("type", "id").alias("type"))
    return rows.where("n > 1")


def resolved_conflicts(edges: DataFrame) -> DataFrame:
    """Of the validated edges of a pair the newest stays; all others stay as they are."""
    keep = edges.where("validated").groupBy("source", "target").agg(F.max(F.struct("discovered_at", "id")).alias("m")).select("source", "target", F.col("m.id").alias("_keep"))
    return edges.join(keep, ["source", "target"], "left").where("NOT validated OR id = _keep").select(*edges.columns)
