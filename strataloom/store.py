"""The store as one object: what a caller does with sources, chunks, feedback and the graph, on versioned tables of one folder.

Every method is a plan over tables; what reaches the driver are counts, keys of one row, or the query's own text.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema as S
from .functions import models
from .functions import text as T
from .functions.vectors import clamped, cosine
from .operators import dedup, diff, graph, retrieval
from .sources.readers import changes_since
from .sources.tables import VersionedTable

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "sources": (S.SOURCES, ("source_id",)),
    "chunks": (S.CHUNKS, ("chunk_id",)),
    "vectors": ("chunk_id STRING, embedding ARRAY<FLOAT>", ("chunk_id",)),
    "feedback": (S.FEEDBACK, ()),
    "source_refs": (S.SOURCE_REFS, ("canonical_chunk_id", "source_id")),
    "log": ("source_id STRING, event_type STRING, payload STRING, created_at TIMESTAMP", ()),
    "contexts": ("id STRING, query STRING, chunk_ids ARRAY<STRING>, was_referenced BOOLEAN, workspace_id STRING, created_at TIMESTAMP", ("id",)),
    "llm_calls": ("call_type STRING, model STRING, prompt STRING, response STRING, tool_calls INT, duration_ms LONG, workspace_id STRING, created_at TIMESTAMP", ()),
    "triggers": ("trigger STRING, fires LONG, refs LONG, active BOOLEAN", ("trigger",)),
    "transitions": ("from_topic STRING, to_topic STRING, count LONG, last_seen TIMESTAMP", ("from_topic", "to_topic")),
    "paper_cache": ("source_id STRING, rule_name STRING, extracted ARRAY<STRING>", ("source_id", "rule_name")),
    "nodes": (S.NODES, ("id", "workspace_id")),
    "edges": (S.EDGES + ", id STRING, discovered_at TIMESTAMP", ("source", "target", "type", "workspace_id")),
    "clusters": ("cluster_id STRING, workspace_id STRING, name STRING, description STRING, rationale STRING, strategy_used STRING", ("cluster_id", "workspace_id")),
    "snapshots": ("id STRING, workspace_id STRING, created_at TIMESTAMP, trigger STRING, nodes LONG, edges LONG, clusters LONG", ("id",)),
    "snapshot_items": ("snapshot_id STRING, kind STRING, a STRING, b STRING, c STRING", ("snapshot_id", "kind", "a", "b", "c")),
    "contributions": ("workspace_id STRING, user_id STRING, action STRING, target_node STRING, ts TIMESTAMP", ()),
}
#: What a known chunk takes over when it is put again; offsets, quality and keys stay.
CHUNK_UPDATE = ("text", "text_hash", "summary", "category_labels", "category_version", "category_source", "category_confidence", "is_active", "superseded_by", "created_at", "workspace_id")


class Store:
    """now: the time that rows get and ages are counted from, so that a run can be repeated; the cluster's clock by default."""

    def __init__(self, spark: SparkSession, root: str, model: models.Model = models.STUB, now: Column | None = None, buckets: int = 64):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.now = now if now is not None else F.current_timestamp()
        self.tables = {n: VersionedTable(spark, f"{self.root}/{n}", s, k, buckets) for n, (s, k) in TABLES.items()}

    def __getitem__(self, name: str) -> VersionedTable:
        return self.tables[name]

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def sql(self, text: str, **args) -> DataFrame:
        """SQL over all tables by their names, with named parameters."""
        for name in self.tables:
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args)

    def _cut(self, rows: DataFrame) -> DataFrame:
        """Rows written once below the store, so that several writes see the same ones."""
        at = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    # sources and chunks

    def put(self, sources: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
        """Take in sources and their chunks; counts by source: indexed, deduped, filtered.

        A source whose content is known is skipped, unless force, which retires its chunks first. A text that an active chunk of
        the workspace holds becomes a reference to it; chunks of talk that say nothing are left out. Chunks are written before
        sources, so that a put which broke off between is done again the next time.
        """
        sources = S.conform(sources, S.SOURCES).withColumn("workspace_id", F.coalesce("workspace_id", F.lit("default")))
        fresh = self._cut(dedup.unchanged_skipped(sources, self.read("sources").select("source_id", "content_hash"), force))
        if force:
            self["chunks"].upsert(self.read("chunks").join(fresh.select("source_id"), "source_id", "left_semi").withColumn("is_active", F.lit(False)).select("chunk_id", "is_active"))
        own = fresh.select("source_id", "source_type", F.col("workspace_id").alias("_ws"))
        rows = S.conform(chunks, S.CHUNKS).join(own, "source_id")
        rows = rows.withColumns(
            {
                "workspace_id": F.coalesce("workspace_id", "_ws"), "text_hash": T.text_hash(F.coalesce("text", F.lit(""))), "is_active": F.lit(True), "created_at": F.coalesce("created_at", self.now),
                "superseded_by": F.lit(None).cast("string"), "_why": T.skip_reason(F.col("text"), F.col("source_type")),
            }
        )
        key = ["workspace_id", "text_hash"]
        known = self.read("chunks").where("is_active").groupBy(*key).agg(F.min("chunk_id").alias("_known"))
        first = rows.where("_why = ''").groupBy(*key).agg(F.min("chunk_id").alias("_first"))
        marked = self._cut(rows.join(known, key, "left").join(first, key, "left").withColumn("canonical_chunk_id", F.coalesce("_known", "_first")))
        good = marked.where("_why = ''")
        self["chunks"].upsert(good.where("chunk_id = canonical_chunk_id").select(*[f.name for f in S.fields(S.CHUNKS)]), update=CHUNK_UPDATE)
        refs = good.where("chunk_id <> canonical_chunk_id").select("canonical_chunk_id", "source_id", "workspace_id", self.now.alias("created_at"))
        self["source_refs"].append_new(refs)
        self["sources"].upsert(fresh)
        n = lambda c: F.count(F.when(c, 1))
        counts = marked.groupBy("source_id").agg(
            n(F.expr("_why = '' AND chunk_id = canonical_chunk_id")).alias("indexed"), n(F.expr("_why = '' AND chunk_id <> canonical_chunk_id")).alias("deduped"), n(F.expr("_why <> ''")).alias("filtered")
        )
        self["log"].append(counts.select("source_id", F.lit("put").alias("event_type"), F.to_json(F.struct("indexed", "deduped", "filtered")).alias("payload"), self.now.alias("created_at")))
        return counts

    def source(self, source_id: str) -> DataFrame:
        return self.read("sources").where(F.col("source_id") == source_id).limit(1)

    def chunk(self, chunk_id: str, active_only: bool = True) -> DataFrame:
        rows = self.read("chunks").where(F.col("chunk_id") == chunk_id)
        return rows.where("is_active") if active_only else rows

    def chunks_of(self, source_id: str, active_only: bool = True) -> DataFrame:
        rows = self.read("chunks").where(F.col("source_id") == source_id)
        return (rows.where("is_active") if active_only else rows).orderBy("ordinal", "chunk_id")

    def also_in(self, chunk_id: str) -> DataFrame:
        """The other sources that hold a chunk's text."""
        own = self.chunk(chunk_id, False).select("source_id")
        return self.read("source_refs").where(F.col("canonical_chunk_id") == chunk_id).join(own, "source_id", "left_anti").select("source_id").distinct()

    def explain(self, chunk_id: str) -> DataFrame:
        """Where a chunk comes from: its memory key, source, level and what took its place."""
        rows = self.chunk(chunk_id, False).join(self.read("sources").select("source_id", "path", "repo", "source_type"), "source_id", "left")
        category = F.coalesce(F.get("category_labels", F.lit(0)), F.lit("uncategorized"))
        return rows.select("chunk_id", T.memory_key(F.lit("repo"), category, F.col("source_id"), F.col("text_hash")).alias("memory_key"), "source_id", "path", "repo", "source_type", "chunk_level", "is_active", "superseded_by")

    def supersede(self, pairs: DataFrame) -> None:
        """Chunks old_id end, and new_id takes their place."""
        self["chunks"].upsert(pairs.join(self.read("chunks").select(F.col("chunk_id").alias("old_id")), "old_id", "left_semi").select(F.col("old_id").alias("chunk_id"), F.lit(False).alias("is_active"), F.col("new_id").alias("superseded_by")))

    def invalidate(self, source_id: str) -> int:
        """Retire the active chunks of a source; how many there were."""
        return self["chunks"].update((F.col("source_id") == source_id) & F.col("is_active"), is_active=F.lit(False))

    def set_visibility(self, source_id: str, visibility: str, org_id: str | None = None) -> bool:
        """False if there is no such source."""
        if visibility not in S.VISIBILITIES:
            raise ValueError(f"none of {', '.join(S.VISIBILITIES)}: {visibility}")
        return self["sources"].update(F.col("source_id") == source_id, visibility=F.lit(visibility), org_id=F.lit(org_id)) > 0

    def purge(self, workspace: str) -> tuple[int, int]:
        """Retire all chunks of a workspace and delete its sources."""
        mine = F.col("workspace_id") == workspace
        return self["chunks"].update(mine & F.col("is_active"), is_active=F.lit(False)), self["sources"].delete(mine)

    def move(self, old: str, new: str) -> int:
        """Sources, chunks and references of one workspace go to another."""
        return sum(self[t].update(F.col("workspace_id") == old, workspace_id=F.lit(new)) for t in ("sources", "chunks", "source_refs"))

    def workspaces(self) -> DataFrame:
        return self.read("chunks").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(F.col("is_active"), 1)).alias("active"))

    def cleaned_labels(self, workspace: str | None = None, strict: bool = False, dry_run: bool = True) -> DataFrame:
        """Active chunks whose labels lose implausible model-made ones, before and after; written back unless dry_run. What has
        none left waits for a new category with confidence 0."""
        rows = self.read("chunks").where("is_active")
        rows = rows.where(F.col("workspace_id") == workspace) if workspace else rows
        found = rows.select("chunk_id", F.col("category_labels").alias("before"), T.cleaned_labels(F.col("category_labels"), strict).alias("after"), "category_source", "category_confidence")
        found = self._cut(found.where("size(before) > size(after)"))
        if not dry_run:
            none = F.size("after") == 0
            self["chunks"].upsert(found.select("chunk_id", F.col("after").alias("category_labels"), F.when(none, "cleanup-pending").otherwise(F.col("category_source")).alias("category_source"), F.when(none, 0.0).otherwise(F.col("category_confidence")).alias("category_confidence")))
        return found.select("chunk_id", "before", "after")

    # search

    def reindex(self, source_id: str | None = None, most_chars: int = 500) -> None:
        """Vectors of all active chunks, or of one source's, from the start of their texts; equal starts are asked for once."""
        rows = self.read("chunks").where("is_active")
        rows = rows.where(F.col("source_id") == source_id) if source_id else rows
        rows = models.embedded(rows.select("chunk_id", F.substring("text", 1, most_chars).alias("head")), "head", self.model)
        self["vectors"].upsert(rows.select("chunk_id", "embedding"))

    def search(self, query: str, top_k: int = 8, workspace: str | None = None, org: str | None = None, repo: str | None = None, categories: list[str] | None = None, source_type: str | None = None, affinity_source: str | None = None, advised: bool = False) -> DataFrame:
        """The top_k chunks that a caller may see, by words, nearness, age, feedback and, if asked, a model's advice."""
        scope = retrieval.in_scope(self.read("chunks"), self.read("sources"), repo, categories, source_type, workspace, org)
        asked = F.array(*[F.lit(float(x)) for x in self.model.embed([query])[0]])
        near = self.read("vectors").join(scope.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", clamped(cosine(F.col("embedding"), asked)).alias("score_vector"))
        near = near.orderBy(F.desc("score_vector"), "chunk_id").limit(2 * top_k)
        terms = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
        advice = None
        if advised:
            first = retrieval.hybrid_search(scope, self.read("feedback"), terms, 20, near)
            advice = models.advice(first, query, self.model)
        return retrieval.hybrid_search(scope, self.read("feedback"), terms, top_k, near, advice, affinity_source, self.now)

    def context(self, hits: DataFrame, budget: int = 6000) -> DataFrame:
        """Search results as one text within a budget."""
        more = self.read("chunks").select("chunk_id", "source_id", "summary")
        return retrieval.compressed(hits.join(more, "chunk_id").withColumn("summary", F.coalesce("summary", F.lit(""))), budget)

    def note_context(self, query: str, hits: DataFrame, workspace: str = "default") -> None:
        """Remember which chunks, at most top_k, were given for a query."""
        ids = hits.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score_final")).alias("s"), "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
        self["contexts"].append(ids.select(F.lit(uuid.uuid4().hex).alias("id"), F.lit(query).alias("query"), "chunk_ids", F.lit(False).alias("was_referenced"), F.lit(workspace).alias("workspace_id"), self.now.alias("created_at")))

    def rate(self, rows: DataFrame) -> None:
        """Append feedback(chunk_id, signal[, metadata]). Where the metadata don't say what was asked, the newest context that
        gave the chunk does, and is marked as referenced."""
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit(None).cast("string"))
        given = self.read("contexts").select("id", "query", "created_at", F.explode("chunk_ids").alias("chunk_id"))
        last = given.groupBy("chunk_id").agg(F.max_by(F.struct("id", "query"), F.struct("created_at", "id")).alias("_c"))
        said = F.coalesce(F.from_json("metadata", "map<string, string>"), F.create_map().cast("map<string, string>"))
        known = F.map_contains_key(said, F.lit("query_context"))
        full = F.when(known | F.col("_c").isNull(), said).otherwise(F.map_concat(said, F.create_map(F.lit("query_context"), F.col("_c.query"))))
        out = self._cut(rows.join(last, "chunk_id", "left").select(F.xxhash64("chunk_id", "signal", F.uuid()).alias("id"), "chunk_id", "signal", F.to_json(full).alias("metadata"), self.now.alias("created_at"), F.when(~known, F.col("_c.id")).alias("_context")))
        self["feedback"].append(out.drop("_context"))
        self["contexts"].upsert(out.where("_context IS NOT NULL").select(F.col("_context").alias("id"), F.lit(True).alias("was_referenced")).distinct())

    def unrated(self, minutes: int = 120, most: int = 100) -> DataFrame:
        """Chunks of the newest contexts that nobody referred to, each once, in the order they were given."""
        recent = self.read("contexts").where(~F.col("was_referenced") & (F.col("created_at") >= self.now - F.make_dt_interval(mins=F.lit(minutes))))
        recent = recent.orderBy(F.desc("created_at"), "id").limit(most).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")))
        rows = recent.select("_n", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
        return rows.groupBy("chunk_id").agg(F.min(F.struct("_n", "pos")).alias("_o")).orderBy("_o").select("chunk_id")

    def changes(self, since, after_id: str = "", limit: int = 500, workspace: str | None = None) -> DataFrame:
        """A page of changes after a cursor of time and id, retired chunks too, with their vectors."""
        rows = self.read("chunks").join(self.read("sources").select("source_id", "visibility"), "source_id", "left")
        return changes_since(rows, since, after_id, limit, workspace).join(self.read("vectors"), "chunk_id", "left")

    def count_triggers(self, fires: DataFrame, threshold: float = 0.1, least: int = 50) -> None:
        """Add fires(trigger, referenced) to the counters; a trigger that is little used after least fires ends for good."""
        new = fires.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("referenced").cast("long")).alias("m")).join(self.read("triggers"), "trigger", "left")
        new = new.select("trigger", (F.coalesce("fires", F.lit(0)) + F.col("n")).alias("fires"), (F.coalesce("refs", F.lit(0)) + F.col("m")).alias("refs"), F.coalesce("active", F.lit(True)).alias("active"))
        self["triggers"].upsert(new.withColumn("active", F.col("active") & ~((F.col("fires") >= least) & (F.col("refs") / F.col("fires") < threshold))))

    # graph

    def put_nodes(self, nodes: DataFrame, user: str = "system") -> None:
        self["nodes"].upsert(S.conform(nodes, S.NODES))
        self._contributed(nodes.select("workspace_id", F.col("id").alias("target_node")), user, "upsert_node")

    def put_edges(self, edges: DataFrame) -> None:
        """Edges by source, target, type and workspace: weight and context of a known one are replaced."""
        rows = S.conform(edges, TABLES["edges"][0])
        ident = F.sha2(F.concat_ws("|", "source", "target", "type", "workspace_id"), 256)
        rows = rows.withColumns({"id": F.coalesce("id", ident), "discovered_at": F.coalesce("discovered_at", self.now), "validated": F.coalesce("validated", F.lit(False))})
        self["edges"].upsert(rows)

    def put_clusters(self, clusters: DataFrame, user: str = "system") -> None:
        """Clusters with their members; a member's node gets the cluster's id."""
        rows = self._cut(clusters)
        self["clusters"].upsert(S.conform(rows, TABLES["clusters"][0]))
        members = rows.select("cluster_id", "workspace_id", F.explode("members").alias("id"))
        known = members.join(self.read("nodes").select("id", "workspace_id"), ["id", "workspace_id"], "left_semi")
        self["nodes"].upsert(known.select("id", "workspace_id", "cluster_id"))
        self._contributed(rows.select("workspace_id", F.col("cluster_id").alias("target_node")), user, "upsert_cluster")

    def _contributed(self, rows: DataFrame, user: str, action: str) -> None:
        self["contributions"].append(rows.select("workspace_id", F.lit(user).alias("user_id"), F.lit(action).alias("action"), "target_node", self.now.alias("ts")))

    def nodes(self, workspace: str) -> DataFrame:
        return self.read("nodes").where(F.col("workspace_id") == workspace)

    def edges(self, workspace: str, node: str | None = None, kind: str | None = None) -> DataFrame:
        rows = self.read("edges").where(F.col("workspace_id") == workspace)
        rows = rows.where((F.col("source") == node) | (F.col("target") == node)) if node else rows
        return rows.where(F.col("type") == kind) if kind else rows

    def clusters(self, workspace: str, most: int = 200) -> DataFrame:
        """Clusters with their size and first members by id; all members are in nodes()."""
        rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))
        sizes = self.nodes(workspace).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
        first = self.nodes(workspace).select("cluster_id", "id", rank.alias("n")).where(F.col("n") <= most).groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("members"))
        return self.read("clusters").where(F.col("workspace_id") == workspace).join(sizes, "cluster_id", "left").join(first, "cluster_id", "left")

    def graph_json(self, workspace: str) -> DataFrame:
        return graph.graph_json(self.nodes(workspace), self.edges(workspace))

    def snapshot(self, workspace: str, trigger: str = "manual") -> str:
        """Keep what the graph holds now, an item a row, with its counts; the snapshot's id."""
        ident = uuid.uuid4().hex
        item = lambda rows, kind, a, b="", c="": rows.select(F.lit(ident).alias("snapshot_id"), F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b"), (F.col(c) if c else F.lit("")).alias("c"))
        mine = self.read("clusters").where(F.col("workspace_id") == workspace)
        items = self._cut(item(self.nodes(workspace), "node", "id").union(item(self.edges(workspace), "edge", "source", "target", "type")).union(item(mine, "cluster", "cluster_id")))
        self["snapshot_items"].append(items)
        n = lambda k: F.count(F.when(F.col("kind") == k, 1))
        self["snapshots"].append(items.agg(n("node").alias("nodes"), n("edge").alias("edges"), n("cluster").alias("clusters")).select(F.lit(ident).alias("id"), F.lit(workspace).alias("workspace_id"), self.now.alias("created_at"), F.lit(trigger).alias("trigger"), "nodes", "edges", "clusters"))
        return ident

    def timeline(self, workspace: str, limit: int = 20) -> DataFrame:
        return self.read("snapshots").where(F.col("workspace_id") == workspace).orderBy(F.desc("created_at"), "id").limit(limit)

    def _snapshot_at(self, workspace: str, at) -> str | None:
        rows = self.read("snapshots").where((F.col("workspace_id") == workspace) & (F.col("created_at") <= F.lit(at)))
        return rows.agg(F.max_by("id", F.struct("created_at", "id"))).first()[0]

    def changed(self, workspace: str, start, end) -> DataFrame:
        """Items added and removed between the last snapshots at or before two times."""
        items = self.read("snapshot_items")
        of = lambda i: items.where(F.col("snapshot_id") == F.lit(i))
        return diff.graph_diff(of(self._snapshot_at(workspace, start)), of(self._snapshot_at(workspace, end)), ["kind", "a", "b", "c"])

    def forget_snapshots(self, workspace: str, keep: int = 20) -> int:
        old = diff.beyond_newest(self.read("snapshots").where(F.col("workspace_id") == workspace), "workspace_id", [F.desc("created_at"), "id"], keep)
        ids = [r.id for r in old.select("id").collect()]
        for table, column in (("snapshot_items", "snapshot_id"), ("snapshots", "id")):
            if ids:
                self[table].delete(F.col(column).isin(ids))
        return len(ids)

    def conflicts(self, workspace: str) -> DataFrame:
        return diff.edge_conflicts(self.edges(workspace))

    def resolve_conflicts(self, workspace: str) -> int:
        """Of the validated edges between two nodes the newest stays; how many went."""
        mine = self.edges(workspace)
        gone = [r.id for r in mine.join(diff.resolved_conflicts(mine).select("id"), "id", "left_anti").select("id").collect()]
        return self["edges"].delete((F.col("workspace_id") == workspace) & F.col("id").isin(gone)) if gone else 0

    def team_activity(self, workspace: str, start, end) -> DataFrame:
        rows = self.read("contributions").where(F.col("workspace_id") == workspace)
        return rows.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
