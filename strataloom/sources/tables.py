"""Versioned Parquet tables: a manifest names the data of a version, a write makes new data and then a new manifest.

Readers see whole versions only, and a failed write leaves the last one. Keyed tables are kept in buckets of their keys, so an
append writes its own rows and nothing else, and an upsert, update or delete rewrites only the buckets that it touches. All
folder work goes through Hadoop's file system, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import fields

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made a version first; the table is as that one left it."""


class VersionedTable:
    """A table of a schema at a path. keys: what tells rows apart, for upserts; buckets: how many parts a keyed table has, which
    bounds what the driver lists and how much a small change rewrites (1 / buckets of the table for one key)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.buckets = buckets if keys else 1

    # what is stored

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._fs()
        at = path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def _entries(self, version: int | None) -> list[tuple[str, int]]:
        """(segment, bucket) of a version."""
        if version is None:
            return []
        text = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0]
        return [(s, b) for s, b in json.loads(text)["data"]]

    def _load(self, entries: list[tuple[str, int]]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{s}/{BUCKET}={b}" for s, b in entries])

    def read(self, version: int | None = None) -> DataFrame:
        """The last version, or an older one that is still kept."""
        return self._load(self._entries(self.version() if version is None else version))

    # writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _segment(self, rows: DataFrame) -> list[tuple[str, int]]:
        """Write rows as a segment; the entries of its buckets."""
        name = uuid.uuid4().hex
        out = rows.select(*[f.name for f in fields(self.schema)]).withColumn(BUCKET, self._bucket())
        # rebalancing joins small parts of a bucket and splits large ones: neither one task nor many files a bucket
        out = out.hint("rebalance", BUCKET) if self.keys else out
        out.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        return [(name, int(n.split("=")[1])) for n in self._names(f"data/{name}") if n.startswith(f"{BUCKET}=")]

    def _commit(self, base: int | None, entries: list[tuple[str, int]]) -> None:
        path, fs = self._fs()
        number = 0 if base is None else base + 1
        target, fresh = path(f"{self.path}/manifests/{number:012d}.json"), path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps({"data": entries}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(fresh, target):
            fs.delete(fresh, False)
            raise Conflict(f"version {number} of {self.path} is there already")

    def overwrite(self, rows: DataFrame) -> None:
        base = self.version()
        self._commit(base, self._segment(rows))

    def append(self, rows: DataFrame) -> None:
        """Add rows; what is there is not read."""
        base = self.version()
        have = {f.name for f in fields(self.schema)}
        missing = [f for f in fields(self.schema) if f.name not in rows.columns]
        rows = rows.select(*[c for c in rows.columns if c in have], *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
        self._commit(base, self._entries(base) + self._segment(rows))

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, set[int], str]:
        """Incoming rows, written once so that they are the same each time they are read, and the buckets they fall into."""
        at = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        staged = self.spark.read.schema(rows.schema).parquet(at)
        return staged, {r[0] for r in staged.select(self._bucket()).distinct().collect()}, at

    def _drop(self, folder: str) -> None:
        path, fs = self._fs()
        fs.delete(path(folder), True)

    def append_new(self, rows: DataFrame) -> None:
        """Append the rows whose key is not there yet, each key once."""
        base = self.version()
        entries = self._entries(base)
        staged, touched, at = self._staged(rows.dropDuplicates(list(self.keys)))
        known = self._load([e for e in entries if e[1] in touched]).select(*self.keys)
        self._commit(base, entries + self._segment(staged.join(known, list(self.keys), "left_anti")))
        self._drop(at)

    def upsert(self, rows: DataFrame, update: tuple[str, ...] | None = None, order: Column | None = None) -> None:
        """Insert or update by key. update: the columns that a known key takes over (all by default); of several rows for one
        key the last by order counts."""
        base = self.version()
        entries = self._entries(base)
        staged, touched, at = self._staged(rows)
        old = self._load([e for e in entries if e[1] in touched])
        self._commit(base, [e for e in entries if e[1] not in touched] + self._segment(upserted(old, staged, self.keys, update, order)))
        self._drop(at)

    def _rewrite(self, where: Column, change) -> int:
        base = self.version()
        entries = self._entries(base)
        hit = {r[0]: r[1] for r in self._load(entries).where(where).groupBy(self._bucket().alias("b")).count().collect()}
        if hit:
            kept = [e for e in entries if e[1] not in hit]
            self._commit(base, kept + self._segment(change(self._load([e for e in entries if e[1] in hit]))))
        return sum(hit.values())

    def update(self, where: Column, **values: Column) -> int:
        """Set columns where a condition holds; returns the number of rows."""
        return self._rewrite(where, lambda rows: rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, where: Column) -> int:
        return self._rewrite(where, lambda rows: rows.where(~F.coalesce(where, F.lit(False))))

    def vacuum(self, keep: int = 2) -> None:
        """Forget all versions but the last ones, and delete the data that none of these names. Not while others write."""
        kept = self.versions()[-keep:]
        for n in self.versions()[:-keep]:
            self._drop(f"{self.path}/manifests/{n:012d}.json")
        named = {s for v in kept for s, _ in self._entries(v)}
        for segment in self._names("data"):
            if segment not in named:
                self._drop(f"{self.path}/data/{segment}")


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...], update: tuple[str, ...] | None = None, order: Column | None = None) -> DataFrame:
    """One full join by key: known keys keep what is not updated, new ones come whole."""
    if order is not None:
        others = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")
    else:
        new = new.dropDuplicates(list(keys))
    changed = set(update if update is not None else [c for c in new.columns if c not in keys])
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, list(keys), "full")

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        fresh = F.col("_new") if c in changed else F.col("_new") & F.col("_old").isNull()
        return F.when(F.coalesce(fresh, F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])
