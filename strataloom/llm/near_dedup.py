"""MinHash near-dedup on two-word shingles.

Many universal hash minima per document are cut into bands; documents that share a band are candidates, their signatures
prune them, whole shingle sets decide. Components come from alternating large-star and small-star.

No stage emits the pairs of a group. (1) Equal shingle sets become one representative. (2) In a few rounds each representative
is compared with one pivot: of the pivots of its buckets that are in another component than its own, the one it shares most
buckets with; a bucket's pivot is from its largest component. The verified links give components, into which a group of
thousands of copies collapses. (3) Only buckets that still hold two components or more are looked at again, in blocks of
bounded size, by signature; what comes out are (document, other component) pairs, each pair of documents in the first band
only that they share. (4) Such a document goes to all blocks of the other component, and whole sets are compared there, so
that no link between components is lost; one link each is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U, mix, portions, word_hashes, words
from .common import Tables, arrow_rows, texts
from .components import connected_components

BANDS, ROWS = 40, 5
#: A pair below this share of equal minima is not compared in full; at 200 minima, 0.8 lies five deviations above it.
LEAST_ESTIMATE = 0.66
BUCKET_BLOCK, SET_BLOCK, GUESTS = 512, 256, 4096
PIVOT_ROUNDS = 2
NUM, DEN = 80, 100

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_BAND_SALT = mix(_rng.integers(0, 2**63, BANDS, dtype=np.uint64))

FEATURES = "doc_id long, n_shingles long, set_fp binary, sig binary, bands array<long>"


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its two-word shingles; of a single word, that word; else none."""
    start, end, first = words(raw, at)
    hashes = word_hashes(LOWER[raw], start, end)
    pairs = mix(hashes[:-1] * U(0x9FB21C651E98DF25) + mix(hashes[1:])) if len(hashes) > 1 else np.zeros(0, np.uint64)
    for i in range(len(at) - 1):
        a, b = first[i], first[i + 1]
        yield np.unique(pairs[a : b - 1]) if b - a > 1 else mix(hashes[a:b] + U(0x51ED270B))


def minima(items: np.ndarray) -> np.ndarray:
    """The 32 high bits of the least value of each of BANDS * ROWS universal hashes of a non-empty set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(items), 512):
        part = items[None, i : i + 512] * _A[:, None]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> U(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band of signatures (documents x minima), one row a document."""
    keys = np.repeat(_BAND_SALT[None, :], len(sig), axis=0)
    for row in sig.reshape(-1, BANDS, ROWS).transpose(2, 0, 1):
        keys = mix(keys * U(0xFF51AFD7ED558CCD) + row)
    return keys.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, at in portions(batch):
            n, fp, sig, bands, many = [], [], [], [], [0]
            for items in shingle_sets(raw, at):
                n.append(len(items))
                fp.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                if len(items):
                    low = minima(items).astype(np.uint16)
                    sig.append(low.tobytes())
                    bands.append(band_keys(low[None, :])[0])
                else:
                    sig.append(None)
                many.append(many[-1] + BANDS * bool(len(items)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(fp, pa.binary()),
                    pa.array(sig, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(many, pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))),
                ],
                names=["doc_id", "n_shingles", "set_fp", "sig", "bands"],
            )


def features(docs: DataFrame) -> DataFrame:
    return texts(docs).mapInArrow(_features, FEATURES)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, at in portions(batch):
            items = list(shingle_sets(raw, at))
            ends = np.cumsum([0, *map(len, items)]).astype(np.int32)
            flat = np.concatenate(items).view(np.int64) if items else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["rep", "items"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first columns, of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(int(c[a]) for c in cols)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket block: (x, other) where the signature of x resembles one of the other component."""
    for (key, _, _), rows in _groups(batches, 3):
        rep, comp, size, part, length = (rows.column(c).to_numpy() for c in ("rep", "comp", "size", "part", "length"))
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        if len(rep) < 2 or comp.min() == comp.max():
            continue
        sig = np.stack([np.frombuffer(x, dtype=np.uint16) for x in rows.column("sig").to_pylist()])
        here = band_keys(sig) == key
        found: set[tuple[int, int]] = set()
        for i in range(0, len(rep), 64):
            j = slice(i, i + 64)
            other = comp[j, None] != comp[None, :]
            if lo != hi:
                other &= part[j, None] != part[None, :]
            # the smaller component visits the larger one
            other &= (size[j, None] < size[None, :]) | ((size[j, None] == size[None, :]) & (comp[j, None] > comp[None, :]))
            # sets of too different a size are below the threshold whatever they share
            small, large = np.minimum(length[j, None], length[None, :]), np.maximum(length[j, None], length[None, :])
            other &= DEN * small >= NUM * large
            a, b = np.nonzero(other)
            for k in range(0, len(a), 65536):
                p, q = a[k : k + 65536] + i, b[k : k + 65536]
                same = sig[p] == sig[q]
                likely = same.mean(axis=1) >= LEAST_ESTIMATE
                p, q, same = p[likely], q[likely], same[likely]
                first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                ok = here[p, first]
                found.update(zip(rep[p[ok]].tolist(), comp[q[ok]].tolist(), strict=True))
        if found:
            x, y = zip(*sorted(found), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "comp"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of a component, its members first: (a, b) for each visitor that a member is linked with."""
    out_a: list[int] = []
    out_b: list[int] = []
    last, reps, items, owners, sizes, pending = None, [], None, None, None, []

    def close() -> None:
        nonlocal items, owners, sizes
        own = np.repeat(np.arange(len(pending)), [len(p) for p in pending])
        flat = np.concatenate(pending) if pending else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        items, owners, sizes = flat[order], own[order], np.array([len(p) for p in pending], dtype=np.int64)

    for batch in batches:
        comp, blk, kind, rep = (batch.column(i).to_numpy() for i in range(4))
        sets = batch.column(4)
        for r in range(batch.num_rows):
            key = (comp[r], blk[r])
            mine = sets[r].values.to_numpy()
            if key != last:
                last, reps, pending, items = key, [], [], None
            if kind[r] == 0:
                reps.append(int(rep[r]))
                pending.append(mine)
                continue
            if items is None:
                close()
            if not reps:
                continue
            lo, hi = np.searchsorted(items, mine, "left"), np.searchsorted(items, mine, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owners[at], minlength=len(reps))
            hit = np.flatnonzero(DEN * both >= NUM * (sizes + len(mine) - both))
            if len(hit):
                out_a.append(int(rep[r]))
                out_b.append(reps[hit[0]])
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _sized(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows(comp, ...) with the size of their component, from a written table of those that have two members or more: both sides
    are plain, so that a hot component is split by adaptive execution."""
    return rows.join(sizes, "comp", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))


def _pivot_links(label: DataFrame, sets: DataFrame, sizes: DataFrame | None, turn: int, before: DataFrame | None) -> DataFrame:
    """(a, b): links before, and those of representatives of label(key, rep, comp) to one pivot each, whole sets compared."""
    open_ = label.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = _sized(label.join(open_, "key", "left_semi"), sizes) if turn else label.withColumn("size", F.lit(1))
    # the first turn takes the smallest id, later ones another member of the largest component each
    order = F.struct("size", F.xxhash64("rep", F.lit(turn)), "rep") if turn else -F.col("rep")
    pivots = rest.groupBy("key").agg(F.max_by(F.struct("rep", "comp"), order).alias("p")).select("key", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("_c"))
    asked = rest.join(pivots, "key").where("comp <> _c").groupBy("rep", "pivot").count()
    asked = asked.groupBy("rep").agg(F.max_by("pivot", F.struct("count", -F.col("pivot"))).alias("pivot"))
    both = asked.join(sets, "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("items").alias("others")), "pivot")
    inter = F.size(F.array_intersect("items", "others"))
    found = both.where(DEN * inter >= NUM * (F.size("items") + F.size("others") - inter)).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    return found if before is None else before.union(found)


def near_duplicates(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """For every row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; the set of a document are its distinct two-word shingles, of a
    single word that word. Documents with 100 * intersection >= 80 * union are linked, component_id is the smallest doc_id
    that links lead to, and the row of that doc_id is kept. Null, empty and blank texts have no shingles and stand alone.
    Rows without a doc_id have no component and are not kept; rows that repeat a doc_id stand for one document each. Whole
    texts count, however long; an empty table gives an empty result; other columns are ignored.

    Bands lose a link at exactly 0.8 with a probability of 1e-7 (40 bands of 5 minima), and fewer above it.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    tables = tables or Tables(spark, "near")
    feats = tables.write(features(docs), "features")
    reps = feats.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_fp").agg(F.min("doc_id").alias("rep"))
    known = tables.write(
        feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_fp")
        .agg(F.min_by(F.struct("doc_id", "n_shingles", "sig", "bands"), "doc_id").alias("r"))
        .select(F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("length"), "r.sig", "r.bands"),
        "reps",
    )
    bands = known.select("rep", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = tables.write(bands.join(shared, "key"), "members")
    candidates = members.select("rep").distinct()
    sets = tables.write(texts(docs).withColumnRenamed("doc_id", "rep").join(candidates, "rep", "left_semi").mapInArrow(_sets, "rep long, items array<long>").dropDuplicates(["rep"]), "sets")

    label, links, comps, sizes = members.withColumn("comp", F.col("rep")), None, None, None
    for n in range(PIVOT_ROUNDS):
        links = tables.write(_pivot_links(label, sets, sizes, n, links), "verified")
        comps = tables.write(connected_components(links, tables), "components")
        sizes = tables.write(comps.groupBy(F.col("component").alias("comp")).agg(F.count(F.lit(1)).alias("size")), "sizes")
        named = comps.select(F.col("node").alias("rep"), "component")
        label = members.join(named, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))

    open_ = label.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    rest = _sized(label.join(open_, "key", "left_semi"), sizes).join(known.select("rep", "length", "sig"), "rep")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("key", F.least("part", "q").alias("lo"), F.greatest("part", "q").alias("hi"), "rep", "comp", "size", "part", "length", "sig")
    order = ["key", "lo", "hi"]
    visits = tables.write(rest.repartition(*order).sortWithinPartitions(*order).mapInArrow(_alike, "x long, comp long").distinct(), "visits")

    # members of a visited component in blocks, its guests in turns; each block meets each turn in a task of its own
    asked = visits.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / GUESTS).cast("int").alias("turns"))
    asked = tables.write(_sized(asked, sizes).select("comp", F.ceil(F.col("size") / SET_BLOCK).cast("int").alias("blocks"), "turns"), "asked")
    every = candidates.join(named, "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp"))
    homes = every.join(asked, "comp").withColumn("b", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    guests = visits.select("comp", F.col("x").alias("rep")).join(asked, "comp").withColumn("t", F.pmod(F.xxhash64("rep"), "turns"))
    guests = guests.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = [rows.select("comp", (F.col("b") * F.col("turns") + F.col("t")).cast("long").alias("blk"), F.lit(kind).alias("kind"), "rep") for kind, rows in enumerate((homes, guests))]
    order = ["comp", "blk"]
    met = met[0].unionByName(met[1]).join(sets, "rep").select("comp", "blk", "kind", "rep", "items")
    more = met.repartition(*order).sortWithinPartitions(*order, "kind").mapInArrow(_linked, "a long, b long")
    star = comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    more = tables.write(more, "links")
    if more.take(1):
        comps = connected_components(star.unionByName(more), tables)
    ids = feats.select("doc_id", "n_shingles", "set_fp").join(reps, "set_fp", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    ids = ids.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
    return ids.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs of which one of each group stays, that with the smallest doc_id, with all their columns.

    Rows without a doc_id take part under a number from 2**62 up that is a hash of their text, so that rows with a smaller doc_id
    go before them; of equal texts one of them stays, and those without shingles all stay.
    """
    of_text = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    bare = docs.where(F.col("doc_id").cast("long").isNull())
    some = bool(bare.take(1))
    tables = Tables(docs.sparkSession, "near")
    known = near_duplicates(docs.select(F.coalesce(F.col("doc_id").cast("long"), of_text).alias("doc_id"), "text") if some else docs, tables)
    kept = known.where("kept").select(F.col("doc_id").alias("_kept_id"), "n_shingles").distinct()
    kept = (tables.write(kept, "kept") if some else kept).alias("k")
    named = docs.alias("d").join(kept, F.col("d.doc_id").cast("long") == F.col("k._kept_id"), "left_semi")
    if not some:
        return named
    bare = bare.select(F.struct(*docs.columns).alias("row"), of_text.alias("_id")).join(kept, F.col("_id") == F.col("k._kept_id"))
    bare = bare.where("n_shingles = 0").unionByName(bare.where("n_shingles > 0").dropDuplicates(["_id"]))
    return named.unionByName(bare.select("row.*"))
