"""Windows of a sequence that occur again, found by prefix-free parsing into phrases.

A rolling hash of short grams sets triggers: the least gram hash of a window. Consecutive windows with the same trigger form
a phrase, and neighbouring phrases overlap by a window less one, so that each window lies in one phrase whole. Equal windows
have the same trigger wherever they stand, and so lie in phrases of one class. The dictionary, dealt out by class, holds each
distinct phrase once; the parse are the phrases' fingerprints with their places. Phrases that occur again whole are settled
by the parse alone; only phrases that share a class with different ones are spelt out, one of each content.

Equal phrases of a stretch of a task's input go on as one row with their number. A class whose
different phrases may have more than MOST_ITEMS items is never gathered in one task: its windows are dealt out by content.

Rows are told apart by doc, the doc_id (a hash of the text where that is null), and h, a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BYTES, SEGMENT, WORDS, _TABLE, Rolling, fingerprint, joined, portions, sliding_min, word_hashes, words
from .common import Tables, texts

#: Items, bytes or words, of a class that are gathered in one task; the windows of larger classes are dealt out one by one.
MOST_ITEMS = 1 << 23
#: Keys with more than this share of all phrases are found before anything is gathered by key.
SHARE = 1.01e-4
#: Phrases of a task that are held back so that equal ones go on as one row.
HELD = 200_000
PHRASES = "key long, fp long, doc long, h long, start long, n int, again boolean, copies long"
PLACE = ("doc", "h", "start")


@dataclass(frozen=True)
class Kind:
    """What a sequence is made of, bytes or words; window and gram length are in these."""

    window: int
    gram: int
    words: bool

    @property
    def hot(self) -> int:
        """Phrases of a class that is gathered; but for those of one trigger over and over, they are shorter than two windows."""
        return MOST_ITEMS // (2 * self.window)

    def items(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Of concatenated documents: a number for each item, the documents' bounds among the items, the bytes that spell the
        items, and where each item starts in these (None: item i is byte i)."""
        if not self.words:
            return _TABLE[raw], at, raw, None
        start, end, first = words(raw, at)
        return word_hashes(raw, start, end), first, *joined(raw, start, end)

    def rolling(self, values: np.ndarray) -> Rolling:
        return Rolling(values, WORDS if self.words else BYTES)


def byte_kind(window: int = 200, gram: int = 32) -> Kind:
    return Kind(window, gram, False)


def word_kind(window: int = 20, gram: int = 5) -> Kind:
    return Kind(window, gram, True)


def _spelt(data: np.ndarray, edge: np.ndarray | None, start: np.ndarray, stop: np.ndarray) -> Iterator[memoryview]:
    """The bytes of the items from each start to each stop; words are joined by one space."""
    view = memoryview(np.ascontiguousarray(data))
    if edge is not None:
        start, stop = edge[start], edge[stop] - 1
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        yield view[a:b]


def phrases(kind: Kind, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the concatenated values of documents, which start at at: trigger, first and last window of each phrase, its document,
    whether the trigger occurs in it twice."""
    n = len(values) - kind.window + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
    if n <= 0:
        return none
    grams = kind.rolling(values).grams(kind.gram)
    width = kind.window - kind.gram + 1
    least = sliding_min(grams, width)[:n]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    whole = np.arange(n) + kind.window <= at[1:][doc]
    head = whole.copy()
    head[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    start = np.flatnonzero(head)
    if not len(start):
        return none
    tail = whole.copy()
    tail[:-1] &= ~whole[1:] | head[1:]
    last = np.flatnonzero(tail)
    key = least[start]
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    again = np.zeros(len(start), dtype=bool)
    for i in range(0, len(start), 4096):
        j = slice(i, i + 4096)
        first_at = start[j] + (view[start[j]] == key[j, None]).argmax(axis=1)
        last_at = last[j] + width - 1 - (view[last[j]][:, ::-1] == key[j, None]).argmax(axis=1)
        again[j] = first_at != last_at
    return key.view(np.int64), start, last, doc[start], again


def _stretches(kind: Kind, n: int) -> Iterator[tuple[int, int]]:
    """Bounded stretches of n values that hold each window once."""
    for lo in range(0, max(1, n - kind.window + 1), SEGMENT):
        yield lo, min(n, lo + SEGMENT + kind.window - 1)


def _combined(held: list[tuple[np.ndarray, ...]], earlier: bool) -> Iterator[pa.RecordBatch]:
    """Of equal phrases the first place with their number; the other places with a number of 0. Places that repeat go only once,
    and where only earlier ones count they don't add to the number."""
    key, fp, doc, h, start, n, again = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((start, h, doc, fp, key))
    key, fp, doc, h, start, n, again = (c[order] for c in (key, fp, doc, h, start, n, again))
    head = np.ones(len(key), dtype=bool)
    head[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    new = head.copy()
    new[1:] |= (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (start[1:] != start[:-1])
    group = np.cumsum(head) - 1
    copies = np.zeros(len(key), np.int64)
    copies[head] = np.bincount(group[new] if earlier else group, minlength=group[-1] + 1 if len(group) else 0)
    cols = [pa.array(c[new]) for c in (key, fp, doc, h, start, n.astype(np.int32), again, copies)]
    table = pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PHRASES.split(", ")])
    for i in range(0, table.num_rows, 65536):
        yield table.slice(i, 65536)


def phrase_rows(docs: DataFrame, kind: Kind, earlier: bool) -> DataFrame:
    """The phrases of docs(doc, h, text): equal ones of a stretch of a task have copies at the first place, and 0 at the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for part, raw, at in portions(batch):
                values, bounds, data, edge = kind.items(raw, at)
                doc_of, h_of = (part.column(i).to_numpy() for i in (0, 1))
                for lo, hi in _stretches(kind, len(values)):
                    key, start, last, doc, again = phrases(kind, values[lo:hi], np.clip(bounds, lo, hi) - lo)
                    start, last = start + lo, last + lo
                    fp = np.fromiter(map(fingerprint, _spelt(data, edge, start, last + kind.window)), np.int64, len(start))
                    held.append((key, fp, doc_of[doc], h_of[doc], start - bounds[doc], last - start + 1, again))
                    many += len(key)
                if many >= HELD:
                    yield from _combined(held, earlier)
                    held, many = [], 0
        if many:
            yield from _combined(held, earlier)

    return docs.select("doc", "h", "text").mapInArrow(run, PHRASES)


def pack(start, n):
    """A stretch of n windows as one number; n is at most SEGMENT."""
    return F.shiftleft(start, 24).bitwiseOR(n.cast("long"))


def unpack(stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return stretches >> 24, stretches & ((1 << 24) - 1)


def _spell(docs: DataFrame, todo: DataFrame, kind: Kind, emit: Callable, schema: str) -> DataFrame:
    """Rows of emit(doc, h, keys, starts, numbers, contents) for the phrases of todo(key, doc, h, start, n), read from the texts anew."""
    by_doc = todo.groupBy("doc", "h").agg(F.collect_list(F.struct("key", pack(F.col("start"), F.col("n")).alias("at"))).alias("todo"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in portions(batch):
                _, bounds, data, edge = kind.items(raw, at)
                doc, h = (part.column(i).to_numpy() for i in (0, 1))
                for i, row in enumerate(part.column(3)):
                    key, packed = (row.values.field(k).to_numpy() for k in (0, 1))
                    start, n = unpack(packed)
                    ends = np.cumsum(n + kind.window)
                    j = 0
                    while j < len(n):  # batches of bounded size
                        k = max(j + 1, int(np.searchsorted(ends, (ends[j - 1] if j else 0) + SEGMENT)))
                        s, m = start[j:k], n[j:k]
                        first = bounds[i] + s
                        content = _spelt(data, edge, first, first + m + kind.window - 1)
                        yield pa.RecordBatch.from_arrays(emit(int(doc[i]), int(h[i]), key[j:k], s, m, content), names=names)
                        j = k

    return docs.join(by_doc, ["doc", "h"]).select("doc", "h", "text", "todo").mapInArrow(run, schema)


def positions(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of n."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def spelt_windows(docs: DataFrame, todo: DataFrame, kind: Kind) -> DataFrame:
    """(hash, doc, h, pos) of each window of the phrases of todo; the hash are 128 bits of BLAKE2."""

    def emit(doc, h, key, start, n, content):
        got = []
        for text in content:
            data = np.frombuffer(text, np.uint8)
            edge = np.concatenate(([0], np.flatnonzero(data == 0x20) + 1, [len(data) + 1])) if kind.words else None
            many = len(data) - kind.window + 1 if edge is None else len(edge) - kind.window
            begin = np.arange(many)
            got.extend(hashlib.blake2b(w, digest_size=16).digest() for w in _spelt(data, edge, begin, begin + kind.window))
        pos = positions(start, n)
        return [pa.array(got, pa.binary()), pa.array(np.full(len(pos), doc)), pa.array(np.full(len(pos), h)), pa.array(pos)]

    return _spell(docs, todo, kind, emit, "hash binary, doc long, h long, pos long")


def settled_phrases(docs: DataFrame, todo: DataFrame, kind: Kind, settle: Callable) -> DataFrame:
    """(doc, h, stretch): what settle finds in the dictionary's shards, whole classes of todo's phrases.

    settle(rows) gets rows(key, doc, h, start, n, content) sorted by key, and gives places in them: row, start, number of windows.
    """

    def emit(doc, h, key, start, n, content):
        many = len(key)
        return [pa.array(key), pa.array(np.full(many, doc)), pa.array(np.full(many, h)), pa.array(start), pa.array(n), pa.array(map(bytes, content), pa.binary())]

    def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        row, start, n = settle(rows)
        if len(row):
            doc, h = (rows.column(c).to_numpy()[row] for c in ("doc", "h"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array((start << 24) | n)], names=["doc", "h", "stretch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            sizes = np.concatenate(([0], np.cumsum(batch.column(4).to_numpy() + kind.window)))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if weight > SEGMENT >> 1 and key[a] != last:
                    yield from close(held)
                    held, weight = [], 0
                held.append(batch.slice(a, b - a))
                weight += int(sizes[b] - sizes[a])
                last = key[a]
        if held:
            yield from close(held)

    rows = _spell(docs, todo, kind, emit, "key long, doc long, h long, start long, n long, content binary")
    return rows.repartition("key").sortWithinPartitions("key", "doc", "h", "start").mapInArrow(run, "doc long, h long, stretch long")


def with_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc, h) of docs: the row key is the same each time that the table is read."""
    h = F.xxhash64("text")
    doc = F.coalesce("doc_id", F.xxhash64("text", F.lit(1)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    return texts(docs).withColumns({"doc": doc, "h": h})


def _hot_keys(rows: DataFrame, hot: int) -> list[int]:
    """Keys of more than hot rows, all that have more than SHARE of them; at most 1 / SHARE keys reach the driver."""
    often = rows.select("key").stat.freqItems(["key"], SHARE).first()[0]
    return [r.key for r in rows.where(F.col("key").isin(often)).groupBy("key").count().where(F.col("count") > hot).collect()] if often else []


def found_stretches(docs: DataFrame, tables: Tables, kind: Kind, earlier: bool, settle: Callable, hot: int | None = None) -> DataFrame:
    """(doc, h, stretch) of docs(doc, h, text): runs of starts of windows that start elsewhere too, or, with earlier, that start
    at an earlier place by (doc, h, start); the first of equal windows is not among these then."""
    hot = kind.hot if hot is None else hot
    every = tables.write(phrase_rows(docs, kind, earlier), "phrases")
    rows = every.where("copies > 0")
    keys = _hot_keys(rows, hot)
    known = F.col("key").isin(keys) if keys else F.lit(False)
    stretch = pack(F.col("start"), F.col("n")).alias("stretch")
    place = F.struct(*PLACE)

    by_class, by_text = Window.partitionBy("key"), Window.partitionBy("key", "fp")
    # by class first: one exchange serves all windows, and most phrases, alone in their class, are gone before the second sort
    shared = rows.where(~known).withColumn("total", F.sum("copies").over(by_class)).where("total > 1 OR again")
    shared = shared.withColumns({"whole": F.sum("copies").over(by_text), "turn": F.row_number().over(by_text.orderBy(*PLACE)), "place": F.rank().over(by_text.orderBy(*PLACE))})
    shared = shared.withColumn("texts", F.count(F.when(F.col("turn") == 1, 1)).over(by_class))
    spell = (F.col("turn") == 1) & ((F.col("texts") > 1) | F.col("again"))
    settled = F.col("place") > 1 if earlier else F.col("whole") > 1
    shared = tables.write(shared.select("key", *PLACE, "n", settled.alias("settled"), spell.alias("spell"), (F.col("texts") > hot).alias("hot")), "shared")
    found = every.where("copies = 0").select("doc", "h", stretch).union(shared.where("settled").select("doc", "h", stretch))
    found = found.union(settled_phrases(docs, shared.where("spell AND NOT hot"), kind, settle))

    todo = shared.where("spell AND hot").select("key", *PLACE, "n")
    if keys:
        many = rows.where(known)
        held = many.groupBy("key", "fp").agg(F.sum("copies").alias("whole"), F.min(F.struct(*PLACE, "n")).alias("f"))
        held = tables.write(held, "hot")
        again = many.select("key", "fp", *PLACE, "n").join(held.where("whole > 1"), ["key", "fp"])
        found = found.union((again.where(place != F.struct("f.doc", "f.h", "f.start")) if earlier else again).select("doc", "h", stretch))
        todo = todo.union(held.select("key", "f.doc", "f.h", "f.start", "f.n"))
    if todo.take(1):
        spelt = tables.write(spelt_windows(docs, todo, kind), "windows")
        twice = spelt.groupBy("hash").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc", "h", "pos")).alias("f")).where("k > 1")
        again = spelt.join(tables.write(twice, "twice"), "hash")
        if earlier:
            again = again.where(F.struct("doc", "h", "pos") != F.col("f"))
        found = found.union(again.select("doc", "h", pack(F.col("pos"), F.lit(1))))
    return tables.write(found, "stretches")


def covered(stretches: np.ndarray, window: int, length: int) -> np.ndarray:
    """Which of length items lie in one of the windows."""
    start, n = unpack(stretches)
    edge = np.zeros(length + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(start, length), 1)
    np.add.at(edge, np.minimum(start + n + window - 1, length), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(gone: np.ndarray) -> np.ndarray:
    """Start and end of each run of true values, one run a row."""
    return np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)


def with_stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, stretches) of docs(doc_id, text, doc, h), with an array (empty if none) from found(doc, h, stretch)."""
    by_doc = found.groupBy("doc", "h").agg(F.collect_list("stretch").alias("stretches"))
    return docs.join(by_doc, ["doc", "h"], "left").select("doc_id", "text", F.coalesce("stretches", F.array().cast("array<long>")).alias("stretches"))
