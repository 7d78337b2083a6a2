"""Cost-balanced packing of documents into sequences of a fixed length.

A piece of n tokens costs a linear part plus attention within the piece, a * n + b * n * n. Whole lengths of a long document
are sequences of their own; what remains of each document is dealt out in windows of some thousand documents: from the
longest down, each goes to the sequence of least cost that has room, and is cut only where no sequence has room for all of it. All sequences of a window get full but for less than one, whose tokens are cut into powers of two.

Nothing shuffles: a window is a stretch of one scan task, so its memory is bounded and a lost task repeats exactly.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrays import portions
from .bpe import ByteBpe
from .common import arrow_rows, texts

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WINDOW = 4096


@lru_cache(maxsize=2)
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


class _Open:
    """Open sequences as (cost, number) by their remaining room: the cheapest with at least some room, by a tree of minima."""

    def __init__(self, room: int, n: int):
        self.size = 1 << room.bit_length()
        self.leaves: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.least: list[tuple[float, int]] = [(math.inf, -1)] * (2 * self.size)
        if n:
            self.leaves[room] = [(0.0, s) for s in range(n)]
            self._settle(room)

    def _settle(self, left: int) -> None:
        least, leaf, i = self.least, self.leaves[left], left + self.size
        least[i] = leaf[0] if leaf else (math.inf, -1)
        while i > 1:
            i >>= 1
            least[i] = min(least[2 * i], least[2 * i + 1])

    def push(self, left: int, cost: float, s: int) -> None:
        heapq.heappush(self.leaves[left], (cost, s))
        self._settle(left)

    def pop(self, need: int, left: list[int]) -> tuple[float, int] | None:
        """The cheapest sequence with room for need, which is open no longer; left has the room of each."""
        least, i = self.least, need + self.size
        best = least[i]
        while i > 1:
            if not i & 1:
                best = min(best, least[i + 1])
            i >>= 1
        if best[1] < 0:
            return None
        at = left[best[1]]
        heapq.heappop(self.leaves[at])
        self._settle(at)
        return best


def balance(lengths: list[int], room: int, linear: float = 1.0, quadratic: float = 1 / 512) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items shorter than room; sequences are full or a power of two long."""
    out: list[tuple[int, int, int, int, int]] = []
    n = sum(lengths) // room
    items = [(-x, i, 0) for i, x in enumerate(lengths) if x]
    heapq.heapify(items)
    open_, left, some = _Open(room, n), [room] * n, n
    while items and some:
        size, item, start = heapq.heappop(items)
        size = -size
        # where none has room for all of it, the cheapest takes what it can
        cost, s = open_.pop(size, left) or open_.pop(1, left)
        m = min(size, left[s])
        out.append((item, start, m, s, room - left[s]))
        left[s] -= m
        if left[s]:
            open_.push(left[s], cost + linear * m + quadratic * m * m, s)
        else:
            some -= 1
        if m < size:
            heapq.heappush(items, (m - size, item, start + m))
    # less than one sequence is left: cut at the powers of two of its length
    rest = sum(-x for x, _, _ in items)
    free, offset = 0, 0
    while items or free:
        if not free:
            free, offset = 1 << (rest.bit_length() - 1), 0
            n += 1
        size, item, start = heapq.heappop(items)
        m = min(-size, free)
        out.append((item, start, m, n - 1, offset))
        free, offset, rest = free - m, offset + m, rest - m
        if m < -size:
            heapq.heappush(items, (size + m, item, start + m))
    return out


def pack_sequences(docs: DataFrame, tokenizer: str, room: int = 1024, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of docs(doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the path of a byte-level BPE file, the same on all machines; a document are its ids, special strings in
    texts as the file's library takes them, and then id 0. Each id lies in exactly one piece; pieces of a sequence fill it
    from 0 without gaps, and a sequence is room long or a power of two. ids_crc32 is that of little-endian unsigned 32-bit
    ids; with_ids adds them. Null and empty texts are the id 0 alone; rows that repeat a doc_id are packed each; texts are
    never cut short; an empty table gives an empty result; other columns are ignored. sequence_id is unique in a result, and
    the same in each run that reads the same files in the same splits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, made = _encoder(tokenizer), TaskContext.get(), 0
        base = (task.partitionId() if task else 0) << 40
        rows: list[tuple] = []
        held: list[tuple[int, np.ndarray, int]] = []  # document, what remains of it, where that starts

        def add(doc, ids, start, m, first, total, sequence, offset) -> None:
            piece = ids[start : start + m]
            rows.append((doc, first + start, m, zlib.crc32(piece.tobytes()), total, base + sequence, offset, piece.tolist() if with_ids else None))

        def pack() -> None:
            nonlocal made
            most = 0
            for item, start, m, s, offset in balance([len(ids) for _, ids, _ in held], room):
                doc, ids, first = held[item]
                add(doc, ids, start, m, first, first + len(ids), made + s, offset)
                most = max(most, s + 1)
            made += most
            held.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            names = [x.split()[0] for x in RESULT.split(", ")]
            out = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                out.append(pa.array(cols[7], pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            for part, _, _ in portions(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(bpe.ids(text), np.uint32(0))
                    full = len(ids) // room * room
                    for start in range(0, full, room):
                        add(doc, ids, start, room, 0, len(ids), made, 0)
                        made += 1
                    if full < len(ids):
                        held.append((doc, ids[full:].copy(), full))
                    if len(held) >= WINDOW:
                        pack()
                if len(rows) >= 4096:
                    yield flush()
        pack()
        if rows:
            yield flush()

    arrow_rows(docs.sparkSession)
    return texts(docs).mapInArrow(run, RESULT + ", ids array<int>" * with_ids)
