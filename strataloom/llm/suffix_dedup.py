"""Removal of bytes that lie in a long string which also starts elsewhere in the corpus, by prefix-free parsing.

Rolling-hash triggers cut documents into phrases (:mod:`.windows`), which overlap by a window less one. The order of the corpus'
suffixes by their first window bytes comes from two orders: the parse, sorted by its phrases, tells which phrases occur again
whole; the dictionary, one shard of whole trigger classes at a time, gets a suffix array by prefix doubling, in which equal
windows of different phrases stand side by side. A class too large for a task gets its windows dealt out by content instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import Suffixes, byte_symbols, column_bytes, portions
from .common import Tables, arrow_rows
from .windows import byte_kind, covered, found_stretches, positions, runs, with_rows, with_stretches

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def repeated_windows(window: int):
    """For a shard of the dictionary: runs of windows whose group in the suffix array has another member."""

    def settle(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, at = column_bytes(rows.column("content").combine_chunks())
        first, n = rows.column("start").to_numpy(), rows.column("n").to_numpy()
        pos = positions(at[:-1], n)
        width = min(8, window)
        group = Suffixes(byte_symbols(data, width), width).upto(window)[pos]
        again = np.bincount(group)[group] > 1
        # no run goes on from one phrase to the next
        row = np.repeat(np.arange(len(n)), n)
        parted = np.zeros(len(again) + len(n), dtype=bool)
        parted[np.arange(len(again)) + row] = again
        run = runs(parted)
        of = row[run[:, 0] - np.searchsorted(np.cumsum(n + 1), run[:, 0], "right")]
        begin = run[:, 0] - of - np.concatenate(([0], np.cumsum(n)[:-1]))[of]
        return of, first[of] + begin, run[:, 1] - run[:, 0]

    return settle


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in portions(batch):
                rows = []
                for i, (doc, stretches) in enumerate(zip(part.column(0).to_pylist(), part.column(2), strict=True)):
                    mine = raw[at[i] : at[i + 1]]
                    gone = covered(stretches.values.to_numpy(), window, len(mine))
                    spans = [{"start": a, "end": b} for a, b in runs(gone).tolist()]
                    rows.append((doc, len(mine), int(gone.sum()), len(spans), hashlib.sha256(mine[~gone].tobytes()).hexdigest(), spans))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS]
                names = [x.split()[0] for x in RESULT.split(", ")[:5]] + ["spans"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def repeated_strings(docs: DataFrame, window: int = 200, hot: int | None = None, tables: Tables | None = None) -> DataFrame:
    """For every row of docs(doc_id, text, ...): n_bytes, n_removed, n_spans, kept_sha256 and the removed spans.

    A byte is removed if a string of window bytes that covers it also starts at another place of any row, the same one
    included; strings are judged on the input. Null texts are empty, texts shorter than a window lose nothing. Rows are told
    apart by doc_id and text, so rows may repeat an id or have none; of rows that repeat both, each counts. Very long texts
    are read in stretches, but judged whole; an empty table gives an empty result; other columns are ignored. Spans are byte
    positions in the UTF-8 text, ends exclusive.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = with_rows(docs)
    found = found_stretches(docs, tables or Tables(spark, "suffix"), byte_kind(window), False, repeated_windows(window), hot)
    return with_stretches(docs, found).mapInArrow(_apply(window), RESULT)
