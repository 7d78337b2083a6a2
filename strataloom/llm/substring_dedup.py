"""Removal of words that lie in a long run of words which already started earlier, by relative Lempel-Ziv parsing.

The reference is all that stands before a place, indexed in blocks: each trigger class of phrases (:mod:`.windows`) is one, and
holds the first occurrence of each of its phrases, with a suffix array. A document meets every block that one of its triggers
names; no other block holds a window of it. A phrase that a block has whole is one factor. Others are parsed greedily: from the
next place whose window occurs earlier, the factor runs as long as its first source goes on; windows across the factor's end
are looked up as well, as another factor may begin there. Factors of window words or more are what is removed.

The blocks' suffix arrays hold words by their 64-bit hashes; all else compares the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import Suffixes, column_bytes, joined, portions, word_hashes, words
from .common import Tables, arrow_rows
from .suffix_dedup import SPANS
from .windows import covered, found_stretches, positions, runs, with_rows, with_stretches, word_kind

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def greedy_factors(group: np.ndarray, source: np.ndarray, hits: np.ndarray, begin: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """(first window, windows) of each factor. group: equal for equal windows; source: the earliest window that is equal;
    hits: the windows that have an earlier one; begin: where each row's windows start, with the end of the last; row: of each."""
    out, cursor, k = [], 0, 0
    while k < len(hits):
        i = hits[k]
        r, stop = source[i], begin[row[i] + 1]
        most = int(min(stop - i, begin[row[r] + 1] - r))
        apart = group[i : i + most] != group[r : r + most]
        m = int(apart.argmax()) or most
        out.append((int(i), int(m)))
        cursor = i + m  # the first window that goes over the factor's end
        k = int(np.searchsorted(hits, cursor))
    return out


def earlier_windows(window: int):
    """For a shard of blocks: the factors of their phrases, each relative to what stands before it in its block."""

    def settle(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, doc, h, first, n = (rows.column(c).to_numpy() for c in ("key", "doc", "h", "start", "n"))
        new = np.ones(len(n), dtype=bool)  # rows that repeat a doc_id and text are one document
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (first[1:] != first[:-1])
        kept = np.flatnonzero(new)
        first, n = first[kept], n[kept]
        data, at = column_bytes(rows.column("content").combine_chunks().take(pa.array(kept)))
        start, end, word = words(data, at)
        row = np.repeat(np.arange(len(n)), n)
        group = Suffixes(word_hashes(data, start, end)).upto(window)[positions(word[:-1], n)]
        # rows are in corpus order within a block, so the first of equal windows is the earliest
        at = np.arange(len(group))
        earliest = np.zeros(len(start), np.int64)
        earliest[group[::-1]] = at[::-1]
        source = earliest[group]
        begin = np.concatenate(([0], np.cumsum(n)))
        found = greedy_factors(group, source, np.flatnonzero(source < at), begin, row)
        i, m = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return kept[row[i]], first[row[i]] + i - begin[row[i]], m

    return settle


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in portions(batch):
                start, end, first = words(raw, at)
                rows = []
                for i, (doc, stretches) in enumerate(zip(part.column(0).to_pylist(), part.column(2), strict=True)):
                    s, e = start[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
                    gone = covered(stretches.values.to_numpy(), window, len(s))
                    kept = hashlib.sha256(joined(raw, s[~gone], e[~gone])[0][:-1].tobytes()).hexdigest()
                    rows.append((doc, len(gone), int(gone.sum()), kept, [{"start": a, "end": b} for a, b in runs(gone).tolist()]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def earlier_passages(docs: DataFrame, window: int = 20, hot: int | None = None, tables: Tables | None = None) -> DataFrame:
    """For every row of docs(doc_id, text, ...): n_words, n_removed, kept_sha256 and the removed spans (word positions).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; a word is removed if a run of window words that covers it also starts earlier:
    in a smaller doc_id, or earlier in the same document. Runs are judged on the input. Null texts have no words, texts of
    fewer words than a window lose nothing. Rows that repeat a doc_id with different texts are different documents, in an order
    of their texts' hashes; rows that repeat both are one document, and are cut alike; rows without a doc_id come after all
    ids below 2**62. Very long texts are read in stretches, but judged whole; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = with_rows(docs)
    found = found_stretches(docs, tables or Tables(spark, "substring"), word_kind(window), True, earlier_windows(window), hot)
    return with_stretches(docs, found).mapInArrow(_apply(window), RESULT)
