"""Text batches as NumPy arrays: words, their hashes and rolling hashes of many documents at once.

All hashes are 64-bit and depend on content alone, never on where in a batch the content lies. Rolling hashes are polynomials
modulo 2**64, for which texts with equal hashes can be made at will: they only choose triggers. What decides whether texts
are equal is word_hashes, BLAKE2 or the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


BYTES, WORDS = Powers(), Powers(0xD1342543DE82EF95)


class Rolling:
    """Polynomial hashes of grams of a sequence, after one pass over it."""

    def __init__(self, values: np.ndarray, powers: Powers):
        n = len(values)
        up, self.down = powers.to(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k consecutive values."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one document after the other, and where each starts; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def portions(batch: pa.RecordBatch, size: int = SEGMENT) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in slices of whole documents with about so many bytes of column text, at least one document each."""
    raw, at = column_bytes(batch.column(batch.schema.get_field_index("text")))
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and, for each document, the number of its first word."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~SPACE[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word raw[start:end]: its bytes, eight at a time, go through a chain of bijections, long words through BLAKE2."""
    size = end - start
    out = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    if not len(size):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))
    at, c = np.arange(len(size)), 0
    long = np.flatnonzero(size > 128)
    while len(at) and c < 128:
        left = np.minimum(size[at] - c, 8).astype(np.uint64)
        out[at] = mix(out[at] ^ (eight[start[at] + c] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * left)))) + U(0xD1342543DE82EF95)
        c += 8
        at = at[size[at] > c]
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].data, digest_size=8).digest(), "little")
    return out


def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space after each, as bytes, and where each of them starts there (and one place past the last)."""
    size = end - start + 1
    edge = np.concatenate(([0], np.cumsum(size)))
    out = np.append(raw, np.uint8(0x20))[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])]
    out[edge[1:] - 1] = 0x20
    return out, edge


def fingerprint(data) -> int:
    """64 bits of BLAKE2 as a signed number."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Suffixes:
    """The order of the suffixes of a text by their first symbols, by prefix doubling; only groups not yet in order are sorted again.

    rank[i] is the place, in the suffix array, of the first suffix that begins with the same have symbols as the one at i.
    """

    def __init__(self, symbols: np.ndarray, have: int = 1):
        order = np.argsort(symbols, kind="stable")
        self.have, self.rank = have, np.empty(len(order), np.int64)
        self.rank[order] = _heads(symbols[order])

    def double(self, by: int) -> None:
        """From here on ranks tell have + by symbols apart, by at most have; suffixes shorter than that count as if they ended in a low symbol."""
        n, rank = len(self.rank), self.rank
        alive = np.bincount(rank, minlength=n)[rank] > 1
        at = np.flatnonzero(alive)
        if len(at):
            after = np.zeros(len(at), np.int64)
            inside = at + by < n
            after[inside] = rank[at[inside] + by] + 1
            key = rank[at] * (n + 1) + after
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            old = rank[at]
            rank = rank.copy()
            # a group's first place, and how far each of its new groups begins after it
            rank[at] = old + _heads(key) - _heads(old)
        self.rank, self.have = rank, self.have + by

    def upto(self, width: int) -> np.ndarray:
        """The ranks by the first width symbols."""
        while self.have < width:
            self.double(min(self.have, width - self.have))
        return self.rank


def _heads(x: np.ndarray) -> np.ndarray:
    """For sorted values the place of the first equal one."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return np.repeat(at, np.diff(np.append(at, len(x))))


def byte_symbols(data: np.ndarray, width: int = 8) -> np.ndarray:
    """Of each place the next width bytes (at most 8) as one number in the bytes' order, with zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.ndarray((len(data),), ">u8", padded.data, 0, (1,)).astype(np.uint64)
    return out >> U(64 - 8 * width)
