"""The best k vectors of each of many queries, kept while batches of vectors go by."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are held at once, and pairs of vectors that are scored exactly at once.
TILE, PAIRS = 1 << 22, 1 << 16
#: More than a product of matrices is off the exact score, and than rounding moves a score.
SLACK = 2e-6


def matrices(arrays: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of an array of lists of doubles, for each length of lists; without nulls and lists with a null."""
    arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    sizes = pc.fill_null(pc.list_value_length(arrays), -1).to_numpy(zero_copy_only=False)
    flat = arrays.flatten()
    if flat.null_count:
        holes = np.unique(pc.list_parent_indices(arrays).to_numpy()[pc.is_null(flat).to_numpy(zero_copy_only=False)])
        sizes = sizes.copy()
        sizes[holes] = -1
    out = []
    for n in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == n)
        values = arrays.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        out.append((rows, values.astype(np.float64, copy=False).reshape(len(rows), n)))
    return out


def norms(v: np.ndarray) -> np.ndarray:
    """As functions.vectors.norm adds: in order."""
    total = np.zeros(len(v))
    with np.errstate(all="ignore"):
        for j in range(v.shape[1]):
            total += v[:, j] * v[:, j]
    return np.sqrt(total)


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from 0 by the decimal digits of a number, as Spark's round."""
    with np.errstate(invalid="ignore", over="ignore"):
        out = np.round(x, 6)
        near = np.flatnonzero(np.abs(np.abs(x * 1e6) % 1 - 0.5) < 1e-4)
    for i in near:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def unit(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(size[:, None] == 0, 0.0, v / size[:, None])


def odd(size: np.ndarray) -> np.ndarray:
    """Whether squares come near a double's bounds: such vectors are always scored exactly."""
    return (size != 0) & ~((size > 1e-100) & (size < 1e100))


def places(g: np.ndarray) -> np.ndarray:
    """The place of each element among its equals, of a sorted array."""
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
    return np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))


class Nearest:
    """The best k of each query by functions.vectors.cosine to six digits, NaN first, null last, ties by id, nulls first.

    A product of matrices finds the vectors that may be among the best k; these are scored in the order in which the column
    expression adds, so that both give the same number. Of equal vectors of a batch only the first k by id are looked at.
    """

    def __init__(self, queries: pa.Array, k: int, least: float | None = None):
        self.k, self.least, self.n = k, least, len(queries)
        self.queries = [(rows, v, norms(v)) for rows, v in matrices(queries)]
        # what is kept: the query's row, the id, the score; NaN and null are told apart by order: 2 is NaN, -2 null
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        self.floor = np.full(self.n, -np.inf)

    def add(self, ids: pa.Array, embeddings: pa.Array) -> None:
        if not len(ids) or not self.n:
            return
        step = max(self.k, TILE // self.n, 1)
        for i in range(0, len(ids), step):
            self._tile(ids.slice(i, step), embeddings.slice(i, step))

    def _tile(self, ids: pa.Array, embeddings: pa.Array) -> None:
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        asks, finds, scores = [], [], []
        scored = np.zeros(len(ids), bool)
        for rows, v in matrices(embeddings):
            scored[rows] = True
            rows, v = self._first(rows, v, place)
            size = norms(v)
            for at, q, long in self.queries:
                n = min(q.shape[1], v.shape[1])
                for a, b in self._likely(at, q[:, :n], long, v[:, :n], size):
                    asks.append(at[a])
                    finds.append(rows[b])
                    scores.append(self._exact(q[:, :n], long, v[:, :n], size, a, b))
        if self.least is None:  # vectors and queries without a score come last
            known = np.concatenate([at for at, _, _ in self.queries]) if self.queries else np.zeros(0, np.int64)
            none = np.setdiff1d(np.arange(self.n), known)
            holes = np.flatnonzero(~scored)
            for qs, vs in ((known[self.floor[known] <= -2], holes), (none, np.arange(len(ids)))):
                vs = vs[np.argsort(place[vs])][: self.k]
                asks.append(np.repeat(qs, len(vs)))
                finds.append(np.tile(vs, len(qs)))
                scores.append(np.full(len(qs) * len(vs), -2.0))
        if sum(map(len, asks)):
            self._merge(np.concatenate(asks), ids.take(pa.array(np.concatenate(finds))), np.concatenate(scores))

    def _first(self, rows: np.ndarray, v: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows with equal vectors the first k by id."""
        keys = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel() if v.shape[1] else np.zeros(len(v), np.int64)
        group = np.unique(keys, return_inverse=True)[1]
        order = np.lexsort((place[rows], group))
        g = group[order]
        keep = np.sort(order[places(g) < self.k])
        return rows[keep], v[keep]

    def _likely(self, at: np.ndarray, q: np.ndarray, long: np.ndarray, v: np.ndarray, size: np.ndarray):
        """Pairs (query, vector) that may be among the best, some at a time."""
        with np.errstate(all="ignore"):
            s = unit(q, long) @ unit(v, size).T
        s[odd(long)], s[:, odd(size)] = np.nan, np.nan
        floor = self.floor[at]
        if s.shape[1] >= self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(np.nan_to_num(s, nan=-np.inf), -self.k, axis=1)[:, -self.k])
        if self.least is not None:
            floor = np.maximum(floor, self.least)
        a, b = np.nonzero(~(s < floor[:, None] - SLACK))
        for i in range(0, len(a), PAIRS):
            yield a[i : i + PAIRS], b[i : i + PAIRS]

    def _exact(self, q: np.ndarray, long: np.ndarray, v: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        with np.errstate(all="ignore"):
            for j in range(q.shape[1]):
                total += q[a, j] * v[b, j]
            n = long[a] * size[b]
            x = rounded(np.where(n == 0, 0.0, total / n))
        return np.where(np.isnan(x), 2.0, x)

    def _merge(self, asks: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        if self.least is not None:
            keep = scores >= self.least
            asks, ids, scores = asks[keep], ids.filter(pa.array(keep)), scores[keep]
        query, score = np.concatenate([self.query, asks]), np.concatenate([self.score, scores])
        all_ = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        place = np.empty(len(all_), np.int64)
        place[pc.sort_indices(all_, null_placement="at_start").to_numpy()] = np.arange(len(all_))
        order = np.lexsort((place, -score, query))
        g = query[order]
        nth = places(g)
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.query, self.score, self.ids = query[order], score[order], all_.take(pa.array(order))
        full = nth == self.k - 1
        self.floor[self.query[full]] = self.score[full]

    def rows(self, names: pa.Array) -> list[pa.RecordBatch]:
        """(query_id, id, score) of all that is kept; names: the queries' ids."""
        if self.ids is None:
            return []
        score = pa.array(np.where(self.score == 2, np.nan, self.score), mask=self.score == -2)
        return pa.table({"query_id": names.take(pa.array(self.query)), "id": self.ids, "score": score}).to_batches(max_chunksize=10_000)
