"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes weighted counts of its byte-class pairs (its letters, marks and their order) and a few shares of repeated
words. A truncated SVD of a bounded sample of labelled rows gives the space; the sample's vectors are broadcast, and each
document's exact cosines with all of them are computed in blocks. The nearest vote with weights that grow with similarity.

Feature rows live in blocks of BLOCK documents only, and travel to the driver as their counts that are not zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U, mix, portions, word_hashes, words
from .common import arrow_rows, texts

SAMPLE = 2048  # labelled rows at most, so the broadcast model has at most SAMPLE * DIMENSIONS * 4 bytes and a basis
DIMENSIONS = 48
NEIGHBOURS = 24
BLOCK = 128  # documents whose features lie in memory at once
CLASSES, HASHED, EXTRA = 64, 1024, 4
PAIRS = CLASSES * CLASSES + HASHED
RESULT = "doc_id long, score double, predicted int"


def _classes() -> np.ndarray:
    """Byte to class: small letters, capitals, digits, blanks, each usual mark, the rest; from 64 on bytes beyond ASCII."""
    out = np.full(256, 63, dtype=np.uint16)
    out[97:123] = np.arange(26)
    out[65:91] = 26
    out[48:58] = 27
    out[[32]] = 28
    out[[10, 13]] = 29
    out[[9, 11, 12]] = 30
    for i, c in enumerate(b".,!?;:'\"-_()[]{}<>/\\|#$%&*+=@~^`"):
        out[c] = 31 + min(i, 29)
    out[128:] = np.arange(64, 192)
    return out


def _pairs() -> np.ndarray:
    """Pair of classes to feature: of its own within ASCII, else one of HASHED."""
    a, b = np.divmod(np.arange(192 * 192, dtype=np.uint64), U(192))
    mixed = CLASSES * CLASSES + (mix(a * U(192) + b) % U(HASHED)).astype(np.int64)
    return np.where((a < CLASSES) & (b < CLASSES), (a * U(CLASSES) + b).astype(np.int64), mixed).astype(np.int16)


_CLASS, _PAIR = _classes(), _pairs()


def features(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Counts of class pairs and EXTRA shares of repetition for each of the concatenated documents, in blocks of them."""
    kinds = _CLASS[raw]
    pair = _PAIR[kinds[:-1].astype(np.int32) * 192 + kinds[1:]]
    start, end, first = words(raw, at)
    hashes = word_hashes(LOWER[raw], start, end)
    for lo in range(0, len(at) - 1, BLOCK):
        hi = min(lo + BLOCK, len(at) - 1)
        out = np.zeros((hi - lo, PAIRS + EXTRA), dtype=np.float32)
        for row, i in zip(out, range(lo, hi), strict=True):
            a, b = at[i], at[i + 1]
            if b - a > 1:
                row[:PAIRS] = np.bincount(pair[a : b - 1], minlength=PAIRS)
            h = hashes[first[i] : first[i + 1]]
            if len(h) > 1:
                pairs = h[:-1] * U(0x9FB21C651E98DF25) + h[1:]
                row[-EXTRA:] = ((h[1:] == h[:-1]).mean(), (h[2:] == h[:-2]).mean() if len(h) > 2 else 0, 1 - len(np.unique(h)) / len(h), 1 - len(np.unique(pairs)) / len(pairs))
        yield out


@dataclass
class Model:
    """idf and mean: of the sample's features; basis: to the latent space; vectors, quality: of the sample."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    quality: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the space, of features that are weighed in place."""
        y = _weigh(x, self.idf) @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The share of votes for quality 1, for a block of features; without any labelled row 0.5 for all."""
        if not len(self.vectors):
            return np.full(len(x), 0.5)
        k = min(neighbours, len(self.vectors))
        near = np.round(self.latent(x) @ self.vectors.T, 4)
        least = np.partition(near, -k, axis=1)[:, -k]
        row, at = np.nonzero(near >= least[:, None])  # all that tie with the last neighbour vote
        weight = np.exp(12 * near[row, at].astype(np.float64))
        share = np.bincount(row, weight * self.quality[at]) / np.bincount(row, weight)
        return np.round(np.clip(share, 0, 1), 5)  # blocks differ in the last bits


def _weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """In place: shares of pairs, damped, times idf, with unit length; the repetition shares keep a fixed weight beside them."""
    head = x[:, :PAIRS]
    head /= np.maximum(head.sum(axis=1, keepdims=True), 1)
    np.sqrt(head, out=head)
    head *= idf
    head /= np.maximum(np.sqrt(np.einsum("ij,ij->i", head, head))[:, None], 1e-9)
    return x


def fit(x: np.ndarray, quality: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """A randomised truncated SVD of the sample, whose features are used up."""
    seen = np.count_nonzero(x[:, :PAIRS], axis=0)
    idf = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
    k = min(dimensions, *x.shape) if len(x) else 0
    if not k:
        return Model(idf, np.zeros((x.shape[1], 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    y = _weigh(x, idf)
    q = np.linalg.qr(y.T @ np.random.default_rng(5).standard_normal((len(y), min(k + 16, len(y))), dtype=np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(y.T @ (y @ q))[0]
    basis = (q @ np.linalg.svd(y @ q, full_matrices=False)[2][:k].T).astype(np.float32)
    vectors = y @ basis
    return Model(idf, basis, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), quality.astype(np.float64))


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """The bounded sample: labelled rows outside the held-out fold, in an order of their ids' hashes."""
    fold = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).where("quality IN (0, 1)")
    fold = fold.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = fold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled rows (0 or 1); null and other labels, and rows without a document, don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in portions(batch):
                rows = [(np.flatnonzero(r).astype(np.int16), r) for x in features(raw, at) for r in x]
                places = pa.array([i.tobytes() for i, _ in rows], pa.binary())
                counts = pa.array([r[i].tobytes() for i, r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), places, counts], names=["doc_id", "quality", "places", "counts"])

    arrow_rows(docs.sparkSession)
    rows = _sampled(docs, labels, sample).mapInArrow(run, "doc_id long, quality int, places binary, counts binary")
    rows = rows.dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    x = np.zeros((rows.num_rows, PAIRS + EXTRA), np.float32)
    for row, places, counts in zip(x, rows.column("places"), rows.column("counts"), strict=True):
        row[np.frombuffer(places.as_buffer(), np.int16)] = np.frombuffer(counts.as_buffer(), np.float32)
    return fit(x, rows.column("quality").to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For every row of docs(doc_id, text, ...): doc_id, held_out, score, predicted.

    score is from 0 to 1, higher where label 1 is likelier, and a function of the text alone; predicted is 1 from 0.5 on.
    Labels are learnt from rows whose crc32(doc_id as text) mod 3 is not 1; held_out marks the others (null without an id).
    Null texts are empty ones and get the score of their neighbours like all; whole texts count, however long; equal texts
    get equal scores; with no usable label all scores are 0.5; an empty table gives an empty result; of columns but doc_id,
    text and labels' quality none is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, raw, at in portions(batch):
                score = np.concatenate([model.score(x) for x in features(raw, at)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = texts(docs).mapInArrow(run, RESULT)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose text the classifier does not reject (a score from 0.5 on), with all their columns, in one pass
    without a shuffle.

    Null texts are judged as empty ones, rows that repeat each; ids may be null or repeat, as only texts are judged. With no
    usable label all rows stay; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, raw, at in portions(batch):
                yield part.filter(pa.array(np.concatenate([model.score(x) >= 0.5 for x in features(raw, at)])))

    return docs.mapInArrow(run, docs.schema)
