"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are words, and beside them their shapes (runs of upper case, lower case and
digits, and the marks between them), pairs of shapes in a row, and whether a word
repeats the one before. A bounded labelled sample gives term weights and a truncated
singular value decomposition; its vectors go to all tasks. Every document is compared with
all of them by blocked cosine products and the nearest vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import held_out
from .words import Words, mix, slices

#: Hashed terms of shapes and of words, latent dimensions, labelled rows at most, voting neighbours, documents of a block.
SHAPES, WORDS, DIMENSIONS, SAMPLE, NEIGHBOURS, BLOCK = 1024, 1024, 64, 2_000, 25, 512
TERMS = SHAPES + WORDS
#: What words weigh against shapes.
WORD_WEIGHT = 0.5
#: A document is predicted to be of quality from this score on.
CUT = 0.7

_CLASS = np.arange(256, dtype=np.int64) + 8
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_U = np.uint64


def counts(texts: list[bytes]) -> np.ndarray:
    """Term counts, texts by TERMS."""
    w = Words(texts)
    n = len(w.starts)
    out = np.zeros((len(texts), TERMS), np.float32)
    if not n:
        return out
    kind = _CLASS[w.raw]
    first = np.zeros(len(kind), bool)
    first[w.starts] = True
    inside = np.zeros(len(kind) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    solid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    turn = solid & (first | np.append(True, kind[1:] != kind[:-1]))
    at = np.flatnonzero(turn)
    begin = np.searchsorted(at, w.starts)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    shape = mix(np.add.reduceat(mix(kind[at].astype(_U) + (place.astype(_U) << _U(16))), begin))
    doc = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    next_in = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = mix(shape[next_in] * _U(3) + shape[next_in + 1])
    same = np.where(w.hashes[next_in] == w.hashes[next_in + 1], _U(77), _U(78))
    for d, t in ((doc, shape), (doc[next_in], pairs), (doc[next_in], mix(same))):
        out[:, :SHAPES] += np.bincount(d * SHAPES + (t % _U(SHAPES)).astype(np.int64), minlength=len(texts) * SHAPES).reshape(-1, SHAPES)
    out[:, SHAPES:] = np.bincount(doc * WORDS + (w.hashes % _U(WORDS)).astype(np.int64), minlength=len(texts) * WORDS).reshape(-1, WORDS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Voters:
    """Term weights, axes and labelled vectors fitted to counts (rows by TERMS) and labels 0 or 1."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        held = (rows > 0).sum(axis=0)
        self.weight = np.log((1 + len(rows)) / (1 + held)) + 1
        if len(rows):
            x = self._weighted(rows)
            self.axes = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, : -DIMENSIONS - 1 : -1])
            self.vectors = self.embed(rows)

    def _weighted(self, rows: np.ndarray) -> np.ndarray:
        kinds = ((rows[:, :SHAPES], self.weight[:SHAPES], 1.0), (rows[:, SHAPES:], self.weight[SHAPES:], WORD_WEIGHT))
        return _unit(np.concatenate([_unit(np.sqrt(x.astype(np.float64)) * weight) * part for x, weight, part in kinds], axis=1))

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return _unit(self._weighted(rows) @ self.axes)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The similarity-weighted vote for label 1, with one vote of the prior; the prior alone for no terms."""
        out = np.full(len(rows), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for a in range(0, len(rows), BLOCK):
            # Rounded, so that equal texts agree in any block; of equal similarities the first labelled row counts.
            near = np.round(self.embed(rows[a : a + BLOCK]) @ self.vectors.T, 4)
            top = np.argpartition(np.arange(len(self.labels)) * 1e-9 - near, k - 1, axis=1)[:, :k]
            s = np.sort(np.maximum(0, np.take_along_axis(near, top, axis=1)) ** 8 * np.where(self.labels[top] > 0, 1, -1), axis=1)
            out[a : a + BLOCK] = (np.maximum(s, 0).sum(axis=1) + self.prior * 1e-3) / (np.abs(s).sum(axis=1) + 1e-3)
        return np.clip(out, 0.0, 1.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, texts in slices(b.column("text")):
            rows = counts(texts)
            own = [b.column(c).slice(first, len(texts)) for c in ("h", "doc_id", "label")]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * TERMS), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*own, flat], ["h", "doc_id", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame) -> Voters:
    """Voters from SAMPLE labelled documents at most, the first by a hash of doc_id outside the held-out fold.

    Of a doc_id labelled twice the highest label counts, of texts that share a
    doc_id the least; null labels are left out. Voters keep the order of the hash.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).withColumn("h", F.xxhash64(F.lit("quality"), "doc_id")).orderBy("h", "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").groupBy("h", "doc_id", "label").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(_counted, "h bigint, doc_id bigint, label int, terms array<float>").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    if not got.num_rows:
        return Voters(np.zeros((0, TERMS), np.float32), np.zeros(0))
    return Voters(np.array(got.column("terms").combine_chunks().flatten()).reshape(-1, TERMS), np.array(got.column("label")))


def rate(docs: DataFrame, voters: Voters) -> DataFrame:
    """All rows and columns of docs plus score, in its place if there is one.

    score is the likelihood of quality, 0 to 1. A null, empty or blank text scores
    the share of label 1 in the sample, and so does every text without a sample
    (0.5). Equal texts score alike, repeated rows and null ids stay, and an empty table
    gives no rows.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.scores(counts(texts)) for _, texts in slices(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*found, np.empty(0)]))], [*b.schema.names, "score"])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rated = rate(docs.select("doc_id", "text"), fit(docs, labels))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"))
