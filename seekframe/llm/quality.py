"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are words, pairs of adjacent words (one feature for all pairs of equal words) and shapes of word endings, hashed to ``2 ** BITS`` weights; a text's value of each is its count over
the square root of the number of features.  Scoring is one sparse dot product.  Training makes ``EPOCHS`` passes of
FTRL-proximal over at most about ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of their text (whole rows, chosen by a hash of
doc_id) in one task of bounded input.

Defined results: empty and null texts score by the intercept alone; without labels every score is 0.5; null doc_id
counts as not held out and is never learned from; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, prefix_hash, range_hash, slabs, text_buffer, word_spans
from .langid import held_out

BITS = 18
SAMPLE = 12_000
SAMPLE_BYTES = 128 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def _pieces(column: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slabs of whole texts; a long text comes in parts cut at white space."""
    data, offsets = text_buffer(column)
    for i, j in slabs(offsets, limit):
        a, b = int(offsets[i]), int(offsets[j])
        while b - a > 2 * limit:
            end = a + limit
            while end < b and data[end] not in (9, 10, 11, 12, 13, 32):
                end += 1
            yield i, j, data[a:end], np.array([0, end - a])
            a = end
        own = offsets[i : j + 1] - a if j > i + 1 else np.array([0, b - a])
        yield i, j, data[a:b], own


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text number and the weight number of every feature."""
    start, end = word_spans(data, offsets[:-1])
    doc = np.searchsorted(offsets, start, "right") - 1
    word = range_hash(prefix_hash(data), start, end)
    tail = np.maximum(start, end - 3)
    shape = range_hash(prefix_hash(_SHAPE[data]), tail, end) ^ np.uint64(0xA5A5)
    same = doc[1:] == doc[:-1]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])[same]
    repeat = (word[1:] == word[:-1])[same]
    pair = np.where(repeat, np.uint64(0x2B5F3A9C71D4E680), pair)
    every = np.concatenate([word, mix(shape), pair])
    return np.concatenate([doc, doc, doc[1:][same]]), (every >> np.uint64(64 - BITS)).astype(np.int64)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        labels = batch.column(1).to_numpy()
        own: dict[int, list] = {}
        for i, _, data, offsets in _pieces(batch.column(0)):
            doc, index = features(data, offsets)
            order = np.argsort(doc, kind="stable")
            doc, index = doc[order] + i, index[order]
            for d in np.unique(doc):
                own.setdefault(int(d), []).append(index[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")])
        for d, parts in own.items():
            index, n = np.unique(np.concatenate(parts), return_counts=True)
            rows.append((index.astype(np.int32), (n / np.sqrt(n.sum())).astype(np.float32), float(labels[d])))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for index, value, label in rows:
            at, x = np.append(index, 1 << BITS), np.append(value, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    yield pa.RecordBatch.from_arrays([pa.array([weights(np.arange(len(z))).astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights, the intercept last, from labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label")).where(F.col("doc_id").isNotNull() & ~held_out(3, 1) & F.col("label").isin(0.0, 1.0))
    rate = SAMPLE / max(known.count(), SAMPLE)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(F.broadcast(chosen), F.col("id") == F.col("doc_id"))
    rows = cut(rows.select("text", "label", F.xxhash64("doc_id").alias("o"), "doc_id"), "sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        rows = rows.where(F.pmod(F.xxhash64("o"), F.lit(1_000_000)) < 1_000_000 * SAMPLE_BYTES / size)
    rows = rows.repartition(1).sortWithinPartitions("o", "doc_id", "label", "text").select("text", "label")
    found = rows.mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(np.float64)
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, j, data, offsets in _pieces(batch.column(1)):
                doc, index = features(data, offsets)
                total[i:j] += np.bincount(doc, weights[index], j - i)
                n[i:j] += np.bincount(doc, minlength=j - i)
            score = 1 / (1 + np.exp(-np.clip(weights[-1] + total / np.sqrt(np.maximum(n, 1)), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; reads doc_id and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(3, 1).alias("held_out"))
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
