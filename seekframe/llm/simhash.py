"""SimHash near-duplicates: 64-bit fingerprints, linked at three or fewer differing bits.

Candidates come from tables of fingerprint blocks: with ``k`` differing bits and ``k + 2`` blocks, two blocks of a
linked pair agree whatever bits differ, so a table for each pair of blocks loses no link.  Inside a bucket the pivot
distance table decides: each fingerprint's Hamming distances to many fixed reference fingerprints are computed once,
a pair whose distances differ by more than ``k`` in any coordinate cannot be linked (triangle inequality) and is
discarded, and only survivors have their bits compared.  A bucket gives at most one link for each member (to its
root in the bucket), never its pairs; a large bucket is dealt out as pairs of blocks of bounded size.

Defined results: a null or empty text has fingerprint zero, which links like any other; repeated rows give repeated
rows; a null doc_id is carried and never becomes a component's id unless all its ids are null; ties have no effect,
since the smallest id is taken; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, grouped, local_roots

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SLAB = 1 << 22
PIVOTS = 64


def _slabs(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space."""
    at = 0
    while len(text) - at > SLAB:
        end = at + SLAB
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles, repeats included."""
    ones, total, carry, short = np.zeros(64, np.int64), 0, [], []
    for piece in _slabs(text.translate(_LOWER)):
        words = carry + piece.split()
        if len(words) < shingle:
            carry = short = words
            continue
        carry, short = words[len(words) - shingle + 1 :], []
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))
        ones += _ones(hashes)
        total += len(hashes)
    if not total:
        if not short:
            return 0
        ones, total = _ones(np.array([xxhash.xxh64_intdigest(b" ".join(short), 42)], np.uint64)), 1
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, fp)`` for each row of ``docs``; fp holds the 64 bits as a signed long, th a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(_fingerprint_batches, "doc_id long, th long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, count, dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :])


def _linked(fps: np.ndarray, group: np.ndarray, part: np.ndarray, cross: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs within groups, by pivot coordinates first; ``cross`` rows meet only those of the other part."""
    table = pivot_table(fps)
    gap = 0
    alive = np.arange(len(fps))
    while True:
        gap += 1
        alive = alive[alive + gap < len(fps)]
        alive = alive[group[alive] == group[alive + gap]]
        if not len(alive):
            return
        a, b = alive, alive + gap
        keep = ~cross[a] | (part[a] != part[b])
        a, b = a[keep], b[keep]
        for lo in range(0, PIVOTS, 16):
            near = np.abs(table[a, lo : lo + 16].astype(np.int8) - table[b, lo : lo + 16].astype(np.int8)).max(axis=1, initial=0) <= k
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= k
        if near.any():
            yield a[near], b[near]


def _bucket_links(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in grouped(batches, ["t", "key", "lo", "hi"]):
            signed = table.column("fp").to_numpy()
            part = table.column("part").to_numpy()
            cross = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            root = local_roots(len(signed), _linked(signed.view(np.uint64), group, part, cross, k))
            other = root != np.arange(len(signed))
            yield pa.RecordBatch.from_arrays([pa.array(signed[other]), pa.array(signed[root[other]])], names=["u", "v"])

    return run


def block_masks(k: int = 3, blocks: int | None = None) -> list[int]:
    """Masks of ``blocks - k`` of the blocks of the 64 bits, as signed longs: every choice of them."""
    blocks = blocks or k + 2
    edge = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    out = [sum(each[i] for i in chosen) for chosen in combinations(range(blocks), blocks - k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fps: DataFrame, k: int = 3, block: int = 2048) -> DataFrame:
    """``(u, v)``: enough links between distinct fingerprints ``fps(fp)`` to connect whatever is linked."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(k))])
    rows = fps.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    # from files, so that the join below is of two plain shuffles, which Spark can split where a key is hot
    full = cut(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets", fps.count())
    parts = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(full, ["t", "key"]).select("t", "key", "fp", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), F.sequence(F.lit(0), parts - 1).alias("others"))
    rows = rows.select("t", "key", "fp", "part", F.explode("others").alias("other"))
    rows = rows.select("t", "key", "fp", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    rows = rows.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "fp")
    return rows.mapInArrow(_bucket_links(k), "u long, v long")


def _rooted(marked: DataFrame, k: int) -> tuple[DataFrame, int]:
    """``(fp, first, root)``: each fingerprint with its least row ``(whether the doc_id is null, doc_id, th)`` and root; and their number."""
    fps = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    fps = cut(fps, "firsts", marked.count())
    n = fps.count()
    # links are about as many as fingerprints; files for so many do
    roots = components(links(fps.select("fp"), k), n)
    return cut(fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots", n), n


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``."""
    marked = cut(fingerprints(docs), "fingerprints")
    named, n = _rooted(marked, k)
    least = cut(named.groupBy("root").agg(F.min("first").alias("least")), "least", n)
    named = cut(named.select("fp", "root").join(least, "root").select("fp", F.col("least.doc_id").alias("component_id")), "named", n)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stayed(docs: DataFrame, marked: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least ``first`` of a root in ``named(first, root)``, once each."""
    stay = cut(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__d"), F.col("first.th").alias("__t")), "stay", marked.count())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__t"))
    kept = docs.join(stay, same, "left_semi")
    # rows of one doc_id and text; they are rare, and only if there are any do texts move for them
    again = marked.groupBy("doc_id", "th").count().where("count > 1")
    return kept if again.isEmpty() else kept.withColumn("__t", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "__t"]).drop("__t")


def keep_one(docs: DataFrame, k: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row of the least doc_id, with its own columns."""
    marked = cut(fingerprints(docs), "fingerprints")
    return stayed(docs, marked, _rooted(marked, k)[0])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
