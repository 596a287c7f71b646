"""Near-copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Words are those of SimHash (ASCII white space, ASCII letters in lower case), and so is the method, with settings for 0.8: a set
has a SimHash fingerprint of ``WORDS`` words of 64 bits, each the majority of 64 bits of its shingles' hashes.

* Candidates share a block table's key.  At 0.8 about 15 % of the bits differ, so few whole blocks agree; of each word a table
  reads its most decided bit, which bit and whether it is set, and a table's key is what it reads of ``READ`` words.
* Block tables alone miss pairs near 0.8 (the README says how many), and none may be lost.  So candidates also share one of
  ``BANDS`` keys of ``ROWS`` MinHash values: a pair at 0.8 shares none with probability (1 - 0.8**5)**40, about 1e-7.
* Every candidate goes through the fingerprints.  The least and the greatest member of a bucket are its pivots: each member's
  distance to them is computed, and those within ``RADIUS`` are compared.  Where that does not make one component of a bucket,
  all members of different components are candidates, in pairs of blocks of bounded size; the table of distances to pivots
  discards those whose distances differ by more than ``RADIUS`` (triangle inequality), then the fingerprints themselves do.
* What is left is decided by its exact similarity, over 64-bit hashes of shingles.  Only links leave a bucket, never its pairs.

Defined results: texts of fewer words than a shingle are one shingle; null, empty and blank texts are alike; equal sets are
one node; a null doc_id is carried; of a component one row of the least doc_id stays; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, grouped, mix
from .simhash import _LOWER, stayed

SHINGLE = 5
BANDS, ROWS = 40, 5
#: Words of a fingerprint; block tables, and words that each reads.
WORDS, TABLES, READ = 16, 24, 4
#: Bits that linked fingerprints differ in at most: a bit differs with a chance of 0.19 at most (sets of 4 and 5), so over 6 deviations.
RADIUS = 64 * WORDS * 27 // 100
PIVOTS = 4
#: The threshold of 0.8 as a fraction, so that it is met exactly.
PART, WHOLE = 4, 5

_rng = np.random.default_rng(5)
_TIMES = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_WORD = _rng.integers(0, 1 << 64, (2, WORDS), dtype=np.uint64) | np.uint64(1)
_READS = np.array([_rng.choice(WORDS, READ, replace=False) for _ in range(TABLES)])


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the text's word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts)))


def margins(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint of a set, by how many more of its shingles' hashes have it than have not."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):
        words = mix(hashes[i : i + 255, None] * _WORD[0] + _WORD[1])
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def fingerprint(margin: np.ndarray) -> np.ndarray:
    """The SimHash words: a bit is 1 if set in over half the hashes."""
    return np.packbits(margin > 0, bitorder="little").view(np.uint64)


def block_keys(margin: np.ndarray) -> np.ndarray:
    """One key for each block table: the most decided bits of its words, and whether they are set."""
    margin = margin.reshape(WORDS, 64)
    most = np.abs(margin).argmax(axis=1)
    read = (2 * most + (margin[np.arange(WORDS), most] > 0)).astype(np.uint64)[_READS]
    key = np.arange(TABLES, dtype=np.uint64) + np.uint64(BANDS)
    for k in range(READ):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + read[:, k] + np.uint64(1))
    return key.view(np.int64)


def set_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set in all tables; none of block tables for sets of under four, near which there are none but equal ones."""
    return np.concatenate([block_keys(margins(hashes)), band_keys(hashes)]) if len(hashes) >= PART else band_keys(hashes)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of the fingerprints of a bucket to its first ones."""
    return np.bitwise_count(fps[:, None] ^ fps[None, :PIVOTS]).sum(axis=2, dtype=np.int32)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash values of a set; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (_TIMES[:, None] * hashes[None, i : i + (1 << 12)] + _PLUS[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), t) for t, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), 42)], np.uint64).view(np.int64)[0])


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    return (shingles(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, keys = [], []
        for hashes in _texts(batch.column(1)):
            nodes.append(_node(hashes))
            keys.append(set_keys(hashes))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "node", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            sets = list(_texts(batch.column(0).slice(i, 256)))
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(margins(s)).view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "hashes", "fp"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between members of different components; rows of two blocks (lo, hi) meet only those of the other one."""
    for table, group in grouped(batches, ["key", "lo", "hi"], 1000):
        node, root, part = (table.column(c).to_numpy() for c in ("node", "root", "part"))
        cross = table.column("lo").to_numpy() != table.column("hi").to_numpy()
        lists = table.column("hashes").combine_chunks()
        edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        hashes = lists.flatten().to_numpy()
        fps = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        us, vs = [], []
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            label = np.unique(root[lo:hi], return_inverse=True)[1]
            if label.max() == 0:
                continue
            distance = pivot_table(fps[lo:hi])
            seen, ids = np.unique(hashes[edge[lo] : edge[hi]], return_inverse=True)
            at = edge[lo:hi] - edge[lo]
            size = np.diff(edge[lo : hi + 1])
            mark = np.zeros(len(seen), bool)
            for i in range(hi - lo - 1):
                meets = label != label[i]
                meets[: i + 1] = False
                if cross[lo]:
                    meets &= part[lo:hi] != part[lo + i]
                meets &= np.abs(distance - distance[i]).max(axis=1) <= RADIUS
                left = np.flatnonzero(meets)
                meets[left] = np.bitwise_count(fps[lo + left] ^ fps[lo + i]).sum(axis=1) <= RADIUS
                if not meets.any():
                    continue
                mine = ids[at[i] : at[i] + size[i]]
                mark[mine] = True
                both = np.add.reduceat(mark[ids], at, dtype=np.int64)
                mark[mine] = False
                for j in np.flatnonzero(meets & (WHOLE * both >= PART * (size + size[i] - both))):
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        us.append(node[lo + i])
                        vs.append(node[lo + j])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def links(docs: DataFrame, nodes: DataFrame, block: int = 256) -> DataFrame:
    """``(u, v)``: enough links between ``nodes(node, first, keys)`` to connect whatever candidates are near-copies."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    n = nodes.count()
    full = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"), "buckets", n * (TABLES + BANDS) // 2)
    members = cut(rows.join(full.select("key", "low", "high"), "key"), "members", n * (TABLES + BANDS))
    n_members = members.count()
    # shingles are kept of candidates only
    wanted = members.select("node").distinct().join(nodes, "node").select(F.col("first.doc_id").alias("__d"), F.col("first.th").alias("__t"))
    text = F.col("text").cast("string")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__t"))
    sets = cut(docs.join(wanted, same, "left_semi").select(text.alias("text")).distinct().mapInArrow(_sets, "node long, hashes array<long>, fp array<long>").dropDuplicates(["node"]), "sets")

    pairs = cut(members.select(F.col("node").alias("u"), F.explode(F.array("low", "high")).alias("v")).where("u <> v").distinct(), "pairs", 2 * n_members)
    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"), F.col("fp").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"), F.col("fp").alias("y")), "v")
    # the distance to a bucket's pivot
    differ = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(WORDS)), F.lit(0))
    met = met.where(differ <= RADIUS)
    both = F.size(F.array_intersect("a", "b"))
    star = cut(met.where(WHOLE * both >= PART * (F.size("a") + F.size("b") - both)).select("u", "v"), "star")

    n_star = star.count()
    roots = cut(components(star, n_star), "roots", 2 * n_star)
    members = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    members = cut(members, "rooted", n_members)
    mixed = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.expr("bit_xor(xxhash64(node))").alias("same"), F.expr("bit_xor(xxhash64(node, 1))").alias("again")).where("low < high")
    # buckets of the same members are compared once, by two hashes of their members
    mixed = mixed.groupBy("n", "same", "again").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("n") / block).cast("int")
    rows = members.join(cut(mixed.select("key", "n"), "mixed", n_members // 2), "key")
    rows = rows.select("key", "node", "root", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    rows = rows.select("key", "node", "root", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    rows = cut(rows, "dealt").join(sets, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return star.unionAll(rows.mapInArrow(_bucket_links, "u long, v long"))


def keep_one(docs: DataFrame, block: int = 256) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component one row of the least doc_id, with its own columns."""
    text = F.col("text").cast("string")
    marked = cut(docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(_marked, "doc_id long, th long, node long, keys array<long>"), "marked")
    nodes = cut(marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.first("keys").alias("keys")), "nodes", marked.count())
    roots = components(links(docs, nodes, block), nodes.count()).withColumnRenamed("node", "__n")
    named = nodes.join(roots, F.col("node") == F.col("__n"), "left").select("first", F.coalesce("root", "node").alias("root"))
    return stayed(docs, marked, named)
