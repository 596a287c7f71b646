"""Embedding near-duplicates by cosine, with randomised-rotation binary codes.

Vectors are normalised and rotated by fixed random rotations.  The signs of a rotated vector are its code; the stored
correction factor is the inner product of the code's unit vector with the vector itself.  From code and factor the
inner product with any other rotated vector is estimated without bias, and the factor gives a confidence bound; pairs
whose upper bound is below the threshold are dropped and only the others are computed again exactly, in double
precision.

Candidates share the first bits of a code.  Several rotations give several tables; the number of bits follows from
the number of distinct vectors and the number of tables from ``RECALL`` for a pair at the threshold.  Equal vectors are
one row with a count.  A pair counts in the first table in which it meets, so link counts are exact for what is found;
a bucket gives one row for each member and never its pairs, and a large bucket is dealt out as pairs of blocks.

Defined results: a vector that is null, empty, zero or holds null or non-finite components has no links and is its own
component; vectors of different lengths are not compared; repeated rows are copies of one another; a null vec_id is
carried and never names a component with other ids; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2, pi, acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, grouped, local_roots

COSINE = 0.95
RECALL = 0.995
BOUND = 4.0
BLOCK = 1024
BUCKET = 64

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, table: int) -> np.ndarray:
    """A fixed random rotation."""
    if (dim, table) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng((dim, table)).standard_normal((dim, dim)))
        _rotations[(dim, table)] = q * np.sign(np.diag(r))
    return _rotations[(dim, table)]


def shape_of(distinct: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket's key and number of tables."""
    bits = min(32, max(4, ceil(log2(max(distinct, 1) / BUCKET + 1))))
    share = (1 - acos(cosine) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - share)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For each table the first ``bits`` signs of the rotated vectors; short vectors take more rotations."""
    dim, out = x.shape[1], []
    for t in range(tables):
        signs = [x @ rotation(dim, t * 64 + part)[: min(dim, bits - part * dim)].T > 0 for part in range(-(-bits // dim))]
        signs = np.concatenate(signs, axis=1)
        out.append(signs @ (1 << np.arange(bits, dtype=np.int64)))
    return np.array(out)


def _table_batches(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                own = batch.take(pa.array(rows))
                vectors = own.column(2)
                key = keys(unit(vectors.flatten().to_numpy().reshape(-1, dim)), bits, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(key[t]), pa.array(np.full(len(rows), dim, np.int32)), own.column(0), own.column(1), vectors], names=["t", "key", "dim", "node", "n", "embedding"])

    return run


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of the coded rows of x with the rows of y, and the bound of each row of x."""
    dim = x.shape[1]
    turn = rotation(dim, 1_000_003)
    rotated = x @ turn.T
    code = np.where(rotated > 0, 1.0, -1.0) / np.sqrt(dim)
    factor = (code * rotated).sum(axis=1)
    bound = BOUND * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    return (code @ (y @ turn.T).T) / factor[:, None], bound


def close_pairs(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with the cosine of x[i], y[j] at least ``cosine``; rows are unit vectors."""
    guess, bound = estimate(x, y)
    i, j = np.nonzero(guess + bound[:, None] >= cosine)
    keep = [np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _bucket_batches(bits: int, tables: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in grouped(batches, ["t", "key", "dim", "lo", "hi"]):
            node = table.column("node").to_numpy()
            count = table.column("n").to_numpy()
            part = table.column("part").to_numpy()
            t, dims = table.column("t").to_numpy(), table.column("dim").to_numpy()
            cross = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            vectors = table.column("embedding").combine_chunks()
            edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a < 2:
                    continue
                x = unit(vectors.slice(a, b - a).flatten().to_numpy().reshape(b - a, dims[a]))
                earlier = keys(x, bits, int(t[a])) if t[a] else np.zeros((0, b - a), np.int64)
                links = np.zeros(b - a, np.int64)
                own = count[a:b]

                def found():
                    left = np.flatnonzero(part[a:b] == part[a:b].min()) if cross[a] else np.arange(b - a)
                    right = np.flatnonzero(part[a:b] != part[a:b].min()) if cross[a] else left
                    for k in range(0, len(left), 512):
                        i, j = close_pairs(x[left[k : k + 512]], x[right], cosine)
                        i, j = left[k + i], right[j]
                        fresh = np.ones(len(i), bool) if cross[a] else i < j
                        for e in earlier:
                            fresh &= e[i] != e[j]
                        i, j = i[fresh], j[fresh]
                        np.add.at(links, i, own[j])
                        np.add.at(links, j, own[i])
                        yield i, j

                root = local_roots(b - a, found())
                some = np.flatnonzero(links)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a:b][some]), pa.array(links[some]), pa.array(node[a:b][root[some]])], names=["node", "links", "root"])

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``embeddings(vec_id, embedding)``."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long"), vector.alias("embedding"))
    rows = rows.select("vec_id", "embedding", F.when(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)), F.xxhash64("embedding")).alias("node"))
    distinct = cut(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding")), "vectors")
    bits, tables = shape_of(distinct.count(), cosine, recall)
    inner = kind if kind in ("array<float>", "array<double>") else "array<double>"
    dealt = distinct.select("node", "n", "embedding").mapInArrow(_table_batches(bits, tables), f"t int, key long, dim int, node long, n long, embedding {inner}")
    dealt = cut(dealt, "tables")
    full = cut(dealt.groupBy("t", "key", "dim").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = dealt.join(full, ["t", "key", "dim"]).withColumn("part", F.pmod("node", parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("t", "key", "dim", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "n", "embedding")
    placed = placed.repartition("t", "key", "dim", "lo", "hi").sortWithinPartitions("t", "key", "dim", "lo", "hi", "node")
    found = cut(placed.mapInArrow(_bucket_batches(bits, tables, cosine), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "node2")
    known = distinct.select("node", "n", "first").join(links, "node", "left")
    known = cut(known.join(roots, known["node"] == roots["node2"], "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first", F.coalesce("root", "node").alias("root")), "known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    valid = F.col("node").isNotNull()
    component = F.when(valid, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op8_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
