"""Pieces that the operators share: durable cuts of lineage, Arrow text buffers, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- lineage


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="seekframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that one file may hold: small tables are not spread over as many files as there are partitions.
FILE_ROWS = 1 << 16


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages and retries start from the files.

    ``rows``: where it is known that there are no more; the table then has a file for each ``FILE_ROWS`` of them at most.
    """
    path = table_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing needs it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- Arrow text


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums from which ``range_hash`` hashes any range of ``data``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


class Arena:
    """Results for keys, as columns of byte strings; a slab of keys is looked up once for each distinct one.

    Keys that aren't held go to ``make``, which gives one binary array a column.  When more than ``limit`` keys or
    ``most`` bytes would be held, only those that the slab in hand asks for stay.
    """

    def __init__(self, make, columns: int, limit: int, most: int = 1 << 26):
        self.make, self.columns, self.limit, self.most = make, columns, limit, most
        self.slot: dict[bytes, int] = {}
        self.held = [binary(np.zeros(0, np.uint8), np.zeros(1, np.int64)) for _ in range(columns)]

    def slots(self, keys: pa.Array) -> np.ndarray:
        """The place of each key's results."""
        coded = keys.dictionary_encode()
        listed = coded.dictionary.to_pylist()
        get = self.slot.get
        place = np.fromiter([get(k, -1) for k in listed], np.int64, len(listed))
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.slot) + len(new) > self.limit or any(len(h.buffers()[2] or b"") > self.most for h in self.held):
                stay = np.flatnonzero(place >= 0)
                self.held = [h.take(pa.array(place[stay])) for h in self.held]
                place[stay] = np.arange(len(stay))
                self.slot = {listed[i]: n for n, i in enumerate(stay.tolist())}
            n = len(self.slot)
            place[new] = np.arange(n, n + len(new))
            made = self.make(coded.dictionary.take(pa.array(new)))
            self.held = [pa.concat_arrays([h, m]) for h, m in zip(self.held, made)]
            self.slot.update(zip([listed[i] for i in new.tolist()], range(n, n + len(new))))
        return place[coded.indices.to_numpy()]

    def take(self, column: int, slots: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The results at ``slots`` one after the other, and their n + 1 offsets."""
        found = self.held[column].take(pa.array(slots))
        _, ends, data = found.buffers()
        return memoryview(data if data is not None else b""), np.frombuffer(ends, np.int32)[: len(found) + 1] if len(found) else np.zeros(1, np.int32)


def binary(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    """Byte strings from their bytes and n + 1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space; texts never run together."""
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = doc_starts[doc_starts < len(data)]
    first[at] = inside[at]
    before = at[at > 0] - 1
    last[before] = inside[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


# ---------------------------------------------------------------- components


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, root)``, root the smallest node reachable.

    Alternating large and small stars; every round is written to the shared folder, so lineage stays short and
    nothing is gathered on the driver but a count and a checksum.  Nodes without an edge are not returned.  ``most``: about
    how many edges there are, for the number of the first files.
    """
    state = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", most)
    seen = None
    while True:
        now = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        # neither star has more edges than both directions of these
        both = state.select("u", "v").unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large", 2 * now[0])
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        state, old = cut(small, "small", 2 * now[0]), state
        drop_table(old)
        drop_table(large)
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component labels (the smallest index) of ``n`` nodes, joining blocks of links one after the other."""
    label = np.arange(n)
    for a, b in pairs:
        a, b = label[a], label[b]
        keep = a != b
        a, b = a[keep], b[keep]
        root = np.arange(n)
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
        label = root[label]
    return label


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, with a group number for each row."""
    held: list[pa.Table] = []
    count = 0

    def number(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.cumsum(change)

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        group = number(table)
        cut_at = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if cut_at:
            yield table.slice(0, cut_at), group[:cut_at]
        held, count = [table.slice(cut_at)], table.num_rows - cut_at
    if held:
        table = pa.concat_tables(held).combine_chunks()
        if table.num_rows:
            yield table, number(table)
