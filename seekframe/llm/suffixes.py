"""Removal of long repeated strings by a sampled suffix array over bytes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else.  Whether strings repeat is always
decided by sorted suffixes that are compared byte for byte; hashes only discard what cannot repeat.

* Each string of ``WINDOW`` bytes has an anchor: its least ``GRAM``-byte gram by a hash (the first of equals), which
  depends on the string alone.  The strings with one anchor form a run.  A run whose gram's hash stands nowhere else has
  no repeats and is discarded; what repeats must be among the others.
* Sorting every suffix of these would move each byte hundreds of times, so suffixes are sampled in four rounds, from few and
  long ones to many and short ones: at chains of runs (cut at anchors that their hash picks, so that copies are cut alike), at
  runs, at stretches of ``STRETCH`` strings, and at single strings.  In each round, sampled splitters (Spark's range
  partitioning) deal the suffixes out by their leading bytes; each bucket sorts its own by multikey quicksort on words of their
  text and compares neighbours; equal suffixes on both sides of a splitter are found among the ends of all buckets.
* A suffix that is equal to another over the whole of its strings repeats throughout.  Of each set of equal suffixes one goes
  on, and is cut up for the next round; parts whose hash (a run's gram, a stretch's shared bytes, a string) is not found in two
  suffixes that go on are discarded.

All counting is by partial aggregation; equal suffixes are dealt out by their place too, so a passage that a third of the
documents share is never gathered in one task.

Defined results: null and empty texts have no bytes; identical rows are different places, so they remove each other;
texts of under ``WINDOW`` bytes lose nothing; a null doc_id is carried; very long texts are anchored in overlapping
parts; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, cut, mix, powers, prefix_hash, range_hash, slabs, text_buffer

WINDOW = 400
GRAM = 32
STRETCH = 16
SLAB = 1 << 20
#: Texts are anchored so many bytes at a time, which stay in a processor's cache.
NEAR = 1 << 17

#: Runs of a chain: about so many, by the anchors' hashes, and at most so many.
CHAIN, LONGEST = 8, 64
#: Words of eight bytes that suffixes are sorted on.
DEPTHS = 8
#: Bytes of suffixes that a bucket sorts, about.
BUCKET = 12 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by least values from block borders to both sides."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _powers32(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(n)
    return up.astype(np.uint32), down.astype(np.uint32)


_small = _powers32(8 * NEAR)


def _ranks(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the gram at each place; it ranks grams and decides nothing else."""
    up, down = _small if len(data) < 8 * NEAR else _powers32(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint32)
    np.cumsum((data.astype(np.uint32) + np.uint32(1)) * up[: len(data)], out=sums[1:])
    n = len(data) - GRAM + 1
    x = (sums[GRAM:] - sums[:n]) * down[:n]
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _gram_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of the grams at some places."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]).view(np.uint64)
    key = np.zeros(len(at), np.uint64)
    for k in range(words.shape[1]):
        key = mix((key ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return key


def runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of strings with one anchor, in some whole texts: text number, start, end, anchor, hashes."""
    starts = len(data) - WINDOW + 1
    if starts <= 0:
        return {k: np.zeros(0, np.int64) for k in ("doc", "s", "e", "a", "key")}
    at = np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    ranked = (_ranks(data).astype(np.uint64) << np.uint64(32)) | at
    anchor = (sliding_least(ranked, WINDOW - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.ones(starts, bool)
    for end in offsets[1:-1].tolist():
        whole[max(0, end - WINDOW + 1) : end] = False
    p = np.flatnonzero(whole)
    if not len(p):
        return runs(data[:0], offsets)
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (anchor[p[1:]] != anchor[p[:-1]])
    first = np.flatnonzero(new)
    s, e, a = p[first], p[np.append(first[1:], len(p)) - 1] + 1, anchor[p[first]]
    doc = np.searchsorted(offsets, s, "right") - 1
    return {"doc": doc, "s": s, "e": e, "a": a, "key": _gram_keys(data, a)}


_PART = "s int, e int, a int, key long"
_RUN = f"d long, th long, {_PART}"
#: A suffix: its first string, the end of its strings, what it is made of, and its bytes.
_SUFFIX = f"d long, th long, {_PART}, bytes binary"
#: And what it is dealt out by: two words of leading bytes and a hash that parts those which start alike.
_LED = f"{_SUFFIX}, k0 long, k1 long, h long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for i, j in slabs(offsets, NEAR):
            lo, hi = int(offsets[i]), int(offsets[j])
            # a long text in parts that share WINDOW - 1 bytes, so that each string starts in one of them
            parts = [(at, min(hi, at + 4 * SLAB + WINDOW - 1)) for at in range(lo, hi, 4 * SLAB)] if hi - lo > 8 * SLAB else [(lo, hi)]
            for a, b in parts:
                own = offsets[i : j + 1] - lo if len(parts) == 1 else np.array([0, b - a])
                r = runs(data[a:b], own)
                base = own[r["doc"]] - (a - lo)
                row = pa.array(r["doc"] + i)
                ints = [pa.array((r[k] - base).astype(np.int32)) for k in ("s", "e", "a")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *ints, _signed(r["key"])], names=["d", "th", "s", "e", "a", "key"])


def kept(parts: DataFrame, name: str, least: int = 2) -> DataFrame:
    """Of ``parts(key, ...)`` those whose key stands in at least ``least`` rows: no other can repeat."""
    keys = parts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")
    # from files, so that the join is of two plain shuffles, which Spark can split where a key is hot
    return parts.join(cut(keys, f"{name}-keys", parts.count() // least), "key").select(parts.columns)


def tasks(size: int) -> int:
    """Tasks, and so files, for suffixes of so many bytes in all."""
    return size // BUCKET + 8


def _packed(docs: DataFrame) -> DataFrame:
    """``d, th, z``: texts compressed for the shuffle; th tells rows of one doc_id with different texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [packer.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["d", "th", "z"])

    return _keyed(docs).mapInArrow(run, "d long, th long, z binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def _same(left: DataFrame, right: DataFrame, *more: str):
    on = left["d"].eqNullSafe(right["d2"]) & (left["th"] == right["th2"])
    for name in more:
        on &= left[name] == right[f"{name}2"]
    return on


_unpacker = zstandard.ZstdDecompressor()


def _unpacked(z: pa.Scalar) -> bytes:
    return _unpacker.decompress(z.as_buffer(), max_output_size=1 << 31) if z.is_valid else b""


def _led(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = _buffers(batch.column(6))
    word, rows = words_of(data, offsets), np.arange(batch.num_rows)
    lead = [_signed(word(rows, k) ^ np.uint64(1 << 63)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*batch.columns, *lead, _signed(range_hash(prefix_hash(data), offsets[:-1], offsets[1:]))], names=[*batch.schema.names, "k0", "k1", "h"])


def _flat(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and fields of the structs that a column lists; none in null lists."""
    n = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    held = column.flatten()
    return np.repeat(np.arange(len(column)), n), [held.field(k).to_numpy().astype(np.int64) for k in range(held.type.num_fields)]


def _suffixes(batch: pa.RecordBatch, row: np.ndarray, s, e, a, key, data: memoryview, low: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Suffixes of rows ``d, th``, whose bytes are in ``data`` from ``low`` on; some megabytes at a time."""
    size = e - s - 1 + WINDOW
    ends = np.concatenate([[0], np.cumsum(size)])
    for i, j in slabs(ends, 4 * SLAB):
        own = pa.array(row[i:j])
        joined = b"".join([data[x:y] for x, y in zip(low[i:j].tolist(), (low[i:j] + size[i:j]).tolist())])
        ints = [pa.array(x[i:j].astype(np.int32)) for x in (s, e, a)]
        yield _led(pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *ints, pa.array(key[i:j]), binary(joined, ends[i : j + 1] - ends[i])], names=["d", "th", "s", "e", "a", "key", "bytes"]))


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the runs of texts ``d, th, z, runs``."""
    for batch in batches:
        row, (s, e, a, key) = _flat(batch.column(3))
        order = np.lexsort((s, row))
        row, s, e, a, key = (x[order] for x in (row, s, e, a, key))
        first = np.ones(len(s), bool)
        first[1:] = (row[1:] != row[:-1]) | (s[1:] != e[:-1]) | (key[:-1] % CHAIN == 0)
        at = np.arange(len(s))
        first |= (at - np.maximum.accumulate(np.where(first, at, 0))) % LONGEST == 0
        first = np.flatnonzero(first)
        e = e[np.append(first[1:], len(s)) - 1] if len(first) else e
        row, s, a, key = (x[first] for x in (row, s, a, key))
        # as many texts at a time as their packed sizes suggest
        packed = np.concatenate([[0], np.cumsum([len(z.as_buffer()) for z in batch.column(2)])])
        for i, j in slabs(packed, SLAB):
            lo, hi = np.searchsorted(row, [i, j]).tolist()
            texts = [_unpacked(z) for z in batch.column(2).slice(i, j - i)]
            edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            yield from _suffixes(batch, row[lo:hi], s[lo:hi], e[lo:hi], a[lo:hi], key[lo:hi], memoryview(b"".join(texts)), edge[row[lo:hi] - i] + s[lo:hi])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of ``parts`` of larger ones: ``d, th, s, bytes, parts``."""
    for batch in batches:
        data, offsets = _buffers(batch.column(3))
        row, (s, e, a, key) = _flat(batch.column(4))
        low = offsets[:-1][row] + s - batch.column(2).to_numpy().astype(np.int64)[row]
        yield from _suffixes(batch, row, s, e, a, key, memoryview(np.ascontiguousarray(data)), low)


def chains(docs: DataFrame, runs_: DataFrame, most: int) -> DataFrame:
    """The chains of ``runs_(d, th, s, e, a, key)``, which are no more than ``most``, with their bytes."""
    # sets, for repeated rows have one list of runs
    wanted = runs_.groupBy("d", "th").agg(F.collect_set(F.struct("s", "e", "a", "key")).alias("runs")).withColumnsRenamed({"d": "d2", "th": "th2"})
    texts = _packed(docs)
    rows = texts.join(wanted, _same(texts, wanted)).select("d", "th", "z", "runs").mapInArrow(_chain_batches, _LED)
    return rows.coalesce(tasks(most * WINDOW))


def cut_up(whole: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """Suffixes of ``parts(d, th, at, s, e, a, key)``, no more than ``most``, which start in the suffixes ``whole(d, th, s, bytes)`` at ``at``."""
    listed = parts.groupBy("d", "th", "at").agg(F.collect_set(F.struct("s", "e", "a", "key")).alias("parts")).withColumnsRenamed({"d": "d2", "th": "th2"})
    rows = whole.select("d", "th", "s", "bytes")
    same = rows["d"].eqNullSafe(listed["d2"]) & (rows["th"] == listed["th2"]) & (rows["s"] == listed["at"])
    return rows.join(listed, same).select("d", "th", "s", "bytes", "parts").mapInArrow(_cut_batches, _LED).coalesce(tasks(most * WINDOW))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; it passes for a string column, whose bytes are only read."""
    return text_buffer(pa.Array.from_buffers(pa.string(), len(column), column.buffers(), column.null_count, column.offset))


_PARTS = f"d long, th long, at int, {_PART}"


def _part_batch(batch: pa.RecordBatch, row: np.ndarray, first: np.ndarray, end: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), batch.column(4).take(at), _signed(key)], names=["d", "th", "at", "s", "e", "a", "key"])


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of chains; they are those of the texts, for a run depends on its strings alone."""
    for batch in batches:
        data, offsets = _buffers(batch.column(6))
        for i, j in slabs(offsets, NEAR):
            own = offsets[i : j + 1] - offsets[i]
            r = runs(data[offsets[i] : offsets[j]], own)
            row = r["doc"] + i
            shift = batch.column(2).to_numpy().astype(np.int64)[row] - own[r["doc"]]
            part = _part_batch(batch, row, r["s"] + shift, r["e"] + shift, r["key"])
            yield part.set_column(5, "a", pa.array((r["a"] + shift).astype(np.int32)))


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of runs, each with a hash of the bytes that all strings of its place in a run share."""
    for batch in batches:
        data, offsets = _buffers(batch.column(6))
        if not len(data):
            continue
        prefix = prefix_hash(data)
        s, e, a = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
        low, high = (a - e + 1) // STRETCH, (a - s) // STRETCH
        n = high - low + 1
        row = np.repeat(np.arange(len(s)), n)
        b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.maximum(s[row], a[row] - b * STRETCH - STRETCH + 1)
        end = np.minimum(e[row], a[row] - b * STRETCH + 1)
        core = a[row] - b * STRETCH + offsets[:-1][row] - s[row]
        yield _part_batch(batch, row, first, end, mix(range_hash(prefix, core, core + WINDOW - STRETCH + 1) + b.astype(np.uint64)))


def _string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single strings of stretches, each with its hash."""
    for batch in batches:
        data, offsets = _buffers(batch.column(6))
        if not len(data):
            continue
        prefix = prefix_hash(data)
        s, e = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
        row = np.repeat(np.arange(len(s)), e - s)
        p = s[row] + np.arange(len(row)) - np.repeat(np.cumsum(e - s) - (e - s), e - s)
        at = p - s[row] + offsets[:-1][row]
        yield _part_batch(batch, row, p, p + 1, range_hash(prefix, at, at + WINDOW))


def words_of(data: np.ndarray, offsets: np.ndarray):
    """``word(rows, k)``: the k-th eight bytes of some byte strings, as numbers that sort as the bytes do; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    window = np.lib.stride_tricks.sliding_window_view(padded, 8)
    sizes = np.diff(offsets)
    keep = np.concatenate([np.zeros(1, np.uint64), ~np.uint64(0) << np.arange(0, 64, 8, dtype=np.uint64)[::-1]])

    def word(rows: np.ndarray, k: int) -> np.ndarray:
        at = np.minimum(offsets[:-1][rows] + 8 * k, len(data))
        value = np.ascontiguousarray(window[at]).view(">u8").ravel().astype(np.uint64)
        return value & keep[np.clip(sizes[rows] - 8 * k, 0, 8)]

    return word


def multikey_quicksort(word, n: int, depths: int, small: int = 4096) -> np.ndarray:
    """The order of ``n`` rows by their words: three-way partition on one word, equals go on with the next.

    Parts of up to ``small`` rows are sorted on their word at once, and the equals of all of them go on together.
    """
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == depths:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            group = np.zeros(hi - lo, np.int64)
            place = np.arange(hi - lo)
            while len(place) and depth < depths:
                rows = part[place]
                key = word(rows, depth)
                by = np.lexsort((key, group[place]))
                part[place] = rows[by]
                key, group[place] = key[by], group[place][by]
                # a place starts a group where its word or its group differs from the one before
                new = np.ones(len(place), bool)
                new[1:] = (key[1:] != key[:-1]) | (group[place][1:] != group[place][:-1])
                number = np.cumsum(new)
                group[place] = number
                tied = np.bincount(number)[number] > 1
                place, depth = place[tied], depth + 1
            order[lo:hi] = part
            continue
        key = word(part, depth)
        pivot = np.sort(key[[0, (hi - lo) // 2, hi - lo - 1]])[1]
        less, more = key < pivot, key > pivot
        equal = ~(less | more)
        a = lo + int(less.sum())
        b = a + int(equal.sum())
        order[lo:hi] = np.concatenate([part[less], part[equal], part[more]])
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def sorted_groups(data: np.ndarray, offsets: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """For each byte string the number of its set of equal ones, from sorting them and comparing neighbours byte for byte.

    They are sorted on ``DEPTHS`` words of their text and then on ``digest``, a hash of the whole, which only brings equal ones
    together.  Where neighbours differ in spite of one digest, the strings of that digest are told apart by their text.
    """
    n = len(digest)
    word = words_of(data, offsets)
    order = multikey_quicksort(lambda rows, k: word(rows, k) if k < DEPTHS else digest[rows], n, DEPTHS + 1)
    whole = memoryview(np.ascontiguousarray(data))
    low, high = offsets[:-1][order].tolist(), offsets[1:][order].tolist()
    same = np.fromiter((whole[a:b] == whole[c:d] for a, b, c, d in zip(low[1:], high[1:], low, high)), bool, max(n - 1, 0)) if n > 1 else np.zeros(0, bool)
    group = np.empty(n, np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    clash = np.flatnonzero(~same & (digest[order[1:]] == digest[order[:-1]]))
    if len(clash):
        rows = np.flatnonzero(np.isin(digest, digest[order[clash]]))
        known: dict[bytes, int] = {}
        for i in rows.tolist():
            group[i] = known.setdefault(bytes(whole[offsets[i] : offsets[i + 1]]), n + len(known))
        group = np.unique(group, return_inverse=True)[1]
    return group


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each suffix of a bucket whether another one is equal, and the bytes of those that stand for the equal ones."""
    held = [pa.Table.from_batches([b]) for b in batches]
    if not held or not sum(t.num_rows for t in held):
        return
    table = pa.concat_tables(held).combine_chunks()
    del held
    column = table.column("bytes").chunk(0)
    leads = [table.column(k).to_numpy() for k in ("k0", "k1", "h")]
    group = sorted_groups(*_buffers(column), leads[2].view(np.uint64))
    twice = np.bincount(group)[group] > 1
    first = np.zeros(len(group), bool)
    first[np.unique(group, return_index=True)[1]] = True
    # contents that are dealt out as the bucket's first or last are: another bucket may hold the same
    order = np.lexsort(leads[::-1])
    end = np.zeros(len(group), bool)
    for i in order[[0, -1]].tolist():
        end |= np.logical_and.reduce([k == k[i] for k in leads])
    end &= first
    # a bucket's own number: a task may have several buckets
    number = hash(tuple(table.column(k)[0].as_py() or 0 for k in ("d", "th", "s", "e"))) & 0x7FFFFFFFFFFFFFFF
    names = ["d", "th", "s", "e", "a", "key"]
    rest = np.flatnonzero(~first)
    for rows, goes_on in ((np.flatnonzero(first), True), (rest, False)):
        step = 1 << (11 if goes_on else 14)
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            part = table.select(names).take(pa.array(own)).combine_chunks().to_batches()[0]
            shown = column.take(pa.array(own)) if goes_on else pa.nulls(len(own), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(twice[own]), shown, pa.array(end[own]), pa.array([number] * len(own), pa.int64())], names=[*names, "twice", "bytes", "end", "bucket"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What suffixes are dealt out by, for those that have come without."""
    return map(_led, batches)


def compared(suffixes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``d, th, s, e`` of suffixes that another one is equal to, and the suffixes that go on, with their bytes.

    Of equal suffixes one of each bucket that they lie in goes on.
    """
    spark = suffixes.sparkSession
    r = suffixes.agg(F.sum(F.length("bytes"))).first()
    size = r[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET + 1)
    leads = suffixes if "h" in suffixes.columns else suffixes.mapInArrow(_leads, _LED)
    dealt = leads.repartitionByRange(buckets, "k0", "k1", "h", "d", "th", "s")
    out = cut(dealt.mapInArrow(_bucket, f"d long, th long, {_PART}, twice boolean, bytes binary, end boolean, bucket long").coalesce(tasks(size)), name)
    ends = out.where("end")
    over = ends.groupBy("bytes").agg(F.countDistinct("bucket").alias("n")).where("n > 1").select("bytes")
    # a few rows of each bucket: its ends, and those of them that are also another bucket's
    also = ends.where("not twice").join(over, "bytes", "left_semi")
    twice = out.where("twice").select("d", "th", "s", "e").unionAll(also.select("d", "th", "s", "e"))
    return twice, out.where("bytes is not null").select("d", "th", "s", "e", "a", "key", "bytes")


def repeats(docs: DataFrame) -> list[DataFrame]:
    """``d, th, s, e`` of repeated strings, as each of the four rounds finds them."""
    anchors = cut(_keyed(docs).select("d", "th", "text").mapInArrow(_anchor_batches, _RUN), "anchors")
    whole = cut(chains(docs, kept(anchors, "runs"), anchors.count()), "chains")
    found = []
    for name, batches in (("chain", _run_batches), ("run", _stretch_batches), ("stretch", _string_batches), ("string", None)):
        twice, on = compared(whole, f"by-{name}")
        found.append(twice)
        if batches is None:
            return found
        # a run or a stretch whose key no other one has that goes on has nothing left to be equal to
        on = on if name == "chain" else cut(kept(on, f"{name}-on"), f"{name}-open")
        parts = cut(on.mapInArrow(batches, _PARTS), f"{name}-parts")
        whole = cut(cut_up(on, kept(parts, f"{name}-parts"), parts.count()), f"of-{name}")


def _removed(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed ranges of bytes from ranges of repeated starts."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order] - 1 + WINDOW)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def _clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, digests, kept_texts, spans = [], [], [], [], [], []
        for row in range(batch.num_rows):
            text = _unpacked(batch.column(1)[row])
            listed = batch.column(2)[row]
            own: list[tuple[int, int]] = []
            if listed.is_valid and len(listed):
                a, b = _removed(listed.values.field(0).to_numpy().astype(np.int64), listed.values.field(1).to_numpy().astype(np.int64))
                own = list(zip(a.tolist(), b.tolist()))
            at, parts = 0, []
            for a, b in own:
                parts.append(text[at:a])
                at = b
            parts.append(text[at:])
            kept = b"".join(parts)
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept))
            n_spans.append(len(own))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept)
            spans.append([{"s": a, "e": b} for a, b in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept_texts, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, counts, digest of the kept bytes, removed spans and the kept bytes themselves."""
    every = reduce(DataFrame.unionAll, repeats(docs))
    marked = every.groupBy("d", "th").agg(F.collect_list(F.struct("s", "e")).alias("starts"))
    marked = cut(marked, "starts", docs.count()).withColumnsRenamed({"d": "d2", "th": "th2"})
    texts = _packed(docs)
    rows = texts.join(marked, _same(texts, marked), "left").select("d", "z", "starts")
    return rows.mapInArrow(_clean_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>, kept binary")


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
