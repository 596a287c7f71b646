"""Token ids in binary files: canonical length-limited Huffman codes in independent blocks.

A file set has two tables in the shared folder.  ``codes`` holds the code length of each id, from global counts
(package-merge, at most ``LIMIT`` bits), which fixes the canonical code.  ``blocks`` holds rows of about ``BLOCK``
ids in ascending doc_id order: the bits, the documents with their numbers of ids, and bit-offset checkpoints: where
each document and each ``STRIDE``-th id of it starts.  A block is decoded alone, all its checkpoints at once, by a
table of ``2 ** LIMIT`` entries.  Spark writes the tables, so a lost task is simply run again.

Defined results: null and empty texts have only the end id; null doc_ids come first; rows of a repeated doc_id are
ordered by their ids; an empty input gives empty tables; other columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Arena, binary, cut, table_path

VOCABULARY = "word_bpe_49k.json"
END = 2
LIMIT = 16
STRIDE = 64
BLOCK = 1 << 19
CACHE = 400_000
SLAB = 1 << 21
SYMBOL = np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), np.uint8))
LETTER = np.isin(np.arange(256), np.frombuffer(string.ascii_letters.encode(), np.uint8))
#: So many symbols at the end of a stretch may be parted from it.
TAIL = 4

# The normalisation and splitting that the plain words' shorter way is right for.
STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Bytes as the letters of byte-level vocabularies: those without a visible character get the letters from 256 on.
LETTERS = dict(zip([b for b in range(256) if b < 33 or 127 <= b <= 160 or b == 173], range(256, 512)))
del LETTERS[32]  # blanks still part the words


# ---------------------------------------------------------------- encoding


class Encoder:
    """A tokenizer file; ids of the stretches between blanks and newlines are kept.

    Stretches are kept in lower case (which the tokenizer makes of them anyway) where the text has no combining marks,
    and ASCII symbols at a stretch's end, after an ASCII letter, are a stretch of their own: the tokenizer parts them there.
    Plain lower-case words that its normalisation leaves as they are go straight to its merges, if its steps are those of
    ``STEPS``. Ids are of 2 bytes each where the whole vocabulary fits, else of 4. A slab's stretches are looked up once for
    each distinct one, and its ids are put together by Arrow.
    """

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        path = path if "/" in path else public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folds = self.whole(b"QXZ") == self.whole(b"qxz")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        self.plain, self.splits = None, False
        if (steps["normalizer"], steps["pre_tokenizer"]) == STEPS:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.splits = True
        self.arena = Arena(self.coded, 1, CACHE)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32).tobytes()

    def coded(self, units: pa.Array) -> list[pa.Array]:
        """The ids of stretches, as bytes."""
        ascii_, latin, words, rest = [], [], [], []
        for n, u in enumerate(units.to_pylist()):
            if u.isalpha():
                ascii_.append((n, u.decode().lower()))
            else:
                text = u.decode("utf-8", "replace")
                (rest if not text.isalpha() else latin if max(text) < "\u0180" and text == text.lower() else words).append((n, text))
        if self.plain is None:
            words, ascii_, latin = words + ascii_ + latin, [], []
        data, sizes, order = [], [], []

        def keep(part: list[tuple[int, str]], ids: np.ndarray, edge: np.ndarray) -> None:
            data.append(ids)
            sizes.append(np.diff(edge))
            order.extend([n for n, _ in part])

        for coder, listed in ((self.plain, ascii_), (self.plain, latin), (self.tokenizer, words)):
            for i in range(0, len(listed), 4096):
                part = listed[i : i + 4096]
                text = " ".join([t for _, t in part])
                if listed is latin:
                    text = text.encode().decode("latin-1").translate(LETTERS)
                ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
                edge = np.flatnonzero(self.ends[ids]) + 1
                if len(edge) != len(part):
                    rest += part
                    continue
                keep(part, ids, np.concatenate([[0], edge]))
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            coded = self.tokenizer.encode([t for _, t in part], is_pretokenized=True, add_special_tokens=False)
            owner = np.array([-1 if w is None else w for w in coded.word_ids], np.int64)
            keep(part, np.array(coded.ids, self.kind), np.searchsorted(owner, np.arange(len(part) + 1)))
        edge = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) * self.kind.itemsize
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return [binary(np.concatenate(data).tobytes(), edge).take(pa.array(back))]

    def encode(self, texts: list[bytes]) -> tuple[memoryview, np.ndarray]:
        """Ids of the texts in ``kind``, one after the other, the end ids not yet among them; and the n + 1 offsets of their bytes."""
        # An added token's string is cut out of the text before anything else, so such a text is encoded whole.
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        whole = {i: np.frombuffer(self.whole(texts[i]), np.uint32).astype(self.kind).tobytes() for i in odd}
        folded = [b"" if i in whole else self._fold(t) for i, t in enumerate(texts)]
        data = np.frombuffer(b"".join(folded), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in folded])]).astype(np.int64)
        between = (data == 0x20) | (data == 0x0A)
        starts = ~between
        starts[1:] &= between[:-1]
        inner = edges[edges < len(data)]
        starts[inner] = ~between[inner]
        if self.splits:
            last = between.copy()
            last[:-1], last[-1:] = between[1:], True
            last[inner[inner > 0] - 1] = True
            at = np.flatnonzero(last & SYMBOL[data])
            for _ in range(TAIL):
                at = at[at > 0] - 1
                # a symbol after an ASCII letter of the same stretch starts one of its own; after another symbol the search goes on
                at = at[~starts[at + 1]]
                starts[at[LETTER[data[at]]] + 1] = True
                at = at[SYMBOL[data[at]]]
        begin = np.flatnonzero(starts)
        gaps = np.concatenate([[0], np.cumsum(between)])
        joined = data[~between]
        slots = self.arena.slots(binary(joined, np.append(begin - gaps[begin], len(joined)))) if len(begin) else begin
        ids, ends = self.arena.take(0, slots)
        ends = ends[np.searchsorted(begin, edges)].astype(np.int64)
        if not whole:
            return ids, ends
        own = [whole.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]
        return memoryview(b"".join(own)), np.concatenate([[0], np.cumsum([len(x) for x in own])])

    def _fold(self, text: bytes) -> bytes:
        return text.lower() if self.folds and b"\xcc" not in text and b"\xcd" not in text else text


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of about ``SLAB`` bytes together, and the number of the first."""
    at, held, size = 0, [], 0
    for i, t in enumerate(batch.column(1)):
        if held and size + (len(t.as_buffer()) if t.is_valid else 0) > SLAB:
            yield at, held
            at, held, size = i, [], 0
        held.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(held[-1])
    if held:
        yield at, held


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end, wide = np.array([END], encoder.kind).tobytes(), encoder.kind.itemsize
        gc.freeze()  # the cache has no cycles and needn't be walked again and again
        for batch in batches:
            for at, texts in _texts(batch):
                data, edge = encoder.encode(texts)
                ids = [bytes(data[a:b]) + end for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(np.diff(edge) // wide + 1), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids with the end id, little-endian, of 2 bytes each where the vocabulary fits, else of 4."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(vocabulary), "doc_id long, n_tokens long, ids binary")


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32)


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of at most ``limit`` bits by package-merge; ids that never occur have length 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # level by level from the deepest: merge packages of the level below with the single ids
    levels = []
    packed = np.zeros(0)
    for _ in range(limit):
        every = np.concatenate([weight, packed])
        rank = np.argsort(every, kind="stable")
        levels.append(rank)
        merged = every[rank]
        merged = merged[: len(merged) // 2 * 2]
        packed = merged[0::2] + merged[1::2]
    take = 2 * (len(order) - 1)
    depth = np.zeros(len(order), np.int64)
    for rank in reversed(levels):
        chosen = rank[:take]
        single = chosen < len(order)
        depth[chosen[single]] += 1
        take = 2 * int((~single).sum())
    out[order] = depth
    return out


@dataclass
class Code:
    lengths: np.ndarray
    limit: int = LIMIT

    def __post_init__(self):
        self.sizes = self.lengths.astype(np.int64)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        lengths = self.lengths[order].astype(np.int64)
        step = np.int64(1) << (self.limit - lengths)
        first = np.concatenate([[0], np.cumsum(step)])[:-1]
        self.words = np.zeros(len(self.lengths), np.uint64)
        self.words[order] = (first >> (self.limit - lengths)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, np.int32)
        self.size = np.ones(1 << self.limit, np.uint8)
        if len(order):
            filled = int(step.sum())
            self.symbol[:filled] = np.repeat(order, step)
            self.size[:filled] = np.repeat(lengths, step)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ids and the bit offset of each."""
        ids = ids.astype(np.intp)
        size = self.sizes[ids]
        at = np.cumsum(size) - size
        total = int(at[-1] + size[-1]) if len(at) else 0
        word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
        value = self.words[ids] << shift
        edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(at) else np.zeros(0, np.int64)
        out = np.zeros((total >> 5) + 2, np.uint64)
        if len(at):
            out[word[edge]] += np.add.reduceat(value >> np.uint64(32), edge)
            out[word[edge] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), edge)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], at

    def unpack(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of stretches that start at bit offsets, decoded side by side; one after the other in the result."""
        raw = np.frombuffer(data + b"\0\0\0\0", np.uint8)
        window = (raw[:-2].astype(np.uint32) << np.uint32(16)) | (raw[1:-1].astype(np.uint32) << np.uint32(8)) | raw[2:]
        out = np.zeros(int(counts.sum()), np.int32)
        order = np.argsort(-counts, kind="stable")
        place = (np.cumsum(counts) - counts)[order]
        at, left = starts[order].astype(np.int64), counts[order]
        live = len(order)
        for step in range(int(left[0]) if live else 0):
            while live and left[live - 1] <= step:
                live -= 1
            bit = at[:live]
            code = (window[bit >> 3] >> (24 - self.limit - (bit & 7)).astype(np.uint32)) & np.uint32((1 << self.limit) - 1) if self.limit <= 17 else None
            out[place[:live] + step] = self.symbol[code]
            at[:live] += self.size[code]
        return out


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        wide, narrow = [], []
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = _ids(data.as_buffer(), n)
            (narrow if ids.itemsize == 2 else wide).append(ids)
        for ids in filter(None, (wide, narrow)):
            own = np.bincount(np.concatenate(ids), minlength=len(total))
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


# ---------------------------------------------------------------- files


def _blocks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Code = shared.value
        part, number, before = TaskContext.get().partitionId(), 0, 0

        def block(docs, lengths, ids):
            nonlocal number, before
            every = np.concatenate(ids)
            bits, at = code.pack(every)
            lengths = np.array(lengths, np.int64)
            start = np.cumsum(lengths) - lengths
            per = (lengths + STRIDE - 1) // STRIDE
            inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            marks = at[np.repeat(start, per) + inner * STRIDE]
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([np.diff(marks, prepend=0).astype("<u4").tobytes()], pa.binary()), pa.array([bits], pa.binary())],
                names=["part", "block", "before", "doc_ids", "lengths", "marks", "bits"],
            )
            number, before = number + 1, before + int(lengths.sum())
            return out

        docs, lengths, ids, size = [], [], [], 0
        for batch in batches:
            for doc, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs.append(doc)
                lengths.append(n)
                ids.append(_ids(data.as_py(), n))
                size += n
                if size >= BLOCK:
                    yield block(docs, lengths, ids)
                    docs, lengths, ids, size = [], [], [], 0
        if docs:
            yield block(docs, lengths, ids)

    return run


_SCHEMA = "part int, block int, before long, doc_ids array<bigint>, lengths array<bigint>, marks binary, bits binary"


def write(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None) -> str:
    """Encode ``docs`` and write a file set; returns its path."""
    spark = docs.sparkSession
    path = path or table_path(spark, "tokens")
    coded = cut(encode(docs, vocabulary), "ids")
    found = coded.select("n_tokens", "ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    spark.createDataFrame([(LIMIT, bytearray(lengths.tobytes()))], "code_limit int, lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    rows = coded.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "n_tokens", "ids")
    rows.mapInArrow(_blocks(spark.sparkContext.broadcast(Code(lengths))), _SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Code = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lengths = batch.column(0)[row].values, batch.column(1)[row].values.to_numpy()
                marks = np.cumsum(np.frombuffer(batch.column(2)[row].as_buffer(), "<u4").astype(np.int64))
                per = (lengths + STRIDE - 1) // STRIDE
                inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                stretch = np.minimum(np.repeat(lengths, per) - inner * STRIDE, STRIDE)
                ids = code.unpack(batch.column(3)[row].as_py(), marks, stretch)
                begin = batch.column(4)[row].as_py() + np.cumsum(lengths) - lengths
                ends = (np.concatenate([[0], np.cumsum(lengths)]) * 4).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([docs, pa.array(begin), pa.array(lengths), data], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian uint32) of a file set; with ``digest``, ``ids_crc32`` for ids."""
    header = spark.read.parquet(f"{path}/codes").first()
    code = Code(np.frombuffer(header["lengths"], np.uint8), header["code_limit"])
    blocks = spark.read.schema(_SCHEMA).parquet(f"{path}/blocks")
    sizes = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    # one number for each written partition, whose count is bounded by the job's
    base, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        base[r["part"]] = total
        total += r["n"]
    bases = spark.createDataFrame(list(base.items()), "part int, base long")
    rows = blocks.join(F.broadcast(bases), "part").select("doc_ids", "lengths", "marks", "bits", (F.col("before") + F.col("base")).alias("before"))
    shared = spark.sparkContext.broadcast(code)
    if not digest:
        return rows.mapInArrow(_read(shared), "doc_id long, start long, n_tokens long, ids binary")

    def crc(batches):
        for batch in _read(shared)(batches):
            sums = [zlib.crc32(x.as_buffer()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_tokenfile(spark, sf_dir: str) -> DataFrame:
    path = write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read(spark, path, digest=True)
