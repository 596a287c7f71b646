"""Language identification with bit-sliced Bloom filters of byte n-grams.

Every slot of the filter holds one bit per language, in planes of 64.  An n-gram hashes to ``HASHES`` slots; the AND of their masks is
the set of languages that contain it, so a single lookup answers for all languages.  A language's score in a text is
the popcount of its bit over the text's n-grams, corrected for its false positive rate: ``(hits - n * f) / (1 - f)``.
The largest decides (ties: the first name); the score is that value's share of the text's n-grams.

Learning reads at most about ``SAMPLE`` texts of each language, chosen by a hash of doc_id, and keeps n-grams of at least
``SHARE`` of the language's occurrences, so a plane's size is fixed.  Every language that occurs has its bit; more than
``LANGUAGES`` are an error, for then the column holds no languages.

Defined results: null text or text without a letter is ``und`` with score 0, as is any text if nothing was learned;
a text without a full n-gram scores 0 and takes the first language name; null doc_id counts as not held out and is
never learned from; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slabs, text_buffer

N = 4
SAMPLE = 3000
LANGUAGES = 1024
SHARE = 1e-5
SLOTS_LOG2 = 20
HASHES = 3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray
    false_positive: np.ndarray


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams from each byte on, and which of them count (no two blanks in a row)."""
    folded = _FOLD[data].astype(np.uint32)
    if len(folded) < N:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    code = folded[: len(folded) - N + 1].copy()
    for i in range(1, N):
        code = (code << np.uint32(8)) | folded[i : len(folded) - N + 1 + i]
    blank = folded == 32
    pair = blank[:-1] & blank[1:]
    twice = np.zeros(len(code), bool)
    for i in range(N - 1):
        twice |= pair[i : i + len(code)]
    return code, ~twice


def _slots(code: np.ndarray) -> Iterator[np.ndarray]:
    mixed = mix(code.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    for i in range(HASHES):
        yield (mixed >> np.uint64(i * 21)) & np.uint64((1 << SLOTS_LOG2) - 1)


def _texts(column: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slabs: the range of texts, their bytes and offsets; a long text comes in overlapping parts."""
    data, offsets = text_buffer(column)
    for i, j in slabs(offsets, limit):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * limit:
            yield i, j, data[a:b], offsets[i : j + 1] - a
            continue
        for at in range(a, b, limit):
            part = data[at : min(b, at + limit + N - 1)]
            yield i, j, part, np.array([0, len(part)])


def _inside(starts: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Which n-gram starts have all their bytes in one text."""
    ok = np.ones(n, bool)
    for back in range(1, N):
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def _count(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = {name: i for i, name in enumerate(names)}
        for batch in batches:
            langs = np.array([where[x] for x in batch.column(0).to_pylist()], np.uint64)
            for i, _, data, offsets in _texts(batch.column(1)):
                code, ok = _grams(data)
                ok &= _inside(code, offsets, len(code))
                doc = np.searchsorted(offsets, np.arange(len(code)), "right") - 1
                keys, n = np.unique((langs[i + doc] << np.uint64(32) | code)[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang_no", "gram", "n"])

    return run


def held_out(divisor: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """Learn from rows with a non-null doc_id, text and lang whose doc_id isn't held out."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("doc_id").isNotNull() & ~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    names = sorted(r["lang"] for r in sizes)
    planes = -(-len(names) // 64)
    if not names:
        return Model([], np.zeros((0, 1 << SLOTS_LOG2), np.uint64), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE / r["count"]))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000).select("lang", "text")
    counts = chosen.mapInArrow(_count(names), "lang_no int, gram long, n long").groupBy("lang_no", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    total = {r["lang_no"]: r["n"] for r in counts.groupBy("lang_no").agg(F.sum("n").alias("n")).collect()}
    floor = F.create_map(*[F.lit(x) for lang_no, n in (total or {0: 0}).items() for x in (lang_no, n * SHARE)])[F.col("lang_no")]
    kept = counts.where(F.col("n") >= floor).select("lang_no", "gram").toPandas()
    masks = np.zeros((planes, 1 << SLOTS_LOG2), np.uint64)
    for lang_no, own in kept.groupby("lang_no"):
        for slot in _slots(own["gram"].to_numpy().astype(np.uint32)):
            np.bitwise_or.at(masks[lang_no // 64], slot, np.uint64(1) << np.uint64(lang_no % 64))
    fill = np.array([((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    return Model(names, masks, fill**HASHES)


def _has_letter(data: np.ndarray) -> bool:
    folded = data | 32
    if ((folded >= 97) & (folded <= 122)).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = batch.column(1)
            n = np.zeros(len(texts), np.int64)
            hits = np.zeros((len(model.languages), len(texts)), np.int64)
            letter = np.zeros(len(texts), bool)
            for i, j, data, offsets in _texts(texts):
                code, ok = _grams(data)
                ok &= _inside(code, offsets, len(code))
                code = code[ok]
                place = np.concatenate([[0], np.cumsum(ok)])
                at = place[np.minimum(offsets, len(ok))]
                n[i:j] += np.diff(at)
                slots_ = list(_slots(code))
                for plane, masks in enumerate(model.masks):
                    found = masks[slots_[0]]
                    for slot in slots_[1:]:
                        found = found & masks[slot]
                    for lang_no in range(64 * plane, min(64 * plane + 64, len(model.languages))):
                        sums = np.concatenate([[0], np.cumsum((found >> np.uint64(lang_no % 64)) & np.uint64(1))]).astype(np.int64)
                        hits[lang_no, i:j] += np.diff(sums[at])
                letter[i:j] |= [_has_letter(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            if model.languages:
                f = model.false_positive[:, None]
                fixed = np.clip((hits - n * f) / (1 - f), 0, None)
                best = fixed.argmax(axis=0)
                score = np.clip(fixed.max(axis=0) / np.maximum(n, 1), 0, 1)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                letter[:] = False
            names = np.array([*model.languages, "und"], dtype=object)[np.where(letter, best, len(model.languages))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; reads doc_id and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(4, 2).alias("held_out"))
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a language (not ``und``) and a score of ``least``, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string"), F.lit(False).alias("held_out"))
    row = rows.schema["row"].dataType.simpleString()
    told = rows.mapInArrow(_predict(shared), f"doc_id {row}, held_out boolean, lang_pred string, score double")
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("doc_id.*")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs))
