"""Quality rules from tokeniser fertility: how a public vocabulary cuts a text tells whether it is prose.

For each whole text a public byte-level vocabulary gives characters per token, the share of byte fallback (tokens
that are a lone byte of a longer character) and the entropy of token ids.  Each has a rejection band for the text's
script (the script of most of its letters); the entropy band is relative to the most that a text of that many tokens
can have.  Base rules (few words, repeated windows of words) come first.

Defined results: null and empty texts have all counts 0 and fail the base rules; ties between scripts go to the first
of ``SCRIPTS``; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, mix, prefix_hash, range_hash, slabs, text_buffer, word_spans

WINDOW = 8
SCRIPTS = ("latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "other")
#: For each script: least and most characters a token, most byte fallback, least share of the possible entropy.
BANDS = {
    "latin": (2.05, 7.0, 0.12, 0.45),
    "greek": (1.0, 6.0, 0.30, 0.40),
    "cyrillic": (1.2, 7.0, 0.20, 0.40),
    "semitic": (0.8, 6.0, 0.35, 0.40),
    "indic": (0.4, 5.0, 0.80, 0.35),
    "east_asian": (0.4, 4.0, 0.80, 0.35),
    "other": (0.3, 7.0, 0.90, 0.35),
}

_SCRIPT = np.full(256, -1, np.int8)
_SCRIPT[65:91] = _SCRIPT[97:123] = 0
_SCRIPT[0xC3:0xCA] = 0
_SCRIPT[0xCD:0xD0] = 1
_SCRIPT[0xD0:0xD4] = 2
_SCRIPT[0xD6:0xDC] = 3
_SCRIPT[0xE0] = 4
_SCRIPT[0xE3:0xEE] = 5
_SCRIPT[0xE1:0xE3] = 6
_SCRIPT[0xEE:] = 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of some whole texts, all at once."""
    docs = len(offsets) - 1
    start, end = word_spans(data, offsets[:-1])
    doc = np.searchsorted(offsets, start, "right") - 1
    n_words = np.bincount(doc, minlength=docs)

    def totals(marked: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marked)])[offsets])

    chars = totals(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = totals(_SYMBOL[data])
    prefix = prefix_hash(data)
    salt = mix(np.arange(docs, dtype=np.uint64) + np.uint64(7))

    word = range_hash(prefix, start, end)
    repeated = np.zeros(len(word) + 1, np.int64)
    if len(word) >= WINDOW:
        m = len(word) - WINDOW + 1
        window = np.zeros(m, np.uint64)
        for i in range(WINDOW):
            window = window * np.uint64(0x2545F4914F6CDD1D) + word[i : i + m]
        whole = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        twice = whole[_repeated(mix(window[whole]) ^ salt[doc[whole]], first=True)]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    covered = np.cumsum(repeated)[:-1] > 0
    n_repeat = np.bincount(doc, covered, docs).astype(np.int64)

    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_start.sort()
    owner = np.concatenate([np.arange(docs), np.searchsorted(offsets, breaks, "right") - 1])
    owner.sort()
    line_end = np.minimum(np.concatenate([line_start[1:], [len(data)]]), offsets[owner + 1])
    at_break = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else np.zeros(len(line_end), bool)
    line_end = np.where(at_break, line_end - 1, line_end)
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, owner = line_start[with_word], line_end[with_word], owner[with_word]
    again = _repeated(range_hash(prefix, line_start, line_end) ^ salt[owner], first=False) if len(owner) else np.zeros(0, np.int64)
    n_lines = np.bincount(owner[again], minlength=docs)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": n_lines, "n_repeat_words": n_repeat}


def _repeated(keys: np.ndarray, first: bool) -> np.ndarray:
    """Places whose key also stands elsewhere; without ``first``, all but the first of each."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    marked = np.zeros(len(keys), bool)
    marked[1:] = same
    if first:
        marked[:-1] |= same
    return np.sort(order[marked])


class Vocabulary:
    """A public vocabulary file of ranks, read once for each worker."""

    _known: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.place = path if "/" in path else public_tokenizers.path(path)
        with open(self.place, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.zeros(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            self.fallback[rank] = len(token) == 1 and token[0] >= 0x80

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def measure(self, text: str, part: int = 1 << 18) -> tuple[int, float, float]:
        """Tokens, share of byte fallback, entropy in bits; long texts are cut after white space."""
        ids, at = [], 0
        while at < len(text):
            end = at + part
            while end < len(text) and not text[end].isspace():
                end += 1
            ids.append(np.array(self.encoding.encode_ordinary(text[at:end]), np.int32))
            at = end
        if not ids:
            return 0, 0.0, 0.0
        every = ids[0] if len(ids) == 1 else np.concatenate(ids)
        every.sort()
        edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))
        n = np.diff(edge)
        share = n / len(every)
        return len(every), float(self.fallback[every].mean()), float(-(share * np.log2(share)).sum())


def _judge(vocabularies: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.array([BANDS[s] for s in SCRIPTS])
        for batch in batches:
            texts = batch.column(1)
            data, offsets = text_buffer(texts)
            parts = [base_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slabs(offsets)]
            out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
            if not parts:
                continue
            words = out["n_words"]
            failed = (words < 20) | (100 * out["n_repeat_words"] > 30 * words)
            script = np.zeros((len(SCRIPTS), len(texts)), np.int64)
            for i, j in slabs(offsets):
                kind = _SCRIPT[data[offsets[i] : offsets[j]]]
                for s in range(len(SCRIPTS)):
                    script[s, i:j] = np.diff(np.concatenate([[0], np.cumsum(kind == s)])[offsets[i : j + 1] - offsets[i]])
            low, high, most, least = band[script.argmax(axis=0)].T
            kept, figures = ~failed, None
            length = np.array([len(t.as_py() or "") for t in texts])
            for name in vocabularies:
                vocabulary = Vocabulary.of(name)
                n, fallback, entropy = np.array([vocabulary.measure(t.as_py() or "") for t in texts]).T
                per_token = length / np.maximum(n, 1)
                share = entropy / np.log2(np.clip(n, 2, 4096))
                kept &= (per_token >= low) & (per_token <= high) & (fallback <= most) & (share >= least)
                figures = figures or (per_token, fallback, entropy)
            columns = [batch.column(0), *[pa.array(out[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], pa.array(failed), pa.array(kept), *map(pa.array, figures)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "entropy"])

    return run


def judge(docs: DataFrame, vocabularies: tuple[str, ...] = ("byte_bpe_multi_50k.tiktoken",)) -> DataFrame:
    """Counts and verdict for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_judge(vocabularies), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, fallback_share double, entropy double")


def op4_fertility(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
