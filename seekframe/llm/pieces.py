"""SentencePiece (merge type) encoding by prefix tables, and decoding.

Every prefix of a text has one encoding, so one last token.  The table of last tokens is filled from left to right: an
automaton over the vocabulary gives the tokens that end at a place, and of these the one is taken that is compatible
with the last token of the prefix before it.  Two tokens are compatible if no merge across their border would come
before the merges that made them; that is told by undoing their merges, latest first.  The ids are then recovered from
the end backwards.  Nothing is merged step by step, and time is linear in the text.

Texts are cut into units first, where no piece can reach across: before a run of blanks and around newlines.  Many
units are tabled at once, column by column, with numpy.  A unit longer than ``WIDE`` characters is tabled in windows, all
at once too: a window starts ``LEAD`` characters early, as if a text started there, and is right from the place where it
and the window before it have had the same last tokens for as many places as the longest token is long, for a last token
depends on these only.  A window that never comes to agree is tabled again after the one before it.

A slab's units are looked up once for each distinct one, among those tabled before; ids and text are put together by
Arrow.  A text is held in parts of about ``SLAB`` bytes, cut between units.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows;
a null doc_id is carried; bytes that are not UTF-8 stand for U+FFFD; a long text without blanks or newlines is one unit
and is held whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Arena, binary, mix

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
WIDE = 48
LEAD = 48
CACHE = 300_000
SLAB = 1 << 21


def merge_pieces(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain merging of a short string, best score and then leftmost first; also the last pair merged."""
    parts, last = list(text), None
    while True:
        best = None
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best[0]):
                best = (s, i)
        if best is None:
            return parts, last
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Tables:
    """What encoding needs of a model: automaton, pairs that merge, and how each token was made."""

    _known: dict[str, Tables] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path if "/" in path else public_tokenizers.path(path))
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.byte_id = {int(self.names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.ids = {self.names[i]: i for i in range(size) if i not in special}
        # runs of blanks merge after everything else, so they are left out here and made in run()
        blanks = {p for p in self.ids if len(p) > 1 and not p.strip(BLANK)}
        self.longest_run = max(map(len, blanks), default=1)
        if any(BLANK in p[1:] for p in self.ids if p not in blanks) or any("\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("pieces of this model reach across units")
        blank_score = {p: sp.get_score(self.ids[p]) for p in blanks}
        self.short_runs = [[self.ids[x] for x in merge_pieces(BLANK * n, blank_score)[0]] for n in range(self.longest_run + 1)]
        score = {p: sp.get_score(i) for p, i in self.ids.items() if len(p) > 1 and p not in blanks}
        order = {p: n for n, p in enumerate(sorted(score, key=lambda p: -score[p]))}
        self.rank = np.full(size + 1, -1, np.int64)
        left, right = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
        self.length = np.ones(size + 1, np.int64)
        tokens = {p: i for p, i in self.ids.items() if len(p) == 1}
        for p in order:
            parts, pair = merge_pieces(p, score)
            if len(parts) == 1:
                i = self.ids[p]
                tokens[p] = i
                self.rank[i], self.length[i] = order[p], len(p)
                left[i], right[i] = self.ids[pair[0]], self.ids[pair[1]]
        self.left, self.right, self.other = left, right, size
        pairs = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], n) for p, n in order.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_key = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_rank = np.array([n for _, n in pairs] or [0], np.int64)
        states, edges = {"": 0}, {}
        token_of = [-1]
        for p in sorted(tokens, key=len):
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    token_of.append(-1)
                    edges[(states[p[: k - 1]] << 21) | ord(p[k - 1])] = states[p[:k]]
            token_of[states[p]] = tokens[p]
        # open addressing: an edge stands in its slot or in the next free one
        self.edge_bits = max(12, (4 * len(edges)).bit_length())
        self.edge_key = np.full((1 << self.edge_bits) + len(edges), -1, np.int64)
        self.edge_to = np.full(len(self.edge_key), -1, np.int64)
        keys = np.array(list(edges), np.int64)
        for k, slot in zip(keys.tolist(), self._slot(keys).tolist()):
            while self.edge_key[slot] >= 0:
                slot += 1
            self.edge_key[slot], self.edge_to[slot] = k, edges[k]
        self.token_of = np.array(token_of, np.int64)
        self.longest = max(map(len, tokens))
        self.size = size
        self.memo_key = np.full(1 << 20, -1, np.int64)
        self.memo_ok = np.zeros(1 << 20, bool)
        self.arena = Arena(self.coded, 3, CACHE)
        real = [b"" if i in special else p.replace(BLANK, " ").encode() for i, p in enumerate(self.names)]
        real = [bytes([self.byte_of[i]]) if i in self.byte_of else p for i, p in enumerate(real)]
        self.pieces = pa.array(real, pa.binary())
        self.decimals = pa.array([b"%d," % i for i in range(size)], pa.binary())

    @classmethod
    def of(cls, path: str) -> Tables:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.edge_bits)).astype(np.int64)

    def _follow(self, key: np.ndarray) -> np.ndarray:
        """Where edges lead; -1 where there is none."""
        slot = self._slot(key)
        there = self.edge_key[slot]
        out = np.where(there == key, self.edge_to[slot], -1)
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            slot[rest] += 1
            there = self.edge_key[slot[rest]]
            hit = there == key[rest]
            out[rest[hit]] = self.edge_to[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out

    def _cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of two tokens, or a large number."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], 1 << 40)

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Compatibility by undoing merges, latest first; of equal ranks the left one was first."""
        ok = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), 1 << 39)
        while len(at):
            bad = self._cross(a, b) < limit
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b stand side by side in an encoding; ``other`` marks the start or an unknown character."""
        free = a == self.other
        out = free.copy()
        rest = np.flatnonzero(~free)
        key = a[rest] * self.size + b[rest]
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        known = self.memo_key[slot] == key
        out[rest[known]] = self.memo_ok[slot[known]]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            ok = self._undo(new // self.size, new % self.size)
            at = (mix(new.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            self.memo_key[at], self.memo_ok[at] = new, ok
            # a slot that two new keys share holds the last one written for both arrays
            out[rest[~known]] = ok[back]
        return out

    def last_tokens(self, chars: np.ndarray, lengths: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The table, by place and row: the last token of each prefix of the rows of ``chars``; of the first ones, what is ``known``."""
        n, width = chars.shape
        reach = min(self.longest, width)
        ends = np.full((reach + 1, width + 1, n), -1, np.int32)
        row, start = np.nonzero(np.arange(width)[None, :] < lengths[:, None])
        state = np.zeros(len(row), np.int64)
        for step in range(reach):
            inside = start + step < lengths[row]
            row, start, state = row[inside], start[inside], state[inside]
            to = self._follow((state << 21) | chars[row, start + step])
            on = to >= 0
            if step == 0:
                ends[1, start[~on] + 1, row[~on]] = self.other
            row, start, state = row[on], start[on], to[on]
            token = self.token_of[state]
            has = token >= 0
            ends[step + 1, start[has] + step + 1, row[has]] = token[has]
        last = np.full((width + 1, n), -1, np.int64)
        last[0] = self.other
        if known is not None:
            last[: len(known)] = known
        for i in range(1 if known is None else len(known), width + 1):
            for size in range(min(i, reach), 0, -1):
                here = ends[size, i]
                rows = np.flatnonzero((here >= 0) & (last[i] < 0))
                if not len(rows):
                    continue
                previous = last[i - size, rows]
                token = here[rows].astype(np.int64)
                fits = previous >= 0
                fits[fits] = (token[fits] == self.other) | self.compatible(previous[fits], np.minimum(token[fits], self.size - 1))
                last[i, rows[fits]] = token[fits]
        return last

    def table(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of rows of characters, one after the other, and how many each row has."""
        n = len(lengths)
        last = self.last_tokens(chars, lengths)
        row, place = np.arange(n), lengths.copy()
        columns, counts = [], np.zeros(n, np.int64)
        while len(row):
            token = last[place, row]
            if (token < 0).any():
                raise ValueError("no encoding")
            lone = token == self.other
            if lone.any():
                # an unknown character is marked by its code point below zero
                token = token.copy()
                token[lone] = -1 - chars[row[lone], place[lone] - 1]
            counts[row] += 1
            columns.append((row, token))
            place = place - np.where(lone, 1, self.length[np.maximum(token, 0)])
            go = place > 0
            row, place = row[go], place[go]
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for step, (row, token) in enumerate(columns):
            out[first[row] + counts[row] - 1 - step] = token
        return out, counts

    def table_long(self, unit: np.ndarray, size: int = 64, many: int = 2048) -> np.ndarray:
        """Token ids of one long unit, by windows."""
        n = len(unit)
        last = np.full(n + 1, -1, np.int64)
        last[0] = self.other
        most = self.longest
        for at in range(0, n, size * many):
            starts = np.arange(at, min(n, at + size * many), size)
            early = np.maximum(starts - LEAD, 0)
            stops = np.minimum(starts + size, n)
            wide = int((stops - early).max())
            own = early[:, None] + np.arange(wide)[None, :]
            table = self.last_tokens(unit[np.minimum(own, n - 1)], stops - early)
            for w, (a, s, e) in enumerate(zip(early.tolist(), starts.tolist(), stops.tolist())):
                mine = table[:, w]
                # right if it agrees at these places with the table so far
                if a > 0 and not (mine[s - a - most + 1 : s - a + 1] == last[s - most + 1 : s + 1]).all():
                    a = s - most
                    mine = self.last_tokens(unit[None, a:e], np.array([e - a]), last[a : s + 1, None])[:, 0]
                last[s + 1 : e + 1] = mine[s - a + 1 : e - a + 1]
        out = []
        length = self.length.tolist()
        tokens = last.tolist()
        while n > 0:
            t = tokens[n]
            if t == self.other:
                out.append(-1 - int(unit[n - 1]))
                n -= 1
            else:
                out.append(t)
                n -= length[t]
        return np.array(out[::-1], np.int64)

    def _in_bytes(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Real ids: unknown characters as bytes."""
        odd = np.flatnonzero(tokens < 0)
        if not len(odd):
            return tokens, counts
        points, which = np.unique(-1 - tokens[odd], return_inverse=True)
        coded = [[self.byte_id[b] for b in chr(c).encode("utf-8", "replace")] for c in points.tolist()]
        size = np.ones(len(tokens), np.int64)
        size[odd] = np.array([len(c) for c in coded])[which]
        out = np.repeat(tokens, size)
        at = (np.cumsum(size) - size)[odd]
        for k in range(4):
            has = np.array([len(c) > k for c in coded])[which]
            out[at[has] + k] = np.array([c[k] if len(c) > k else 0 for c in coded])[which[has]]
        row = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(row, weights=size, minlength=len(counts)).astype(np.int64)

    def run(self, blanks: int) -> list[int]:
        """A run of blanks: the longest piece again and again, then the rest."""
        full, rest = divmod(blanks, self.longest_run)
        return self.short_runs[-1] * full + self.short_runs[rest]

    def coded(self, units: pa.Array) -> list[pa.Array]:
        """For units (UTF-8, blanks as spaces): ids as 4 bytes each, ids as decimals that end in commas, and text."""
        listed = units.to_pylist()
        cores = [u.lstrip(b" ") for u in listed]
        blanks = np.array([len(u) - len(c) for u, c in zip(listed, cores)], np.int64)
        cores = [b" " + c if k else c for k, c in zip(blanks.tolist(), cores)]
        flat = np.frombuffer(b"".join(cores).decode().replace(" ", BLANK).encode("utf-32-le"), np.uint32).astype(np.int64)
        edge = np.cumsum([0, *map(len, cores)])
        lead = np.concatenate([[0], np.cumsum((np.frombuffer(b"".join(cores), np.uint8) & 0xC0) != 0x80)])
        sizes = np.diff(lead[edge])
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        tokens, counts = [], []
        lo = 0
        while lo < len(order) and sizes[order[lo]] <= WIDE:
            part = order[lo : lo + 8192]
            part = part[sizes[part] <= WIDE]
            width = int(sizes[part[-1]])
            inside = np.arange(width)[None, :] < sizes[part][:, None]
            chars = np.zeros((len(part), width), np.int64)
            chars[inside] = flat[(starts[part][:, None] + np.arange(width)[None, :])[inside]]
            found = self.table(chars, sizes[part])
            tokens.append(found[0])
            counts.append(found[1])
            lo += len(part)
        for i in order[lo:].tolist():
            tokens.append(self.table_long(flat[starts[i] : starts[i] + sizes[i]]))
            counts.append(np.array([len(tokens[-1])]))
        ids, counts = self._in_bytes(np.concatenate(tokens), np.concatenate(counts))
        # further blanks before a unit, and the unit's own where it is a piece of its own, are a run
        first = np.cumsum(counts) - counts
        more = np.flatnonzero(blanks[order] > 1)
        if len(more):
            lone = np.array([self.names[i] == BLANK for i in ids[first[more]].tolist()])
            runs = [self.run(k - 1 + x) for k, x in zip(blanks[order[more]].tolist(), lone.tolist())]
            gone = first[more[lone]]
            put = np.repeat(first[more], [len(r) for r in runs])
            values = np.array([i for r in runs for i in r], np.int64)
            counts[more] += np.array([len(r) for r in runs]) - lone
            keep = np.ones(len(ids), bool)
            keep[gone] = False
            put -= np.cumsum(~keep)[put] - ~keep[put]
            ids = np.insert(ids[keep], put, values)
        edge = np.concatenate([[0], np.cumsum(counts)])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        out = [binary(ids.astype("<i4").view(np.uint8), edge * 4)]
        for names in (self.decimals, self.pieces):
            _, ends, data = names.take(pa.array(ids)).buffers()
            out.append(binary(data if data is not None else b"", np.frombuffer(ends, np.int32)[edge]))
        return [x.take(pa.array(back)) for x in out]


def _starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where units start: at the first of some blanks, at newlines and after them, and at the edges of texts."""
    blank, line = data == 0x20, data == 0x0A
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first |= line
    first[1:] |= line[:-1]
    first[edges[edges < len(data)]] = True
    return np.flatnonzero(first)


def _parts(text: bytes) -> Iterator[bytes]:
    """A text with its first blank, in parts of about ``SLAB`` bytes that end between units."""
    text = b" " + text
    at = 0
    while len(text) - at > SLAB:
        end = at + SLAB
        while end < len(text) and not (text[end] == 0x0A or text[end] == 0x20 != text[end - 1]):
            spaces, lines = text.find(b" ", end + 1), text.find(b"\n", end + 1)
            end = min((x for x in (spaces, lines) if x >= 0), default=len(text))
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _clean(text: bytes) -> bytes:
    try:
        text.decode()
    except UnicodeDecodeError:
        text = text.decode("utf-8", "replace").encode()
    return text.replace(BLANK.encode(), b" ")


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], bool]]:
    """Ids and texts (each with its first blank) of about ``SLAB`` bytes; a longer text is alone, in parts, and True after its last."""
    for batch in batches:
        at, held, size = 0, [], 0
        for i, t in enumerate(batch.column(1)):
            text = _clean(t.as_buffer().to_pybytes()) if t.is_valid else b""
            if held and size + len(text) > SLAB:
                yield batch.column(0).slice(at, len(held)), held, True
                at, held, size = i, [], 0
            if len(text) > SLAB:
                parts = _parts(text)
                now = next(parts)
                for following in parts:
                    yield batch.column(0).slice(i, 1), [now], False
                    now = following
                yield batch.column(0).slice(i, 1), [now], True
                at = i + 1
                continue
            held.append(b" " + text if text else b"")
            size += len(text)
        if held:
            yield batch.column(0).slice(at, len(held)), held, True


def _coded(texts: list[bytes], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The places of all units in the arena, and the edges of texts among them."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts = _starts(data, edges)
    slots = tables.arena.slots(binary(data, np.append(starts, len(data)))) if len(starts) else starts
    return slots, np.searchsorted(starts, edges)


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables.of(model)
        ids, decoded = [], []
        for doc_ids, texts, over in _slabs(batches):
            slots, edges = _coded(texts, tables)
            raw, at = tables.arena.take(0, slots)
            text, to = tables.arena.take(2, slots)
            if not over or ids:
                ids.append(np.frombuffer(raw, "<i4")[: at[-1] // 4])
                decoded.append(bytes(text[: to[-1]]))
                if over:
                    every = np.concatenate(ids)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), pa.array(every))
                    yield pa.RecordBatch.from_arrays([doc_ids, lists, pa.array([b"".join(decoded)[1:].decode()], pa.string())], names=["doc_id", "ids", "decoded"])
                    ids, decoded = [], []
                continue
            lists = pa.ListArray.from_arrays(pa.array(at[edges] // 4, pa.int32()), pa.array(np.frombuffer(raw, "<i4")[: at[-1] // 4]))
            shown = [bytes(text[a + 1 : b]).decode() for a, b in zip(to[edges[:-1]].tolist(), to[edges[1:]].tolist())]
            yield pa.RecordBatch.from_arrays([doc_ids, lists, pa.array(shown, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _digest(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables.of(model)
        part = None
        for doc_ids, texts, over in _slabs(batches):
            slots, edges = _coded(texts, tables)
            sizes = tables.arena.take(0, slots)[1] // 4
            decimals, at = tables.arena.take(1, slots)
            text, to = tables.arena.take(2, slots)
            if not over or part:
                if part is None:
                    part = [0, hashlib.sha256(), hashlib.sha256()]
                    text = text[1:]
                    to = to - 1
                part[0] += int(sizes[-1])
                part[1].update(decimals[: at[-1] - over])
                part[2].update(text[: to[-1]])
                if over:
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array([part[0]], pa.int64()), pa.array([part[1].hexdigest()]), pa.array([part[2].hexdigest()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    part = None
                continue
            a, b, c, d = (x.tolist() for x in (at[edges[:-1]], at[edges[1:]], to[edges[:-1]], to[edges[1:]]))
            of_ids = [hashlib.sha256(decimals[i : max(i, j - 1)]).hexdigest() for i, j in zip(a, b)]
            of_text = [hashlib.sha256(text[i + 1 : j] if j > i else b"").hexdigest() for i, j in zip(c, d)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(sizes[edges]), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded`` for each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(model), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the same encoding, of which only digests leave the worker."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digest(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
