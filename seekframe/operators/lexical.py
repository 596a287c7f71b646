"""Full-text retrieval: a positional index as tables, and BM25 over phrases for many queries at once."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.snippet import tokenize
from ..functions.text import tokens

#: Columns of the index and their weights.
WEIGHTS = {"subject": 3.0, "body": 1.0, "sender": 2.0, "recipients": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def searchable(messages: DataFrame) -> DataFrame:
    """``row_id`` and the texts of the index's columns."""
    sender = F.concat_ws(" ", "sender_name", "sender_address")
    return messages.select("row_id", F.col("subject"), F.col("body"), sender.alias("sender"), F.col("recipients"))


def spread(df: DataFrame) -> DataFrame:
    """Dealt out over all cores, where the input is so few files that most of them would idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def _token_columns(texts: DataFrame) -> DataFrame:
    return texts.select("row_id", *[tokens(F.col(c)).alias(c) for c in WEIGHTS])


def _n_tokens():
    return sum((F.size(c) for c in WEIGHTS), F.lit(0)).cast("long").alias("n_tokens")


def postings(texts: DataFrame) -> DataFrame:
    """``row_id, col, term, pos``: the whole index, to be kept."""
    columns = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("toks")) for c in WEIGHTS])
    rows = _token_columns(texts).select("row_id", F.explode(columns).alias("x"))
    return rows.select("row_id", "x.col", F.posexplode("x.toks").alias("pos", "term"))


#: The columns in the order in which a stored index lists a text's places; a place is four times a position and its column's number.
PLACED = tuple(sorted(WEIGHTS))
#: Tokens that are grouped at once.
SLAB = 1 << 19


def _slabs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with ``SLAB`` tokens or so, or one text."""
    sizes = sum(batch.column(c).value_lengths().to_numpy().astype(np.int64) for c in PLACED)
    whole = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(whole, whole[at] + SLAB, "right")) - 1, at + 1)
        yield batch.slice(at, end - at)
        at = end


def _range(term: str, row_ids: np.ndarray, bounds: list[tuple[str, int]], terms: list[str]) -> np.ndarray | int:
    """The ranges of one term's rows; only a term that bounds stand in has more than one."""
    lo, hi = bisect_left(terms, term), bisect_right(terms, term)
    return lo if lo == hi else lo + np.searchsorted([r for _, r in bounds[lo:hi]], row_ids, "right")


def _grouped(bounds: list[tuple[str, int]]):
    """Index rows of texts' tokens; a text is in one batch, so nothing has to be brought together."""
    terms = [t for t, _ in bounds]
    weights = np.array([WEIGHTS[c] for c in PLACED])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        row_id = batch.column("row_id").to_numpy()
        lists = [batch.column(c) for c in PLACED]
        sizes = [x.value_lengths().to_numpy() for x in lists]
        coded = pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists]).dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
        pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes]).astype(np.int64)
        col = np.repeat(np.arange(len(PLACED)), [n.sum() for n in sizes])
        key = code * batch.num_rows + row
        # stable: places stay in the order of columns and positions
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        own, term = row[order][first], code[order][first]
        f = np.add.reduceat(weights[col[order]], first) if len(first) else np.zeros(0)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array((pos * 4 + col)[order].astype(np.int32)))
        part = np.zeros(len(first), np.int32)
        if bounds:
            at = np.searchsorted(term, np.arange(len(words) + 1))
            for n, word in enumerate(words.to_pylist()):
                part[at[n] : at[n + 1]] = _range(word, row_id[own[at[n] : at[n + 1]]], bounds, terms)
        n_tokens = sum(n.astype(np.int64) for n in sizes)
        return pa.RecordBatch.from_arrays([words.take(pa.array(term)), pa.array(row_id[own]), pa.array(n_tokens[own]), pa.array(f), places, pa.array(part)], names=["term", "row_id", "n_tokens", "f", "places", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(one, _slabs(batch))

    return run


_ROWS = "term string, row_id long, n_tokens long, f double, places array<int>"


def indexed(texts: DataFrame) -> DataFrame:
    """``term, row_id, n_tokens, f, places``: the index to be stored, one row for each term of a text.

    ``f`` is the weighted number of occurrences, all that a one-word part asks for; ``places`` are for phrases.
    """
    return _token_columns(texts).mapInArrow(_grouped([]), f"{_ROWS}, part int").drop("part")


#: Tokens of a range of the index, and texts from which the ranges' bounds are taken.
RANGE, BOUNDS = 2_000_000, 400


def ranged(texts: DataFrame, n_rows: int, n_tokens: int) -> DataFrame:
    """The same in ranges of term and row id, sorted: a frequent term has several.

    The bounds are those of some texts, so ranges are about as large as each other; every text is in the index.
    """
    n = max(1, -(-n_tokens // RANGE))
    bounds = []
    if n > 1:
        some = texts.where(F.pmod(F.xxhash64("row_id"), F.lit(max(1, n_rows // BOUNDS))) == 0)
        every = sorted(zip(*(c.to_pylist() for c in indexed(some).select("term", "row_id").toArrow().columns)))
        bounds = sorted({every[len(every) * i // n] for i in range(1, n)}) if every else []
    rows = _token_columns(texts).mapInArrow(_grouped(bounds), f"{_ROWS}, part int")
    return rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("term", "row_id").drop("part")


def lengths(texts: DataFrame) -> DataFrame:
    """``row_id, n_tokens`` over all columns of the index; no shuffle."""
    return _token_columns(texts).select("row_id", _n_tokens())


def scanned(texts: DataFrame, terms: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``row_id, n_tokens, col, term, pos`` for some terms only, and the lengths, without an index."""
    wanted = F.array(*map(F.lit, sorted(terms))).cast("array<string>")

    def places(c: str):
        every = F.transform(F.col(c), lambda t, i: F.struct(F.lit(c).alias("col"), i.alias("pos"), t.alias("term")))
        return F.filter(every, lambda x: F.array_contains(wanted, x["term"]))

    rows = _token_columns(spread(texts))
    # outer, or Catalyst would move a test of the whole expression down to the scan, before the rows are dealt out
    hits = rows.select("row_id", _n_tokens(), F.concat(*map(places, WEIGHTS)).alias("hits")).select("row_id", "n_tokens", F.inline_outer("hits"))
    return hits, rows.select("row_id", _n_tokens())


def terms_of(parts: dict[str, Sequence[str]]) -> set[str]:
    return {t for ps in parts.values() for p in ps for t in tokenize(p)}


def local(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A few rows of the driver's as a relation whose size the planner knows, so that it may broadcast or leave it out."""
    schema = spark.createDataFrame([], kind).schema
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def asked(spark: SparkSession, parts: dict[str, Sequence[str]]) -> DataFrame:
    """``qid, phrase, off, term, size, n_parts`` of queries' parts.  A part without tokens matches nothing."""
    rows = [(q, i, k, t, len(toks), len(ps)) for q, ps in parts.items() for i, p in enumerate(ps) for toks in [tokenize(p)] for k, t in enumerate(toks)]
    return local(spark, rows, "qid string, phrase int, off int, term string, size int, n_parts int")


def occurrences(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, phrase, row_id, f, n_parts``: weighted numbers of occurrences of each phrase in each row.

    A phrase of n tokens stands where n postings agree on its first position.  Queries hold a few words each, so their
    side is the small one; whether it is broadcast is left to its measured size.
    """
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    row = [c for c in ("row_id", "n_tokens") if c in index.columns]
    if "places" in index.columns:
        one = index.join(queries.where("size = 1"), "term").select("qid", "phrase", "n_parts", *row, "f")
        hits = index.join(queries.where("size > 1"), "term").select("qid", "phrase", "off", "size", "n_parts", *row, F.explode("places").alias("place"))
        hits = hits.withColumns({"col": F.array(*map(F.lit, PLACED))[F.col("place").bitwiseAND(3)], "pos": F.shiftright("place", 2)})
    else:
        one, hits = None, index.join(queries, "term")
    hits = hits.select("qid", "phrase", "size", "n_parts", *row, "col", (F.col("pos") - F.col("off")).alias("at"))
    whole = hits.groupBy("qid", "phrase", "size", "n_parts", *row, "col", "at").count().where("count = size")
    found = whole.groupBy("qid", "phrase", "n_parts", *row).agg(F.sum(weight[F.col("col")]).alias("f"))
    return found if one is None else one.unionByName(found)


def scored(index: DataFrame, sizes: DataFrame | tuple[int, float], queries: DataFrame) -> DataFrame:
    """``qid, row_id, score, n_matched, n_parts``: BM25, negative, smaller is better.

    ``index`` may bring ``n_tokens`` of its rows along; else they are joined from ``sizes``, which may be the numbers of rows
    and of their tokens where it does.
    """
    found = occurrences(index, queries)
    # a count of f, so that both readers of found are the same plan and share its exchange
    df = found.groupBy("qid", "phrase").agg(F.count("f").alias("df"))
    rows = found.join(df, ["qid", "phrase"])
    rows = rows if "n_tokens" in rows.columns else rows.join(sizes, "row_id")
    if isinstance(sizes, tuple):
        rows = rows.withColumn("n_rows", F.lit(sizes[0])).withColumn("mean_tokens", F.lit(float(sizes[1]) / max(sizes[0], 1)))
    else:
        total = sizes.agg(F.count("*").alias("n_rows"), F.avg("n_tokens").alias("mean_tokens")).select(F.lit(1).alias("one"), "*")
        rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    raw = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
    score = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens")))
    # parts are added in their order: a sum in the order of arrival differs between equal texts, and ranks them by chance
    most = queries.agg(F.max("n_parts")).first()[0] or 0
    parts = [F.sum(F.when(F.col("phrase") == i, score)).alias(f"s{i}") for i in range(most)]
    rows = rows.groupBy("qid", "row_id", "n_parts").agg(*parts, F.count("*").alias("n_matched"))
    total = sum((F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(most)), F.lit(0.0))
    return rows.select("qid", "row_id", "n_parts", total.alias("score"), "n_matched")


def _first(rows: DataFrame, limit: int, allowed: DataFrame | None, overfetch: bool) -> DataFrame:
    """The best ``limit`` rows of each query among those allowed (``qid, row_id``; None: all)."""
    order = Window.partitionBy("qid").orderBy("score", "row_id")
    if allowed is not None:
        if overfetch:
            # statistics and this first cut are of the whole corpus; what the filter lets pass comes after
            rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(20 * limit, 1000)).drop("r")
        rows = rows.join(allowed, ["qid", "row_id"], "left_semi")
    return rows.withColumn("keyword_rank", F.row_number().over(order)).where(F.col("keyword_rank") <= limit)


def top(rows: DataFrame, limit: int, mode: str = "fallback", allowed: DataFrame | None = None, overfetch: bool = True) -> DataFrame:
    """``qid, row_id, score, keyword_rank`` of rows in which all parts match (``and``), any (``or``), or all and, for
    queries of several parts that find nothing so, any (``fallback``)."""
    every = _first(rows.where("n_matched = n_parts"), limit, allowed, overfetch) if mode != "or" else None
    if mode == "and":
        out = every
    else:
        some = _first(rows if mode == "or" else rows.where("n_parts > 1"), limit, allowed, overfetch)
        out = some if mode == "or" else every.unionByName(some.join(every.select("qid").distinct(), "qid", "left_anti"))
    return out.select("qid", "row_id", "score", "keyword_rank")
