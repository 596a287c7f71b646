"""Structured filters on messages, and looking messages up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, contains_like, equals_nocase, like_pattern, plain_lower, trimmed, truncated
from ..query import Query
from .lexical import local


def predicate(query: Query) -> Column | None:
    """The conjunction of a query's filters; None if it has none."""
    out = []
    if query.sender is not None:
        # a null name is neither a match nor a mismatch: the address alone decides
        out.append(contains_like(F.col("sender_address"), query.sender) | contains_like(F.col("sender_name"), query.sender))
    if query.to is not None:
        out.append(contains_like(F.col("recipients"), query.to))
    if query.after is not None:
        out.append(F.col("received_unix") >= int(query.after.timestamp()))
    if query.before is not None:
        out.append(F.col("received_unix") < int(query.before.timestamp()))
    if query.has_attachments:
        out.append(F.col("has_attachments"))
    if query.folder is not None:
        out.append(equals_nocase(F.col("folder"), query.folder))
    if not out:
        return None
    found = out[0]
    for p in out[1:]:
        found = found & p
    return found


def allowed(messages: DataFrame, query: Query) -> DataFrame | None:
    """``row_id`` of the messages that pass; None (not an empty table) if the query has no filters."""
    p = predicate(query)
    return None if p is None else messages.where(p).select("row_id")


_ASKED = "qid string, sender string, recipient string, after long, before long, attached boolean, place string"


def _matching(messages: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``messages`` with ``qid`` for each query whose filters a message passes.

    The queries are a table of a few words each, which the driver holds; one scan of the messages meets all of them.
    """
    rows = [
        (qid, None if q.sender is None else like_pattern(q.sender), None if q.to is None else like_pattern(q.to), q.after and int(q.after.timestamp()),
         q.before and int(q.before.timestamp()), q.has_attachments, None if q.folder is None else plain_lower(q.folder))
        for qid, q in queries.items() if q.has_filters
    ]
    asked = local(messages.sparkSession, rows, _ASKED)
    low = messages.withColumns({f"low_{c}": ascii_lower(F.col(c)) for c in ("sender_address", "sender_name", "recipients", "folder")})

    def passes(given: str, test: str) -> Column:
        return F.col(given).isNull() | F.expr(test)

    on = (
        passes("sender", "low_sender_address like sender or low_sender_name like sender") & passes("recipient", "low_recipients like recipient") & passes("after", "received_unix >= after")
        & passes("before", "received_unix < before") & passes("attached", "not attached or has_attachments") & passes("place", "low_folder = place")
    )
    return low.join(F.broadcast(asked), on).select("qid", *messages.columns)


def allowed_many(messages: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``qid, row_id`` of the messages that pass, for the queries that have filters."""
    columns = ("row_id", "sender_address", "sender_name", "recipients", "received_unix", "has_attachments", "folder")
    return _matching(messages.select(*columns), queries).select("qid", "row_id")


def newest_many(messages: DataFrame, queries: dict[str, Query], top: int) -> DataFrame:
    """``qid, rank, row_id, snippet``: the answers to queries of filters alone, newest first; none to one without filters."""
    order = Window.partitionBy("qid").orderBy(F.desc("received_unix"), "row_id")
    best = _matching(messages, queries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("qid", "rank", "row_id", truncated(F.coalesce("body", F.lit("")), 160).alias("snippet"))


def newest(messages: DataFrame, query: Query, top: int) -> DataFrame:
    """The answer to a query of filters alone: ``row_id, received_unix, snippet``, newest first."""
    p = predicate(query)
    rows = messages.where(F.lit(False) if p is None else p)
    return rows.select("row_id", "received_unix", truncated(F.coalesce("body", F.lit("")), 160).alias("snippet")).orderBy(F.desc("received_unix"), "row_id").limit(top)


def resolve(messages: DataFrame, references: DataFrame) -> DataFrame:
    """``ref, row_id`` for references that are ``rowid:N``, an id, or an Internet message id with or without brackets.

    Three equi-joins rather than one join with OR; of several matches the smallest row_id is taken.
    """
    refs = references.select("ref", trimmed(F.col("ref")).alias("key")).distinct()
    number = F.expr("try_cast(substring(key, 7) as bigint)")
    by_number = refs.where(F.lower("key").startswith("rowid:")).select("ref", number.alias("row_id")).join(messages.select("row_id"), "row_id").select("ref", "row_id")
    named = refs.where(~F.lower("key").startswith("rowid:"))
    by_id = named.join(messages.select("row_id", F.col("id").alias("key")), "key").select("ref", "row_id")
    by_mail = named.select("ref", F.explode(F.array("key", F.concat(F.lit("<"), F.col("key"), F.lit(">")))).alias("key")).join(messages.select("row_id", F.col("internet_message_id").alias("key")), "key").select("ref", "row_id")
    return by_number.unionAll(by_id).unionAll(by_mail).groupBy("ref").agg(F.min("row_id").alias("row_id"))


def lookup(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages of some row ids, each once."""
    return messages.join(ids.select("row_id").distinct(), "row_id", "left_semi")


def stats(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: numbers of messages, of chunks, of embedded and of pending chunks, and of messages without a raw body."""
    m = messages.agg(F.count("*").alias("messages"), F.count_if(F.col("body_raw").isNull()).alias("without_raw"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    both = m.select(F.lit(1).alias("k"), "*").join(c.select(F.lit(1).alias("k"), "*"), "k")
    return both.select("messages", "chunks", "embedded", (F.col("chunks") - F.col("embedded")).alias("pending"), "without_raw")
