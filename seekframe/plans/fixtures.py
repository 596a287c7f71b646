"""The driver's tables seen as messages, chunks and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as messages, sent one an hour."""
    d = F.col("doc_id")
    received = F.expr("cast(timestamp'2024-01-01 00:00:00' as timestamp) + make_interval(0, 0, 0, 0, cast(doc_id as int))")
    rows = table(spark, sf_dir, "documents").select(
        d.alias("row_id"), F.concat(F.lit("doc-"), d).alias("id"), F.concat(F.lit("<doc-"), d, F.lit("@fixture>")).alias("internet_message_id"), F.lit(None).cast("string").alias("conversation_id"),
        F.when(d % 3 == 0, "inbox").when(d % 3 == 1, "archive").otherwise("sentitems").alias("folder"), F.substring("text", 1, 40).alias("subject"),
        F.when(d % 5 != 0, F.concat(F.lit("Sender "), "source")).alias("sender_name"), F.concat("source", F.lit("@"), "lang", F.lit(".example")).alias("sender_address"),
        F.concat(F.lit("user"), d % 7, F.lit("@example.se")).alias("recipients"), received.alias("received"), (d % 4 == 0).alias("has_attachments"),
        F.lit(None).cast("string").alias("web_link"), F.col("text").alias("body"), F.when(d % 6 != 0, F.col("text")).alias("body_raw"),
    )
    return rows.withColumn("received_unix", F.unix_timestamp("received"))


MESSAGES_SQL = """messages AS (SELECT doc_id AS row_id, 'doc-' || doc_id AS id, '<doc-' || doc_id || '@fixture>' AS imid,
CASE doc_id % 3 WHEN 0 THEN 'inbox' WHEN 1 THEN 'archive' ELSE 'sentitems' END AS folder, left(text, 40) AS subject,
CASE WHEN doc_id % 5 <> 0 THEN 'Sender ' || source END AS sender_name, source || '@' || lang || '.example' AS sender_address,
'user' || (doc_id % 7) || '@example.se' AS recipients, (1704067200 + doc_id * 3600)::BIGINT AS received_unix,
doc_id % 4 = 0 AS has_attachments, text AS body, CASE WHEN doc_id % 6 <> 0 THEN text END AS body_raw FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunks, two for each message; every fifth is still without a vector."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(v.alias("chunk_id"), F.floor(v / 2).cast("long").alias("row_id"), (v % 2).cast("int").alias("ordinal"), F.concat(F.lit("chunk "), v).alias("text"), F.when(v % 5 != 0, F.col("embedding")).alias("embedding"))


CHUNKS_SQL = "chunks AS (SELECT vec_id AS chunk_id, vec_id // 2 AS row_id, 'chunk ' || vec_id AS text, CASE WHEN vec_id % 5 <> 0 THEN embedding::DOUBLE[] END AS embedding FROM embeddings)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change feed on users: an error removes, anything else is a new version."""
    from ..schema import MESSAGE

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u-"), F.col("user_id")).alias("id"), F.concat(F.lit("folder"), F.col("user_id") % 3).alias("folder"), "event_type", "props")
    message = F.struct(
        "id", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "folder", F.col("event_type").alias("subject"), F.lit(None).cast("struct<name:string,address:string>").alias("c"),
        F.lit(None).cast("array<struct<name:string,address:string>>").alias("d"), F.lit(None).cast("array<struct<name:string,address:string>>").alias("e"), F.lit(None).cast("timestamp").alias("f"),
        F.lit(False).alias("g"), F.lit(None).cast("string").alias("h"), F.col("props").alias("body"),
    )
    return rows.select("seq", "id", "folder", F.when(F.col("event_type") != "error", message).cast(MESSAGE).alias("message"))


def message_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages`` as a change feed in the order of their ids."""
    from ..schema import MESSAGE

    none = F.lit(None)
    address = F.struct(none.cast("string").alias("name"), F.col("recipients").alias("address"))
    message = F.struct(
        "id", "internet_message_id", "conversation_id", "folder", "subject", F.struct(F.col("sender_name").alias("name"), F.col("sender_address").alias("address")).alias("sender"),
        F.array(address).alias("to"), F.array().cast("array<struct<name:string,address:string>>").alias("cc"), "received", "has_attachments", "web_link", F.col("body").alias("body"),
    )
    return messages(spark, sf_dir).select(F.col("row_id").alias("seq"), "id", "folder", message.cast(MESSAGE).alias("message"))
