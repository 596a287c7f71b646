"""Joining rankings, and what single rankings score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Search
from ..query import Query


def vector_weight(query: Query, settings: Search) -> float:
    """Of the vector ranking; quoted identifiers trust words more."""
    return settings.vector_weight * (settings.identifier_vector_weight_factor if query.asks_for_identifier else 1.0)


def reciprocal_ranks(keyword: DataFrame, vector: DataFrame, weight: Column | float = 1.0, k: int = 60) -> DataFrame:
    """``qid, row_id, score, keyword_rank, vector_rank, chunk_id``: sums of weight / (k + rank) over both rankings."""
    left = keyword.select("qid", "row_id", "keyword_rank")
    right = vector.select("qid", "row_id", "vector_rank", "chunk_id")
    both = left.join(right, ["qid", "row_id"], "full_outer")
    part = F.coalesce(F.lit(1.0) / (k + F.col("keyword_rank")), F.lit(0.0))
    other = F.coalesce((weight if isinstance(weight, Column) else F.lit(float(weight))) / (k + F.col("vector_rank")), F.lit(0.0))
    return both.select("qid", "row_id", (part + other).alias("score"), "keyword_rank", "vector_rank", "chunk_id")


def single(ranking: DataFrame, rank: str) -> DataFrame:
    """The same columns of one ranking, with score 1 / rank."""
    keyword = F.col(rank) if rank == "keyword_rank" else F.lit(None).cast("int")
    vector = F.col(rank) if rank == "vector_rank" else F.lit(None).cast("int")
    chunk = F.col("chunk_id") if "chunk_id" in ranking.columns else F.lit(None).cast("long")
    return ranking.select("qid", "row_id", (F.lit(1.0) / F.col(rank)).alias("score"), keyword.alias("keyword_rank"), vector.alias("vector_rank"), chunk.alias("chunk_id"))


def ranked(fused: DataFrame) -> DataFrame:
    """With ``place``: by score, of equals first what words found, in their order, then what vectors found."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("vector_rank"), "row_id")
    return fused.withColumn("place", F.row_number().over(order))
