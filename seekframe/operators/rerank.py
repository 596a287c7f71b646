"""Scoring the best fused candidates again with a model that reads query and passage together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import passage, without_header


def reranked(fused: DataFrame, messages: DataFrame, chunks: DataFrame, texts: dict[str, str], reranker, depth: int = 50) -> DataFrame:
    """``fused`` (with ``place``) with new scores and places of the first ``depth``; the rest follow with their own scores."""
    if reranker is None:
        raise ValueError("no reranker is configured")
    depth = max(depth, 1)
    head, tail = fused.where(F.col("place") <= depth), fused.where(F.col("place") > depth)
    body = head.join(messages.select("row_id", "subject", "body"), "row_id", "left")
    body = body.join(chunks.select("chunk_id", F.col("text").alias("chunk")), "chunk_id", "left")
    bare = without_header(F.coalesce("chunk", F.lit("")))
    text = F.when(bare != "", bare).otherwise(F.coalesce("body", F.lit("")))

    @F.pandas_udf("double")
    def score(qid: pd.Series, passages: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=qid.index)
        for q, own in passages.groupby(qid):
            out[own.index] = [float(x) for x in reranker.score(texts[q], own.tolist())]
        return out

    again = body.withColumn("new", score("qid", passage(F.col("subject"), text)))
    order = Window.partitionBy("qid").orderBy(F.desc("new"), "place")
    first = again.withColumn("n", F.row_number().over(order)).select(*[c for c in fused.columns if c not in ("score", "place")], F.col("new").alias("score"), F.col("n").alias("place"))
    return first.unionByName(tail)
