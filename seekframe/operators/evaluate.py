"""Search quality: recall at k and mean reciprocal rank over queries with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranks(hits: DataFrame, asked: DataFrame, expected: DataFrame) -> DataFrame:
    """``mode, qid, rank, ms`` for each ``asked(mode, qid, ms)`` with a known answer: the rank of the first one found, else null.

    ``hits(mode, qid, row_id, rank)``, ``expected(qid, row_id)``; queries without a row in ``expected`` don't count.
    """
    known = expected.select("qid", "row_id").distinct()
    found = hits.join(known, ["qid", "row_id"], "left_semi").groupBy("mode", "qid").agg(F.min("rank").alias("rank"))
    return asked.join(known.select("qid").distinct(), "qid", "left_semi").join(found, ["mode", "qid"], "left").select("mode", "qid", "rank", "ms")


def metrics(ranks: DataFrame) -> DataFrame:
    """``mode, total, recall_1, recall_5, recall_10, mrr, avg_ms`` of ``ranks(mode, qid, rank, ms)``, one row a query; rank null: not found."""

    def recall(k: int):
        return F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")

    return ranks.groupBy("mode").agg(F.count("*").alias("total"), recall(1), recall(5), recall(10), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg("ms").alias("avg_ms"))


def report(rows: list) -> str:
    """A table of metrics as text."""
    out = [f"{'Mode':<10}{'R@1':>7}{'R@5':>7}{'R@10':>7}{'MRR':>8}{'avg ms':>9}"]
    out += [f"{r['mode']:<10}{r['recall_1']:>7.0%}{r['recall_5']:>7.0%}{r['recall_10']:>7.0%}{r['mrr']:>8.3f}{(r['avg_ms'] or 0):>9.0f}" for r in rows]
    return "\n".join(out)
