"""The stored index: rows, ranges, and that making it brings nothing together."""

from pyspark.sql import functions as F

from seekframe.functions.snippet import tokenize
from seekframe.operators import lexical


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    rows = [(i, f"Subject {i % 3}", None if i == 5 else f"the the word{i} ÉTÉ the", "a b", "") for i in range(40)]
    return spark.createDataFrame(rows, "row_id long, subject string, body string, sender string, recipients string")


def test_index_is_made_without_bringing_rows_together(spark, monkeypatch):
    rows = texts(spark)
    assert "Exchange" not in plan(lexical.indexed(rows))
    want = {}
    for r in rows.collect():
        places = [(c, n, t) for c in sorted(lexical.WEIGHTS) for n, t in enumerate(tokenize(r[c] or ""))]
        for t in {t for _, _, t in places}:
            own = [(c, n) for c, n, x in places if x == t]
            want[t, r["row_id"]] = (len(places), sum(lexical.WEIGHTS[c] for c, _ in own), [n * 4 + lexical.PLACED.index(c) for c, n in own])
    monkeypatch.setattr(lexical, "RANGE", 50)
    monkeypatch.setattr(lexical, "BOUNDS", 40)
    for df in (lexical.indexed(rows), lexical.ranged(rows, 40, 40 * 9)):
        got = {(r["term"], r["row_id"]): (r["n_tokens"], r["f"], r["places"]) for r in df.collect()}
        assert got == want and df.count() == len(want)
    ranges = lexical.ranged(rows, 40, 40 * 9).withColumn("p", F.spark_partition_id())
    # the most frequent term has several ranges, and ranges do not overlap
    assert ranges.where("term = 'the'").select("p").distinct().count() > 1
    each = ranges.groupBy("p").agg(F.min(F.struct("term", "row_id")).alias("a"), F.max(F.struct("term", "row_id")).alias("z")).orderBy("a").collect()
    assert all(tuple(x["z"]) < tuple(y["a"]) for x, y in zip(each, each[1:]))
