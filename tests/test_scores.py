"""Scores of equal texts."""

from seekframe.operators import lexical


def test_equal_texts_score_equally(spark):
    parts = {"q": ["x", "y", "z"]}
    rows = [(i, 30 + 7, "body", t, n) for i in range(400) for n, t in enumerate(("x", "y", "z")[i % 3 :] + ("x", "y", "z")[: i % 3])]
    rows += [(1000 + i, 20, "body", "xy"[i % 2], 0) for i in range(700)] + [(5000 + i, 11, "body", "z", 0) for i in range(90)]
    rows += [(i, 37, "body", "x", 9 + n) for i in range(400) for n in range(2)] + [(i, 37, "body", "z", 19 + n) for i in range(400) for n in range(4)]
    rows.sort(key=lambda r: hash((r[0] * 7919) % 1009 + 13 * r[4]) % 997)
    index = spark.createDataFrame(rows, "row_id long, n_tokens long, col string, term string, pos int").repartition(7)
    scored = lexical.scored(index, (9_000, 300_000), lexical.asked(spark, parts))
    assert scored.where("n_matched = 3").select("score").distinct().count() == 1
    best = lexical.top(scored, 10, "and").orderBy("keyword_rank")
    assert [r["row_id"] for r in best.collect()] == list(range(10))
