"""Mixing sources to target weights by iterative proportional fitting.  DataFrame and SQL functions only.

Token counts are summed into cells of source, language and topic.  The cells' weights are raked: scaled to the target
share of each source, then of each language, then of each topic, again and again, ``ROUNDS`` times.  A cell can't give more
than it has, so a margin's factor is the one that gives its group the goal with the group's exhausted cells at 1.  A
document's probability is its cell's fitted tokens over the cell's tokens, at most 1.  A hash of its doc_id deals a document
into one of ``PLACES`` places in its cell, and the first places of a cell stay as long as their tokens are no more than the
fitted ones; the next place stays by a hash of the cell, with the chance that makes the expected tokens the fitted ones.  That
is the same sample in every run, and a cell misses its tokens by less than one place's.

The kept share of all tokens is ``KEEP``, or what the scarcest group of a margin allows.  Where no sample of that share meets
all margins, smaller shares do: ``RUNGS`` shares, each ``STEP`` times the one before, are fitted side by side, and the largest
of those whose margins miss their targets by at most ``NEAR`` (relative) is taken; if there is none, the one that misses least.
Every row says how much is missed (``gap``).

A topic is the most frequent of ``TOPICS`` classes of words (by first letter and length), over the whole text; ``topic`` gives
another measure in its place.  Targets default to token shares raised to ``SMOOTH`` and scaled to sum 1, which lifts small groups.

Defined results: null and empty texts have no tokens and topic 0, and get their cell's probability (0 tokens in a cell: the
kept share); null source or lang is a category of its own; ties between topics go to the smaller number; a null doc_id hashes
as ``null``; repeated rows share their fate; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TOPICS = 8
SMOOTH = 0.5
ROUNDS = 24
KEEP = 0.5
NEAR = 1e-3
STEP = 0.8
RUNGS = 16
PLACES = 4096
#: Rounds between two cuts of the lineage.
TOGETHER = 4
MARGINS = ("source", "lang", "topic")
NONE = "(none)"


def _classes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.ascii(w) + 7 * F.length(w), F.lit(TOPICS)).cast("int"))


def _sized(classes: Column) -> Column:
    """Tokens and topic of an array of word classes."""
    n = F.size(classes)
    counts = F.array(*[n - F.size(F.array_remove(classes, k)) for k in range(TOPICS)])
    return F.transform(F.array(counts), lambda c: F.struct(n.cast("long").alias("tokens"), (F.array_position(c, F.array_max(c)) - 1).cast("long").alias("topic")))[0]


def measured(docs: DataFrame, *keep: str | Column, topic: Column | None = None) -> DataFrame:
    """Columns ``keep``, and source, lang, topic and tokens of each row; ``topic``: an int of 0 or more, where it is known."""
    rows = docs.select(*keep, F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), _classes(F.col("text")).alias("classes"))
    kept = [c for c in rows.columns if c not in ("source", "lang", "classes")]
    if topic is not None:
        rows = docs.select(*keep, F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), topic.cast("long").alias("topic"), F.size(_classes(F.col("text"))).cast("long").alias("tokens"))
        return rows
    return rows.select(*kept, "source", "lang", F.explode(F.array(_sized(F.col("classes")))).alias("m")).select(*kept, "source", "lang", "m.topic", "m.tokens")


def targets(cells: DataFrame, margin: str, smooth: float = SMOOTH) -> DataFrame:
    """``margin, target``: smoothed shares of the margin's groups."""
    groups = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(smooth)).alias("part"))
    return groups.select(margin, (F.col("part") / F.sum("part").over(Window.partitionBy(F.lit(1)))).alias("target"))


def _filled(cells: DataFrame, margin: str) -> DataFrame:
    """``cells`` with ``x`` scaled within each rung and group so that the group's ``least(tokens, x)`` sum to its goal."""
    group = Window.partitionBy("rung", margin)
    # from the cell that is exhausted last: what these hold if all others are; the sum is the least of such lines
    upto = group.orderBy((F.col("tokens") / F.col("x")).desc(), *MARGINS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = cells.withColumn("free", F.sum("x").over(upto)).withColumn("held", F.sum("tokens").over(group) - F.sum("tokens").over(upto))
    factor = F.max((F.col(f"goal_{margin}") * F.col("share") - F.col("held")) / F.col("free")).over(group)
    return lines.withColumn("x", F.greatest(F.col("x") * factor, F.lit(1e-200))).drop("free", "held")


def rake(cells: DataFrame, aims: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with tokens, with ``x``, the fitted tokens, ``share``, the kept share, and ``gap``."""
    start = cells.where("tokens > 0")
    aims = aims or {m: targets(start, m) for m in MARGINS}
    total = float(start.agg(F.sum("tokens")).first()[0] or 0)
    for m in MARGINS:
        start = start.join(aims[m].select(m, (F.col("target") * total).alias(f"goal_{m}")), m)
    # one table of groups, not of documents, in a single task, so that the steps don't shuffle it
    start = start.coalesce(1)
    room = F.least(*[F.sum("tokens").over(Window.partitionBy(m)) / F.col(f"goal_{m}") for m in MARGINS])
    start = start.withColumn("room", room).withColumn("most", F.least(F.lit(keep), F.min("room").over(Window.partitionBy(F.lit(1)))))
    start = start.withColumn("rung", F.explode(F.sequence(F.lit(0), F.lit(RUNGS - 1)))).withColumn("share", F.col("most") * F.pow(F.lit(STEP), F.col("rung").cast("double")))
    state = cut(start.withColumn("x", F.col("tokens") * F.col("share")).drop("room", "most").coalesce(1), "start")
    for at in range(0, ROUNDS, TOGETHER):
        state = state.coalesce(1)
        for _ in range(min(TOGETHER, ROUNDS - at)):
            for m in MARGINS:
                state = _filled(state, m)
        state = cut(state, "fitted")
    state = state.coalesce(1).withColumn("x", F.least(F.col("tokens").cast("double"), F.col("x")))
    miss = [F.abs(F.sum("x").over(Window.partitionBy("rung", m)) / (F.col(f"goal_{m}") * F.col("share")) - 1) for m in MARGINS]
    state = state.withColumn("miss", F.greatest(*miss)).withColumn("gap", F.max("miss").over(Window.partitionBy("rung")))
    # the first rung that meets the targets, or the one that misses least
    best = F.min(F.struct(F.when(F.col("gap") <= NEAR, 0.0).otherwise(F.col("gap")).alias("miss"), "rung")).over(Window.partitionBy(F.lit(1)))
    return state.withColumn("best", best["rung"]).where("rung = best").select(*MARGINS, "tokens", "x", "share", "gap")


def place(doc_id: Column) -> Column:
    """A document's place among ``PLACES``, by a hash of its doc_id."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % PLACES).cast("int")


def chances(rows: DataFrame, keep: float = KEEP, aims: dict[str, DataFrame] | None = None) -> DataFrame:
    """``source, lang, topic, weight, probability, places, gap`` of each cell of measured rows with their ``place``.

    The weight is the probability over the kept share; the first ``places`` places of the cell stay.
    """
    dealt = cut(rows.groupBy(*MARGINS, "place").agg(F.sum("tokens").alias("tokens")), "dealt")
    cells = cut(dealt.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = cut(rake(cells, aims, keep), "raked")
    # two numbers for the whole table; without any token, the share asked for
    fate = fitted.agg(F.max("share"), F.max("gap")).first()
    share, gap = (fate[0], fate[1]) if fate[0] is not None else (float(keep), 0.0)
    # tables of one row for each cell: sources x languages x topics, not documents
    out = cells.join(fitted.select(*MARGINS, "x"), list(MARGINS), "left")
    out = out.select(*MARGINS, F.coalesce(F.col("x") / F.col("tokens"), F.lit(share)).alias("probability"), F.lit(share).alias("share"), "x", F.lit(gap).alias("gap"))
    # the first place that goes beyond the fitted tokens, and whether it stays
    upto = Window.partitionBy(*MARGINS).orderBy("place")
    choices = dealt.withColumn("held", F.sum("tokens").over(upto)).join(fitted.select(*MARGINS, "x"), list(MARGINS))
    over = F.struct("place", (F.col("held") - F.col("tokens")).alias("before"), "tokens")
    best = choices.groupBy(*MARGINS).agg(F.min(F.when(F.col("held") > F.col("x"), over)).alias("b"), F.first("x").alias("fit"))
    share_of_it = (F.col("fit") - F.col("b.before")) / F.col("b.tokens")
    chance = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(m).cast("string") for m in MARGINS]).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    best = best.select(*MARGINS, F.when(F.col("b").isNull(), PLACES).otherwise(F.col("b.place") + (share_of_it > chance).cast("int")).alias("n"))
    out = out.join(best, list(MARGINS), "left")
    places = F.coalesce("n", F.floor(F.col("probability") * PLACES).cast("int"))
    return cut(out.select(*MARGINS, (F.col("probability") / F.col("share")).alias("weight"), "probability", places.alias("places"), "gap"), "chances")


def mix(docs: DataFrame, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, weight, probability, kept, gap`` for each row of ``docs``."""
    rows = cut(measured(docs, F.col("doc_id").cast("long").alias("doc_id"), place(F.col("doc_id")).alias("place"), topic=topic), "measured")
    out = rows.join(chances(rows, keep), list(MARGINS))
    return out.select("doc_id", *MARGINS, "tokens", *[F.round(c, 6).alias(c) for c in ("weight", "probability")], (F.col("place") < F.col("places")).alias("kept"), F.round("gap", 6).alias("gap"))


def sample(docs: DataFrame, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; its margins meet their targets."""
    own = place(F.col("doc_id")).alias("place")
    rows = measured(docs, own, F.struct("*").alias("row"), topic=topic)
    return rows.join(chances(measured(docs, own, topic=topic), keep), list(MARGINS)).where("place < places").select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """The same in DuckDB's SQL, one common table for each step of raking."""
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    counts = ", ".join(f"len(list_filter(classes, lambda c: c = {k}))" for k in range(TOPICS))
    parts = [
        f"classed AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, list_transform({words}, lambda w: (unicode(w) + 7 * length(w)) % {TOPICS}) AS classes FROM documents)",
        f"counted AS (SELECT doc_id, source, lang, len(classes)::BIGINT AS tokens, [{counts}] AS counts FROM classed)",
        "measured AS (SELECT doc_id, source, lang, tokens, (list_position(counts, list_max(counts)) - 1)::BIGINT AS topic FROM counted)",
        "cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM measured GROUP BY ALL)",
    ]
    for m in MARGINS:
        parts.append(f"aim_{m} AS (SELECT {m}, part / sum(part) OVER () * (SELECT sum(tokens)::DOUBLE FROM cells) AS goal_{m} FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, {SMOOTH}) AS part FROM cells GROUP BY {m}))")
        parts.append(f"room_{m} AS (SELECT min(tokens / goal_{m}) AS room FROM (SELECT {m}, sum(tokens) AS tokens FROM cells WHERE tokens > 0 GROUP BY {m}) JOIN aim_{m} USING ({m}))")
    joins = " ".join(f"JOIN aim_{m} USING ({m})" for m in MARGINS)
    most = f"least({KEEP}, " + ", ".join(f"(SELECT room FROM room_{m})" for m in MARGINS) + ")"
    goals = ", ".join(f"goal_{m}" for m in MARGINS)
    parts.append(f"shares AS (SELECT rung, {most} * pow({STEP}::DOUBLE, rung) AS share FROM range({RUNGS}) r(rung))")
    parts.append(f"step0 AS MATERIALIZED (SELECT rung, share, source, lang, topic, tokens, {goals}, tokens * share AS x FROM cells {joins}, shares WHERE tokens > 0)")
    for i in range(ROUNDS * len(MARGINS)):
        m = MARGINS[i % len(MARGINS)]
        # for each cell: what its group holds if the cells that are exhausted before it are at 1 and the rest is scaled
        lines = f"SELECT *, sum(x) OVER w AS free, sum(tokens) OVER (PARTITION BY rung, {m}) - sum(tokens) OVER w AS held FROM step{i} WINDOW w AS (PARTITION BY rung, {m} ORDER BY tokens / x DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)"
        parts.append(f"step{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (free, held) REPLACE (greatest(x * max((goal_{m} * share - held) / free) OVER (PARTITION BY rung, {m}), 1e-200) AS x) FROM ({lines}))")
    last = f"step{ROUNDS * len(MARGINS)}"
    misses = ", ".join(f"abs(sum(x) OVER (PARTITION BY rung, {m}) / (goal_{m} * share) - 1)" for m in MARGINS)
    parts.append(f"ended AS MATERIALIZED (SELECT rung, share, source, lang, topic, tokens, x, max(miss) OVER (PARTITION BY rung) AS gap FROM (SELECT *, greatest({misses}) AS miss FROM (SELECT * REPLACE (least(tokens::DOUBLE, x) AS x) FROM {last})))")
    parts.append(f"fate AS MATERIALIZED (SELECT rung, share, gap FROM ended ORDER BY CASE WHEN gap <= {NEAR} THEN 0.0 ELSE gap END, rung LIMIT 1)")
    parts.append("fitted AS (SELECT source, lang, topic, x, x / tokens AS p FROM ended WHERE rung = (SELECT rung FROM fate))")
    parts.append(f"dealt AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % {PLACES} AS place FROM measured)")
    parts.append("held AS (SELECT source, lang, topic, place, sum(tokens) AS own, sum(sum(tokens)) OVER (PARTITION BY source, lang, topic ORDER BY place) AS held FROM dealt GROUP BY source, lang, topic, place)")
    parts.append("bound AS (SELECT source, lang, topic, place, own, held FROM held JOIN fitted USING (source, lang, topic) WHERE held > x QUALIFY row_number() OVER (PARTITION BY source, lang, topic ORDER BY place) = 1)")
    chance = "('0x' || substr(md5(source || '|' || lang || '|' || topic), 1, 8))::BIGINT::DOUBLE / 4294967296.0"
    parts.append(f"best AS (SELECT source, lang, topic, CASE WHEN place IS NULL THEN {PLACES} WHEN (x - (held - own)) / own > {chance} THEN place + 1 ELSE place END AS n FROM fitted LEFT JOIN bound USING (source, lang, topic))")
    parts.append(f"known AS (SELECT doc_id, source, lang, topic, tokens, place, n, coalesce((SELECT share FROM fate), {KEEP}) AS share, coalesce((SELECT gap FROM fate), 0.0) AS gap, coalesce(p, (SELECT share FROM fate), {KEEP}) AS p FROM dealt LEFT JOIN fitted USING (source, lang, topic) LEFT JOIN best USING (source, lang, topic))")
    return (
        "WITH " + ", ".join(parts) + " SELECT doc_id, source, lang, topic, tokens, round(p / share, 6) AS weight, round(p, 6) AS probability, "
        f"place < coalesce(n, floor(p * {PLACES})) AS kept, round(gap, 6) AS gap FROM known"
    )


ORACLE = _oracle()
