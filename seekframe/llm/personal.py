"""Personal data: exact rules, and spans added by weak supervision.  DataFrame and SQL functions only.

Base kinds (email, ip, card, phone) are found by pattern, leftmost and without overlaps, and checked; matches that
fail a check are dropped.  Further candidates (strings that look like secrets, and numbers that look like phone
numbers) are voted on by labelers: a pattern, a gazetteer of the word before, the context around and the shape.
Expectation-maximisation over the counts of vote patterns (at most ``3 ** labelers`` rows) estimates how reliable each
labeler is, and its posteriors train the final span classifier, a naive Bayes model over bucketed span features (a
fixed number of weights).  A candidate becomes a span if the classifier prefers it and no base span overlaps it.

Patterns use possessive repeats and are anchored at the start of a run, so long runs of letters or digits take linear
time.  Offsets are code points, counted from the gaps between matches.

Defined results: null and empty texts have no spans; repeated rows give repeated rows; spans of one start come in the
order of ``KINDS``; a null doc_id is carried; without candidates nothing is added; other columns are not read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone", "secret", "contact")
#: For each base kind a cheap test of the text and the pattern; \G lets a match start where the last one ended.
BASE = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SECRET_WORDS = ("access", "api", "api_key", "apikey", "auth", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
_RUN = "[A-Za-z0-9_/+-]"
CANDIDATES = {
    "secret": ("[0-9]", rf"(?:[A-Za-z_]{{2,20}}+\x20?[=:]\x20?[\"']?|[\"'])?(?<!{_RUN})(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z]){_RUN}{{12,}}+(?![A-Za-z0-9_/+@-])"),
    "contact": (r"[0-9]{3}[\x20.-][0-9]{4}", r"(?:(?i:tel|phone|call|fax|mobile|contact)[a-z]{0,8}\x20?[:.]?\x20?)?(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
LABELERS = 4
ROUNDS = 25


#: Prefixes of arrays are made in blocks of so many, then blocks' prefixes are put before them: appending copies an array.
BLOCK = 64
#: Stands around matches while a text is split; a text's own is another character that no pattern knows.
MARK, OTHER = "\ufffe", "\uffff"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    """An array that isn't empty in blocks."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, combine) -> Column:
    """For each place of an int array what ``combine`` makes of the values before it, from 0."""

    def step(acc, x):
        return F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def whole(v):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        inner = F.transform(_blocks(v), lambda block: F.aggregate(block, start, step))

        def shifted(blocks):
            bases = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x["at"]))))
            return F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda x, base: F.transform(x["out"], lambda y: combine(base, y))))

        return F.when(F.size(v) > 0, _bound(inner, shifted)).otherwise(F.array().cast("array<int>"))

    return _bound(values, whole)


def matches(text: Column, test: str, pattern: str) -> Column:
    """Matches of a pattern with their offsets in code points: ``array<struct<m, s, e>>``.

    One pass of the pattern puts marks around the matches; what stands between two marks is by turns a gap and a match.
    """
    kind = "array<struct<m:string,s:int,e:int>>"
    plain = F.when(text.contains(MARK), F.translate(text, MARK, OTHER)).otherwise(text)
    parts = F.split(F.regexp_replace(plain, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def placed(p):
        def found(at):
            return F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: F.struct(p[i].alias("m"), at[i].alias("s"), at[i + 1].alias("e")))

        return F.when(F.size(p) > 1, _bound(running(F.transform(p, F.length), lambda a, b: a + b), found)).otherwise(F.array().cast(kind))

    return F.when(text.rlike(test), _bound(parts, placed)).otherwise(F.array().cast(kind))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc, i):
        d = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind ``array<struct<s, k, e>>``, k its number."""

    def spans(k: int, kind: str, test: str, pattern: str) -> Column:
        good = F.filter(matches(text, test, pattern), lambda x: _valid(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    return {kind: spans(k, kind, *how) for k, (kind, how) in enumerate(BASE.items())}


def _one(test: Column, yes: Column, otherwise: int = -1) -> Column:
    """A vote: 1, 0, or -1 for none."""
    return F.when(test, 1).when(yes, 0).otherwise(otherwise)


def candidates(text: Column) -> Column:
    """``array<struct<s, k, e, votes, features>>``: every candidate with its votes and bucketed features."""

    def of(kind: str, test: str, pattern: str) -> Column:
        k = KINDS.index(kind)
        end = rf"({_RUN}{{12,}})$" if kind == "secret" else r"(\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})$"

        def one(x):
            core = F.regexp_extract(x["m"], end, 1)
            before = F.substring(x["m"], F.lit(1), F.length(x["m"]) - F.length(core))
            word = F.lower(F.regexp_extract(before, "([A-Za-z_]+)", 1))
            digits, letters = F.length(_digits(core)), F.length(F.regexp_replace(core, "[^A-Za-z]", ""))
            named = word.isin(*SECRET_WORDS) if kind == "secret" else word != ""
            marked = before.rlike("[=:\"']")
            if kind == "secret":
                pattern_vote = _one(core.rlike("^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|[0-9A-F]{16,}|gh[a-z]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{16,})$"), digits < 3)
                shape_vote = _one((digits >= 4) & (letters >= 4) & ~core.rlike("[-/+]"), digits <= 2)
            else:
                pattern_vote = _one(core.rlike(r"^\(?[2-9]"), ~core.rlike(r"^\(?[2-9]"))
                shape_vote = _one(core.rlike(r"^\("), F.lit(False))
            votes = F.array(pattern_vote, _one(named, word != ""), _one(marked, F.lit(False)), shape_vote)
            case = F.when(core.rlike("[a-z]") & core.rlike("[A-Z]"), "mixed").when(core.rlike("[A-Z]"), "upper").otherwise("lower")
            features = F.array(
                F.lit(f"kind:{kind}"),
                F.concat(F.lit("length:"), F.least(F.length(core).cast("int") / F.lit(8), F.lit(6)).cast("int").cast("string")),
                F.concat(F.lit("digits:"), (digits * 5 / F.length(core)).cast("int").cast("string")),
                F.concat(F.lit("case:"), case),
                F.concat(F.lit("joined:"), core.rlike("[-_/+]").cast("string")),
                F.concat(F.lit("word:"), F.when(named, "known").when(word != "", "other").otherwise("none")),
                F.concat(F.lit("marked:"), marked.cast("string")),
                F.concat(F.lit("hex:"), core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("string")),
            )
            return F.struct((x["e"] - F.length(core)).alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), votes.alias("votes"), features.alias("features"))

        return F.transform(matches(text, test, pattern), one)

    return F.concat(*[of(kind, *how) for kind, how in CANDIDATES.items()])


def found_in(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the base spans of each kind and the candidates that overlap none of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = base_spans(F.col("text"))
    rows = rows.select("doc_id", *[v.alias(k) for k, v in spans.items()], candidates(F.col("text")).alias("candidates"))
    return rows.select("doc_id", *spans, _apart("candidates", F.concat(*spans)).alias("candidates"))


#: Up to so many pairs of candidates and base spans are held against each other; beyond, both are sorted first.
PAIRS = 4096


def _apart(name: str | Column, base: Column) -> Column:
    """The candidates that overlap no base span."""
    every = F.col(name) if isinstance(name, str) else name

    def plain(c, b):
        return F.filter(c, lambda x: ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))

    def ordered(c, b):
        # by start, base spans first: a base span before reaches into a candidate, or the next one starts inside of it
        far = 1 << 30
        spans = F.concat(F.transform(b, lambda y: F.struct(y["s"].alias("s"), F.lit(-1).alias("i"), y["e"].alias("e"))), F.transform(c, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["e"].alias("e"))))

        def flagged(rows):
            reach = running(F.transform(rows, lambda r: F.when(r["i"] < 0, r["e"]).otherwise(0)), F.greatest)
            following = F.reverse(running(F.reverse(F.transform(rows, lambda r: F.when(r["i"] < 0, far - r["s"]).otherwise(0))), F.greatest))
            free = F.zip_with(reach, following, lambda x, y: F.struct(x.alias("x"), (far - y).alias("y")))
            alone = F.zip_with(rows, free, lambda r, f: F.struct(r["i"].alias("i"), ((f["x"] <= r["s"]) & (f["y"] >= r["e"])).alias("alone")))
            flags = F.array_sort(F.filter(alone, lambda r: r["i"] >= 0))
            return _bound(flags, lambda t: F.filter(c, lambda x, i: t[i]["alone"]))

        return _bound(F.array_sort(spans), flagged)

    return _bound(every, lambda c: _bound(base, lambda b: F.when(F.size(c) * F.size(b) <= PAIRS, plain(c, b)).otherwise(ordered(c, b))))


def posteriors(found: DataFrame) -> DataFrame:
    """``votes, post``: each pattern of votes with the probability that EM gives it."""
    patterns = found.select(F.explode("candidates.votes").alias("votes")).groupBy("votes").agg(F.count("*").cast("double").alias("n"))

    def share(votes):
        cast = F.filter(votes, lambda v: v >= 0)
        return F.when(F.size(cast) == 0, 0.5).otherwise(F.aggregate(cast, F.lit(0.0), lambda a, v: a + v) / F.size(cast))

    one_row = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n", (share(F.col("votes")) * 0.9 + 0.05).alias("post")))).alias("rows"))

    def total(rows, value):
        return F.aggregate(rows, F.lit(0.0), lambda a, r: a + value(r))

    def step(rows, _):
        model = F.struct(
            ((total(rows, lambda r: r["n"] * r["post"]) + 1) / (total(rows, lambda r: r["n"]) + 2)).alias("prior"),
            F.array(*[(total(rows, lambda r, j=j: F.when(r["votes"][j] == 1, r["n"] * r["post"]).otherwise(0.0)) + 4) / (total(rows, lambda r, j=j: F.when(r["votes"][j] >= 0, r["n"] * r["post"]).otherwise(0.0)) + 5) for j in range(LABELERS)]).alias("hit"),
            F.array(*[(total(rows, lambda r, j=j: F.when(r["votes"][j] == 1, r["n"] * (1 - r["post"])).otherwise(0.0)) + 1) / (total(rows, lambda r, j=j: F.when(r["votes"][j] >= 0, r["n"] * (1 - r["post"])).otherwise(0.0)) + 5) for j in range(LABELERS)]).alias("false"),
        )

        def again(m):
            def one(r):
                odds = F.log(m["prior"] / (1 - m["prior"]))
                for j in range(LABELERS):
                    yes, no = m["hit"][j], m["false"][j]
                    odds = odds + F.when(r["votes"][j] == 1, F.log(yes / no)).when(r["votes"][j] == 0, F.log((1 - yes) / (1 - no))).otherwise(0.0)
                return F.struct(r["votes"].alias("votes"), r["n"].alias("n"), (1 / (1 + F.exp(-odds))).alias("post"))

            return F.transform(rows, one)

        return F.transform(F.array(model), again)[0]

    return one_row.select(F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("rows"), step)).alias("r")).select("r.votes", "r.post")


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier by feature; the intercept is under the empty name."""
    soft = found.select(F.explode("candidates").alias("c")).select("c.votes", "c.features").join(F.broadcast(cut(posteriors(found), "posteriors")), "votes")
    counts = soft.select("post", F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature")).groupBy("feature").agg(F.sum("post").alias("yes"), F.sum(1 - F.col("post")).alias("no"))
    rows = counts.orderBy("feature").collect()
    base = next(((r["yes"], r["no"]) for r in rows if r["feature"] == ""), None)
    if base is None:
        return {}
    out = {r["feature"]: log((r["yes"] + 0.5) / (base[0] + 1)) - log((r["no"] + 0.5) / (base[1] + 1)) for r in rows if r["feature"]}
    return out | {"": log((base[0] + 1) / (base[1] + 1))}


def added(candidates_: Column, weights: dict[str, float]) -> Column:
    """The candidates that the classifier takes, as ``array<struct<s, k, e>>``."""
    kind = "array<struct<s:int,k:int,e:int>>"
    if not weights:
        return F.array().cast(kind)
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])

    def taken(c):
        return F.aggregate(c["features"], F.lit(weights[""]), lambda a, f: a + F.coalesce(table[f], F.lit(0.0))) > 0

    return F.transform(F.filter(candidates_, taken), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base kinds, digest of base spans, and all spans, for each row."""
    found = cut(found_in(docs), "found")
    weights = train(found)
    base = F.array_sort(F.concat(*BASE))
    rows = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], base.alias("base"), F.array_sort(F.concat(F.concat(*BASE), added(F.col("candidates"), weights))).alias("every"))
    return rows.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("every")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of its text (overlapping ones together) replaced by ``<KIND>`` of the first."""
    weights = train(cut(found_in(docs.select("doc_id", F.col(text).alias("text"))), "found"))
    source = F.col(text)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    base = F.concat(*base_spans(source).values())
    spans = "__spans"
    while spans in docs.columns:
        spans += "_"
    # the base spans are bound once, then candidates are held against them
    every = F.transform(F.array(base), lambda b: F.array_sort(F.concat(b, added(_apart(candidates(source), b), weights))))[0]

    def whole(found):
        """The text put together of blocks of spans; in a block, only its own stretch of the text is looked at."""

        def joined(before):
            rows = F.transform(F.zip_with(found, before, lambda x, at: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), at.alias("at"))), lambda x: x)

            def of(block):
                start, end = block[0]["at"], F.array_max(F.transform(block, lambda x: F.greatest(x["at"], x["e"])))
                stretch = F.substring(source, start + 1, end - start)
                # a span that starts before the end of the last one only makes it longer
                one = lambda text: lambda x: F.when(x["s"] >= x["at"], F.concat(F.substring(text, x["at"] - start + 1, x["s"] - x["at"]), names[x["k"]])).otherwise("")
                return _bound(stretch, lambda text: F.array_join(F.transform(block, one(text)), ""))

            last = F.array_max(F.transform(found, lambda x: x["e"]))
            return F.concat(F.array_join(F.transform(_bound(rows, _blocks), of), ""), F.substring(source, last + 1, F.length(source)))

        return _bound(running(F.transform(found, lambda x: x["e"]), F.greatest), joined)

    return docs.withColumn(spans, every).withColumn(text, F.when(F.size(spans) > 0, _bound(F.col(spans), whole)).otherwise(source)).drop(spans)


def op10_personal(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
