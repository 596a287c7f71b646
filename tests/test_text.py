import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from seekframe.config import Config, relaxed_json
from seekframe.functions import models
from seekframe.functions.chunk import split
from seekframe.functions.clean import clean
from seekframe.functions.snippet import runs, snippet, tokenize
from seekframe.functions import text as T
from seekframe.query import looks_like_identifier, parse, period


def test_parse_filters_and_phrases():
    q = parse('invoice from:contoso to:karin after:2025-01 before:2025-03-15 has:attachment folder:inbox')
    assert (q.terms, q.sender, q.to, q.folder, q.has_attachments) == (["invoice"], "contoso", "karin", "inbox", True)
    assert (q.after.isoformat()[:10], q.before.isoformat()[:10]) == ("2025-01-01", "2025-03-15")
    q = parse('"kick-off agenda" friday')
    assert q.phrases == ["kick-off agenda"] and q.semantic_text == "kick-off agenda friday"
    q = parse('budget from:"Anna Svensson" re:project 10:30')
    assert q.sender == "Anna Svensson" and q.terms == ["budget", "re:project", "10:30"]
    assert parse("kickoff schedule").match_text() == '"kickoff" AND "schedule"'
    assert parse("when is the budget").parts == ["budget"] and len(parse("what is this").parts) == 3
    assert not parse("from:anna has:attachment").has_text and parse("a").terms == ["a"]
    assert parse('foo"bar baz"').terms == ["foobar baz"] and parse('"" x').phrases == ["x"]


@pytest.mark.parametrize("text,start,end", [("2024", "2024-01-01", "2025-01-01"), ("2024-02", "2024-02-01", "2024-03-01"), ("2024-12", "2024-12-01", "2025-01-01"), ("2024-02-29", "2024-02-29", "2024-03-01")])
def test_period(text, start, end):
    assert tuple(x.date().isoformat() for x in period(text)) == (start, end)


def test_period_rejects():
    assert all(period(x) is None for x in ("2023-02-29", "24", "2024-13", "x", "2024-1"))


def test_identifiers():
    assert all(map(looks_like_identifier, ("SAS13524", "INV-20431", "anna@example.se", "contoso.com", "4711234")))
    assert not any(map(looks_like_identifier, ("travel", "kick-off", "Q3", "2024", "end.")))
    assert parse('invoice "INV-20431" status').asks_for_identifier and not parse("INV-20431").asks_for_identifier


@pytest.mark.parametrize(
    "body,want",
    [
        ("Sounds good, see you Friday.\n\nOn Mon, 3 Jun 2024 at 10:12, Anna <anna@example.com> wrote:\n> Still on?\n> Anna", "Sounds good, see you Friday."),
        ("The invoice INV-20431 has been paid today.\n\nMed vänliga hälsningar\nJohan Berg\nNordvik AB", "The invoice INV-20431 has been paid today."),
        ("Look at this [cid:image001.png@01DA] chart [https://img.example.com/a.png].\n\n\n\n\nMore   text    here.", "Look at this chart .\n\nMore text here."),
        ("Yes, approved - go ahead with the order.\n\n________________________________\nFrom: Bob\nSent: Monday\n\nCan we?", "Yes, approved - go ahead with the order."),
        ("­ ­ ­ Receipt from Cordnet​ OÜ.   Total:  40 EUR", "Receipt from Cordnet OÜ. Total: 40 EUR"),
        ("Hej! Här kommer materialet inför kickoffen, se bilaga.\n\nFrån: Anna <a@example.se>\nSkickat: den 3 juni\nTill: Karin\n\nKan du skicka?", "Hej! Här kommer materialet inför kickoffen, se bilaga."),
        ("", ""),
        ("   \n ", ""),
        (None, ""),
    ],
)
def test_clean(body, want):
    assert clean(body) == want


def test_clean_keeps_forwards_and_leading_sign_offs():
    assert "real content" in clean("Best regards\nThis is actually the whole message with real content.")
    out = clean("\n________________________________\nFrom: X <x@x.example>\nSent: Monday\nTo: K\nSubject: Receipt\n\nYour payment of $4 was received.")
    assert "payment of $4" in out and "____" not in out


def _plain_split(text, size, overlap):
    """The rules read plainly."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            floor = start + int(size * 0.6)
            best = end
            spots = [i + 2 for i in range(floor + 1, end - 1) if text[i : i + 2] == "\n\n"]
            if not spots:
                spots = [i + 1 for i in range(floor + 1, end) if text[i] in ".!?\n" and i + 1 < len(text) and text[i + 1].isspace()]
            if not spots:
                spots = [i + 1 for i in range(floor + 1, end) if text[i] == " "]
            end = spots[-1] if spots else best
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = end - overlap if end - overlap > start else end
    return out


def test_chunks():
    assert split("hello world", 100, 10) == ["hello world"] and split("  ", 10, 1) == []
    assert len(split("a" * 200 + "\n\n" + "b" * 200, 260, 20)) == 2
    with pytest.raises(ValueError):
        split("x", 10, 10)
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", ". ", "\n", "\n\n", "! ", "cd"]) for _ in range(rng.randint(0, 200)))
        assert split(text, 40, 7) == _plain_split(text, 40, 7)


def test_whole_bodies_are_assembled(spark, tmp_path):
    from seekframe.plans import catalog

    rng = random.Random(4)
    bodies = ["".join(rng.choice(["word ", "other ", "end. ", "\n", "\n\n"]) for _ in range(n)) for n in (5, 90, 400, 1500, 3000)] + ["", " \n ", None, "x" * 2000, "y" * 950]
    rows = [(i, b, "en", "src") for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, b, lang, source in rows:
        sender = f"Sender {source} <{source}@{lang}.example>" if i % 5 else f"{source}@{lang}.example"
        header = f"Subject: {(b or '')[:40]}\nFrom: {sender}\nDate: 2024-01-01"
        pieces = _plain_split((b or "").strip(), 900, 120)
        want += [(i, k, f"{header}\n\n{p}") for k, p in enumerate(pieces)] or [(i, 0, header)]
    got = catalog.QUERIES["chunk_assemble_whole"](spark, str(tmp_path)).collect()
    assert sorted((r["row_id"], r["ordinal"], r["chunk"]) for r in got) == want
    assert sum(r["row_id"] == 0 for r in got) == 1 and sum(r["row_id"] == 4 for r in got) > 10


def test_snippets_like_sqlite():
    rng = random.Random(7)
    for _ in range(300):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 40))]
        body = "".join(w + rng.choice([" ", " ", ". ", ": ", "\n"]) for w in words)
        phrases = [" ".join(rng.choice(["a", "b", "ab", "ca"]) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 3))]
        db = sqlite3.connect(":memory:")
        db.execute("create virtual table t using fts5(s, body, tokenize='unicode61 remove_diacritics 2')")
        db.execute("insert into t values ('zz', ?)", (body,))
        row = db.execute("select snippet(t, 1, '[', ']', '…', 14) from t where t match ?", (" OR ".join(f'"{p}"' for p in phrases),)).fetchone()
        if row:
            assert snippet(body, [tokenize(p) for p in phrases]) == row[0]
    assert runs("a [b] c") == [("a ", False), ("b", True), (" c", False)]


def test_tokens_like_python(spark):
    texts = ["Kick-off Å É ø ß_x ²", "été naïve", "", None, "Ǡ µ ſ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", T.tokens(F.col("t")).alias("x")).collect()}
    assert got == {i: tokenize(t or "") for i, t in enumerate(texts)}
    assert got[0] == ["kick", "off", "a", "e", "ø", "ß", "x", "²"] and got[1] == ["ete", "naive"]


def test_like_folds_ascii_only(spark):
    df = spark.createDataFrame([("ANNA@x",), ("Åsa",), (None,), ("a%b",)], "t string")
    got = lambda asked: [r[0] for r in df.select(T.contains_like(F.col("t"), asked)).collect()]
    assert got("anna") == [True, False, None, False] and got("åsa") == [False, False, None, False] and got("a_b")[3]


def test_windows_and_pairs():
    for n, most in ((127, 128), (300, 128), (1000, 128), (50, 16), (5, 2)):
        out = models.windows([0, *range(10, 10 + n), 2], most)
        assert all(w[0] == 0 and w[-1] == 2 for w in out) and [t for w in out for t in w[1:-1]] == list(range(10, 10 + n))
        assert n + 2 > most or len(out) == 1
    ids, n = models.pair([0, *range(5, 40), 2], [0, *range(50, 90), 2], 32, 2)
    assert len(ids) == 32 and n == 16 and ids[n - 1] == 2 and ids[-1] == 2 and ids[n] == 2


def test_http_embeddings_are_ordered_and_normalised():
    settings = Config().embedding
    answer = lambda body: {"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}]}
    out = models.HttpEmbedder(settings, 2, answer).embed_documents(["a", "b"])
    assert out.tolist() == [[0.6000000238418579, 0.800000011920929], [0.0, 1.0]]


def test_config(tmp_path):
    assert relaxed_json('{"a": [1, 2,], // x\n "b": "//,}", /* y */ }') == {"a": [1, 2], "b": "//,}"}
    place = tmp_path / "c.json"
    assert Config.load(place).search.rrf_k == 60
    place.write_text('{"search": {"RrfK": 7}, "embedding": {"httpApiKey": "s3"}}')
    c = Config.load(place)
    assert c.search.rrf_k == 7 and "s3" not in c.redacted() and "***" in c.redacted()
    c.save(place)
    assert Config.load(place) == c


def test_embedded_words(spark):
    def plain(text):
        out = [0.0] * 256
        for word in text.lower().translate(str.maketrans("\n,.:;!?-", "        ")).split(" "):
            if word:
                h = 2166136261
                for c in word[:5]:
                    h = (h ^ ord(c)) * 16777619 % 2**32
                out[(h & 0x7FFFFFFF) % 256] += 1
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm for x in out] if norm else out

    texts = ["Kick-off agenda, agenda!", "", "kickoffen\nåäö"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", models.embed(F.col("t"), models.WordEmbedder()).alias("v")).collect()}
    assert all(abs(a - b) < 1e-6 for i, t in enumerate(texts) for a, b in zip(got[i], plain(t), strict=True))
