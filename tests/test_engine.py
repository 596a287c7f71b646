import json
import sqlite3
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from seekframe import schema
from seekframe.config import Config, Indexing, Mode
from seekframe.functions.models import OverlapReranker, WordEmbedder
from seekframe.operators import dense, filters, fusion, lexical
from seekframe.plans.search import Searcher
from seekframe.sources import feed, files
from seekframe.sources.store import Store
from seekframe.streaming import ingest

ROWS = [
    ("m1", "Kick-off agenda", "anna@example.se", "2024-06-03", True, "Here is the kick-off agenda for Friday. We start 09:00."),
    ("m2", "Invoice INV-20431", "billing@contoso.com", "2025-02-10", True, "Please find invoice INV-20431 attached. Payment due in 30 days."),
    ("m3", "Lunch?", "bob@example.se", "2025-03-01", False, "Want to grab lunch on Thursday?"),
    ("m4", "Budget review", "anna@example.se", "2025-01-20", False, "Attaching the budget review notes from Monday. " + "More detail about budget lines and forecasts. " * 20),
]


def change(seq, row):
    mid, subject, sender, day, attached, body = row
    when = datetime.fromisoformat(day + "T10:00:00").replace(tzinfo=timezone.utc)
    return (seq, mid, "inbox", (mid, f"<{mid}@test>", None, "inbox", subject, (None, sender), [("Karin", "karin@example.se")], [], when, attached, None, body))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = Store(spark, f"file://{tmp_path_factory.mktemp('store')}", Indexing(200, 40))
    out.apply(spark.createDataFrame([change(i, r) for i, r in enumerate(ROWS)], schema.CHANGE))
    out.embed_pending(WordEmbedder())
    return out


@pytest.fixture(scope="module")
def searcher(store):
    return Searcher(store.messages, store.chunks, WordEmbedder(), OverlapReranker(), Config(), store.meta("embedding_model"))


def ids(searcher, store, text, mode, top=10):
    names = {r["row_id"]: r["id"] for r in store.messages.collect()}
    return [(names[r["row_id"]], r) for r in searcher.search(text, mode, top).collect()]


def test_store(store):
    assert [r["n"] for r in store.chunks.groupBy("row_id").agg(F.count("*").alias("n")).orderBy("row_id").collect()] == [1, 1, 1, 7]
    assert store.messages.where("id = 'm1'").first()["recipients"] == "Karin <karin@example.se>"
    r = filters.stats(store.messages, store.chunks).first()
    assert (r["messages"], r["chunks"], r["pending"]) == (4, 10, 0)


def test_keyword(searcher, store):
    hits = ids(searcher, store, "INV-20431", Mode.KEYWORD)
    assert hits[0][0] == "m2" and hits[0][1]["snippet"] == "Please find invoice [INV-20431] attached. Payment due in 30 days."
    assert [h for h, _ in ids(searcher, store, "lunch agenda", Mode.KEYWORD)] == ["m3", "m1"]
    assert "m1" not in [h for h, _ in ids(searcher, store, "agenda after:2025-01", Mode.KEYWORD)]


def test_vector_ties_go_by_chunk(searcher, store):
    hits = ids(searcher, store, "kickoff", Mode.VECTOR)
    assert hits[0][0] == "m1" and hits[0][1]["keyword_rank"] is None and hits[0][1]["vector_rank"] == 1


def test_hybrid(searcher, store):
    hits = ids(searcher, store, "invoice payment", Mode.HYBRID)
    assert hits[0][0] == "m2" and (hits[0][1]["keyword_rank"], hits[0][1]["vector_rank"]) == (1, 1)
    assert [round(r["score"], 6) for _, r in hits] == [0.032787, 0.016129, 0.015873, 0.015625]
    assert [h for h, _ in ids(searcher, store, "lunch agenda", Mode.HYBRID)] == ["m3", "m1", "m2", "m4"]
    assert {h for h, _ in ids(searcher, store, "agenda budget from:anna", Mode.HYBRID)} == {"m1", "m4"}
    assert [h for h, _ in ids(searcher, store, "has:attachment", Mode.HYBRID)] == ["m2", "m1"]
    assert ids(searcher, store, "", Mode.HYBRID) == []


def test_loaded_index_gives_the_same(searcher, store):
    before = [tuple(r) for r in searcher.search("lunch agenda", Mode.HYBRID).collect()]
    searcher.load()
    assert [tuple(r) for r in searcher.search("lunch agenda", Mode.HYBRID).collect()] == before
    searcher.unload()


def test_rerank(spark, tmp_path):
    rows = [("r1", "Budget", "anna@x.example", "2025-05-01", False, "Nothing else to see here."), ("r2", "Planning", "bob@x.example", "2025-05-01", False, "The budget draft and the budget summary."), ("r3", "Notes", "cid@x.example", "2025-05-01", False, "budget budget budget review for the quarter.")]
    store = Store(spark, f"file://{tmp_path}/s")
    store.apply(spark.createDataFrame([change(i, r) for i, r in enumerate(rows)], schema.CHANGE))
    store.embed_pending(WordEmbedder())
    hits = ids(Searcher(store.messages, store.chunks, WordEmbedder(), OverlapReranker()), store, "budget", Mode.RERANK)
    assert [h for h, _ in hits] == ["r3", "r2", "r1"] and [r["score"] for _, r in hits] == [3.0, 2.0, 1.0]
    with pytest.raises(ValueError):
        Searcher(store.messages, store.chunks, WordEmbedder()).search("budget", Mode.RERANK)


def test_model_guard(store):
    with pytest.raises(dense.ModelMismatch):
        Searcher(store.messages, store.chunks, WordEmbedder(), stored_model="other").search("x", Mode.VECTOR)


def test_evaluate(searcher):
    cases = [{"query": "INV-20431", "expected": ["<m2@test>"]}, {"query": "kickoff", "expected": ["m1"]}, {"query": "nothing", "expected": ["rowid:99999"]}]
    r = searcher.evaluate(cases, [Mode.HYBRID]).first()
    assert (r["total"], r["recall_1"], r["recall_10"]) == (2, 1.0, 1.0)


def test_bm25_like_sqlite(spark):
    texts = [("a b c", "x"), ("a a b", "a"), ("c c", "b b"), ("b", ""), ("d a b", "c")] * 3
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(subject, body, sender, recipients)")
    for i, (s, b) in enumerate(texts):
        db.execute("insert into t(rowid, subject, body, sender, recipients) values (?, ?, ?, 's', 'r')", (i + 1, s, b))
    df = spark.createDataFrame([(i + 1, s, b, "s", "r") for i, (s, b) in enumerate(texts)], "row_id long, subject string, body string, sender string, recipients string")
    parts = ["d", "a b", "c"]
    index, sizes = lexical.scanned(df, lexical.terms_of({"q": parts}))
    got = {r["row_id"]: r["score"] for r in lexical.scored(index, sizes, lexical.asked(spark, {"q": parts})).collect()}
    want = dict(db.execute("select rowid, bm25(t, 3.0, 1.0, 2.0, 2.0) from t where t match ?", (" OR ".join(f'"{p}"' for p in parts),)).fetchall())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_fusion(spark):
    keyword = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "qid string, row_id long, keyword_rank int")
    vector = spark.createDataFrame([("q", 3, 1, 0), ("q", 4, 2, 0), ("q", 5, 3, 0)], "qid string, row_id long, vector_rank int, chunk_id long")
    out = fusion.ranked(fusion.reciprocal_ranks(keyword, vector)).orderBy("place").collect()
    assert out[0]["row_id"] == 3 and len(out) == 5


def test_upsert_delete_reindex(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Indexing(200, 40))
    store.apply(spark.createDataFrame([change(i, r) for i, r in enumerate(ROWS)], schema.CHANGE), batch="1")
    store.embed_pending(WordEmbedder())
    new = ("m3", "Lunch?", "bob@example.se", "2025-03-01", False, "Lunch is cancelled, sorry.")
    assert store.apply(spark.createDataFrame([change(0, new)], schema.CHANGE), batch="2") == {"upserted": 1, "removed": 0}
    assert store.apply(spark.createDataFrame([change(0, new)], schema.CHANGE), batch="2")["upserted"] == 0
    assert store.messages.count() == 4 and store.messages.where("id = 'm3'").first()["row_id"] == 5
    hit = Searcher(store.messages, store.chunks).search("cancelled", Mode.KEYWORD).collect()
    assert len(hit) == 1 and "[cancelled]" in hit[0]["snippet"]
    chunks = store.chunks.count()
    assert store.reindex() == 4 and store.chunks.count() == chunks and store.chunks.where("embedding is not null").isEmpty()
    assert store.delete("m3") and not store.delete("m3")
    store.vacuum(1)
    assert len(store.versions()) == 1 and store.messages.count() == 3


def test_stream_and_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    item = {"id": "a", "subject": "S", "from": {"emailAddress": {"name": "A", "address": "a@x.example"}}, "toRecipients": [{"emailAddress": {"address": "b@x.example"}}, {"emailAddress": {"name": "no"}}], "receivedDateTime": "2024-05-01T10:00:00Z", "hasAttachments": True, "body": {"content": "text"}}
    lines = [{"seq": 1, "folder": "inbox"} | item, {"seq": 2, "folder": "inbox", "id": "b", "toRecipients": 5}, {"seq": 3, "folder": "inbox", "id": "b", "@removed": {"reason": "deleted"}}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)))
    store = Store(spark, f"file://{tmp_path}/s")
    changes = feed.stream_files(spark, str(tmp_path / "in"))
    assert ingest.sync(changes, store, str(tmp_path / "cp"))[0]["upserted"] == 1
    assert ingest.sync(changes, store, str(tmp_path / "cp")) == []
    r = store.messages.first()
    assert (r["id"], r["recipients"], r["has_attachments"], r["sender_address"]) == ("a", "b@x.example", True, "a@x.example")
    assert ingest.rebuild(store, WordEmbedder())["embedded"] == 1


def test_pages_and_retries():
    book = {"s": {"value": [{"id": "1"}] * 3, "@odata.nextLink": "t"}, "t": {"value": [{"id": "2"}], "@odata.deltaLink": "u"}}
    assert [(len(v), t, end) for v, t, end in feed.pages(book.get, "s")] == [(3, "t", False), (1, "u", True)]
    assert [(len(v), t, end) for v, t, end in feed.pages(book.get, "s", most=2)] == [(3, "t", True)]
    answers, slept = [(429, {"Retry-After": "3"}, ""), (503, {}, ""), (200, {}, '{"a": 1}')], []
    assert feed.get_json(lambda u, h: answers.pop(0), "u", sleep=slept.append) == {"a": 1} and slept == [3.0, 4]
    with pytest.raises(feed.FeedError):
        feed.get_json(lambda u, h: (404, {}, ""), "u")


def test_feed_source(spark, tmp_path):
    spark.dataSource.register(feed.FeedSource)
    (tmp_path / "start.json").write_text(json.dumps({"folder": "inbox", "value": [{"id": "1"}], "@odata.deltaLink": "next"}))
    rows = spark.readStream.format("message_feed").option("path", str(tmp_path)).load()
    query = feed.of_items(rows).writeStream.format("memory").queryName("fed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [r["id"] for r in spark.sql("select id from fed").collect()] == ["1"]


def test_files(spark, tmp_path):
    files.save_cases(tmp_path / "e.json", files.EXAMPLE_CASES, "d")
    assert files.load_cases(tmp_path / "e.json") == files.EXAMPLE_CASES and files.read_cases(spark, str(tmp_path / "e.json")).count() == 2
    data = tmp_path / "data"
    (data / "models").mkdir(parents=True)
    for name, n in (("index.db", 1000), ("index.db-wal", 500), ("models/m", 300), ("x", 20)):
        (data / name).write_bytes(b"x" * n)
    u = files.usage(data)
    assert (u.tables, u.models, u.other, u.total) == (1500, 300, 20, 1820) and files.purge(data) == [] and not data.exists()
    assert files.size_text(1536) == "1.5 KB"
