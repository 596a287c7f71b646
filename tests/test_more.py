"""Models with made sessions, the store's log, batches of queries, a feed from a local server, and stopping."""

import http.server
import json
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe import schema
from seekframe.config import Config, Embedding, Indexing, Mode, Rerank
from seekframe.functions import models
from seekframe.functions.models import OverlapReranker, WordEmbedder
from seekframe.operators import dense, filters, lexical
from seekframe.plans.search import Searcher
from seekframe.query import parse
from seekframe.sources import feed
from seekframe.sources.durable import numbered
from seekframe.sources.store import Store
from seekframe.streaming import ingest

# ---------------------------------------------------------------- models


class Letters:
    """A tokenizer of letters: 100 first, 102 last, padding 0."""

    pad, end, double_separator = 0, 102, False

    def encode(self, text):
        return [100, *map(ord, text), 102]


class Input:
    def __init__(self, name, kind="tensor(int64)"):
        self.name, self.type = name, kind


class Session:
    """Logits that give away what came in: rows of (constant, sum of ids where the segment is 1)."""

    def __init__(self, names=("input_ids", "attention_mask", "token_type_ids"), two=True):
        self.names, self.two, self.seen = names, two, []

    def get_inputs(self):
        return [Input(n, "tensor(int32)" if n == "attention_mask" else "tensor(int64)") for n in self.names]

    def run(self, _, given):
        self.seen.append(given)
        kinds = given.get("token_type_ids", given["attention_mask"])
        value = (given["input_ids"] * kinds).sum(axis=1).astype(np.float32)
        return [np.stack([np.full_like(value, -1), value], axis=1) if self.two else value[:, None]]


@pytest.mark.parametrize("two", [True, False])
def test_cross_encoder(two):
    r = models.OnnxReranker(Rerank(max_tokens=12, batch_size=2), "m", Letters())
    r._session = Session(two=two)
    got = r.score("ab", ["x", "yz", "a much longer passage"])
    # the second part is the passage without its first token, cut so that the last token stays
    assert got == [ord("x") + 102, ord("y") + ord("z") + 102, sum(map(ord, "a much ")) + 102]
    first = r._session.seen[0]
    assert first["input_ids"].tolist() == [[100, 97, 98, 102, 120, 102, 0], [100, 97, 98, 102, 121, 122, 102]] and first["attention_mask"].dtype == np.int32
    assert first["token_type_ids"].tolist() == [[0, 0, 0, 0, 1, 1, 0], [0, 0, 0, 0, 1, 1, 1]] and len(r._session.seen) == 2
    r._session = Session(("input_ids", "other"))
    with pytest.raises(ValueError):
        r.score("a", ["b"])
    r.unload()
    assert r._session is None


def test_two_separators():
    class Twice(Letters):
        double_separator = True

    r = models.OnnxReranker(Rerank(max_tokens=64), "m", Twice())
    r._session = Session()
    r.score("ab", ["x"])
    assert r._session.seen[0]["input_ids"].tolist() == [[100, 97, 98, 102, 102, 120, 102]] and not r._session.seen[0]["token_type_ids"].any()


def test_encoder_pools_and_averages():
    out = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    mask = np.array([[1, 1, 0], [1, 1, 1]])
    assert models.pooled(out, mask, "cls").tolist() == out[:, 0].tolist() and models.pooled(out[:, 0], mask, "mean").tolist() == out[:, 0].tolist()
    assert np.allclose(models.pooled(out, mask, "mean"), [out[0, :2].mean(axis=0), out[1].mean(axis=0)])
    vectors = np.array([[1.0, 0], [0, 1], [3, 4]])
    assert np.allclose(models.averaged(vectors, [[3, 1], [5]], False), [[0.75, 0.25], [3, 4]]) and np.allclose(np.linalg.norm(models.averaged(vectors, [[3, 1], [5]]), axis=1), 1)

    class Encoder(Session):
        def run(self, _, given):
            return [np.repeat(given["input_ids"][:, :, None], 2, axis=2).astype(np.float32) * [1, 2]]

    e = models.OnnxEmbedder(Embedding(max_tokens=5, normalize=False, document_prefix="p"), "d/m", Letters(), 2)
    e._session = Encoder(("input_ids", "attention_mask"))
    windows = [[100, 112, 97, 98, 102], [100, 99, 102]]
    want = (np.mean(windows[0]) * 5 + np.mean(windows[1]) * 3) / 8
    assert np.allclose(e.embed_documents(["abc"]), [[want, 2 * want]], rtol=1e-6) and e.embed_documents([]).shape == (0, 2)


def test_pieces_and_added_tokens():
    import public_tokenizers

    t = models.PieceTokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    plain = t.encode("one two")
    assert t.encode("one<mask> two</s>")[1:-1] == [*t.encode("one")[1:-1], 250001, *t.encode(" two")[1:-1], 2] and (plain[0], plain[-1]) == (0, 2) and isinstance(t.double_separator, bool)


def test_factories_and_downloads(tmp_path):
    opened = []

    class Answer:
        def __init__(self, url):
            opened.append(url)
            self.left = [b"ab", b"c", b""]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, n):
            return self.left.pop(0)

    place = models.downloaded("http://x/m", tmp_path / "a/m", Answer)
    assert open(place, "rb").read() == b"abc" and models.downloaded("http://x/m", place, Answer) == place and opened == ["http://x/m"] and not (tmp_path / "a/m.part").exists()
    (tmp_path / "models/r_p").mkdir(parents=True)
    for name in ("m.onnx", "t.model"):
        (tmp_path / "models/r_p" / name).write_bytes(b"x")
    settings = Rerank(provider="onnx", model_repo="r/p", model_file="m.onnx", tokenizer_file="t.model", max_tokens=99)
    made = models.reranker(settings, str(tmp_path / "models"))
    assert made.model_id == "r/p/m.onnx" and made.settings.max_tokens == 99 and isinstance(models.reranker(Rerank()), OverlapReranker)
    with pytest.raises(ValueError):
        models.reranker(Rerank(provider="?"))
    with pytest.raises(FileNotFoundError):
        models.reranker(Rerank(provider="onnx", model_directory=str(tmp_path)))


# ---------------------------------------------------------------- the store


def message(i, subject="s", body="b", folder="inbox", **more):
    return {"id": f"m{i}", "internet_message_id": f"<m{i}@x>", "conversation_id": None, "folder": folder, "subject": subject, "sender": {"name": "N", "address": f"a{i % 3}@x.example"}, "to": [{"name": None, "address": f"user{i % 4}@x"}], "cc": [], "received": None, "has_attachments": i % 2 == 0, "web_link": None, "body": body} | more


def change(seq, m, removed=False):
    return (seq, m["id"], m["folder"], None if removed else m)


def put(spark, store, rows, **more):
    return store.apply(spark.createDataFrame(rows, schema.CHANGE), **more)


def test_wide_rows_are_all_stored(spark, tmp_path):
    """Rows so wide that the ranges of counting and of numbering differ, under the engine's own settings."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(20_000).select(F.col("id").alias("seq"), F.concat(F.lit("m"), "id").alias("id"), F.lit("inbox").alias("folder"), F.struct(F.concat(F.lit("m"), "id").alias("id"), F.lit("s").alias("subject"), F.repeat(F.md5(F.col("id").cast("string")), 62).alias("body")).alias("m"))
        none = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("id", "subject", "body") else F.col(f"m.{f.name}").alias(f.name) for f in schema.MESSAGE]
        changes = rows.select("seq", "id", "folder", F.struct(*none).alias("message"))
        store = Store(spark, f"file://{tmp_path}/s", Indexing(clean_bodies=False))
        assert store.apply(changes) == {"upserted": 20_000, "removed": 0} and store.messages.select("row_id").distinct().count() == 20_000
        n = numbered(changes, "seq")
        assert n.where("n <> seq + 1").isEmpty() and n.count() == 20_000
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_meta_states_and_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.meta("a") is None and store.messages.isEmpty() and store.totals == (0, 0)
    store.set_meta(a="1", b="2")
    store.set_meta(a=None, c="x")
    assert (store.meta("a"), store.meta("b"), store.meta("c")) == (None, "2", "x") and store.sync_state("inbox") is None
    put(spark, store, [change(0, message(0))], states={"inbox": "t1", "sent": "t2"}, batch="go:7")
    assert put(spark, store, [change(0, message(9))], states={"inbox": "t0"}, batch="go:7") == {"upserted": 0, "removed": 0}
    assert put(spark, store, [change(0, message(9))], batch="go:3")["upserted"] == 0
    put(spark, store, [change(0, message(1))], states={"inbox": "t3", "sent": None}, batch="go:8")
    assert store.sync_state("inbox") == "t3" and store.synced_folders() == ["inbox"] and store.meta("b") == "2"
    record, after = store._record(), store._last()
    store._commit(record, after)
    with pytest.raises(RuntimeError):
        store._commit(record, after)


def test_many_deliveries_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("seekframe.sources.store.TABLES", 3)
    store, rng, want, at = Store(spark, f"file://{tmp_path}/s", Indexing(200, 40)), random.Random(3), {}, 0
    for n in range(9):
        rows = []
        for _ in range(4):
            m = message(rng.randrange(8), f"subject {at}", f"body number {at} of delivery {n}")
            gone = rng.random() < 0.3
            rows.append(change(at, m, gone))
            want[m["id"]] = None if gone else m["subject"]
            at += 1
        put(spark, store, rows, batch=f"d:{n}")
        if n == 4:
            store.embed_pending(WordEmbedder())
    left = {k: v for k, v in want.items() if v}
    assert {r["id"]: r["subject"] for r in store.messages.select("id", "subject").collect()} == left and len(store._record()["messages"]) <= 4
    ids = {r["row_id"] for r in store.messages.select("row_id").collect()}
    assert {r["row_id"] for r in store.chunks.collect()} == ids == {r["row_id"] for r in store.index.select("row_id").collect()}
    plain = lexical.indexed(lexical.searchable(store.messages))
    assert sorted(map(str, store.index.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert store.totals == (len(left), lexical.lengths(lexical.searchable(store.messages)).agg(F.sum("n_tokens")).first()[0])
    pending = store.chunks.where("embedding is null").count()
    assert store.embed_pending(WordEmbedder()) == pending and store.chunks.where("embedding is null").isEmpty()
    store.clear_embeddings()
    assert store.meta("embedding_model") is None and store.chunks.where("embedding is not null").isEmpty()
    assert ingest.reembed(store, WordEmbedder()) == store.chunks.count() and store.meta("embedding_dims") == "256"
    before = sorted(map(str, store.messages.drop("received").collect()))
    store.compact()
    store.vacuum(1)
    assert sorted(map(str, store.messages.drop("received").collect())) == before and store.chunks.where("embedding is null").isEmpty() and not store._record()["gone"]
    assert str(len(left)) in ingest.stats_line(store)


def test_search_over_a_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Indexing(200, 40))
    put(spark, store, [change(i, message(i, f"plan {i}", "budget of the year " + "river " * (i % 3), "archive" if i % 5 == 0 else "inbox")) for i in range(30)])
    store.embed_pending(WordEmbedder())
    texts = {"a": "budget river", "b": "river folder:archive", "c": "to:user1 has:attachment", "d": "folder:archive", "e": "nothing", "f": '"of the" from:a1@'}
    stored = Searcher.of(store, WordEmbedder(), OverlapReranker())
    scanned = Searcher(store.messages, store.chunks, WordEmbedder(), OverlapReranker(), Config(), store.meta("embedding_model"))
    for mode in Mode:
        got, want = (sorted(map(str, s.search_many(texts, mode).collect())) for s in (stored, scanned))
        assert got == want and got
    loaded = stored.load()
    assert sorted(map(str, loaded.search_many(texts).collect())) == sorted(map(str, scanned.search_many(texts).collect()))
    loaded.unload()


def test_many_filters_like_one_by_one(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    put(spark, store, [change(i, message(i, folder=["inbox", "Archive"][i % 2])) for i in range(20)] + [change(99, message(99) | {"sender": None})])
    texts = {str(i): t for i, t in enumerate(["folder:ARCHIVE", "to:user_", "from:a1@ has:attachment", "from:N", "after:2020", "before:2020", "to:%", "words only"])}
    queries = {k: parse(t) for k, t in texts.items()}
    got = {(r["qid"], r["row_id"]) for r in filters.allowed_many(store.messages, queries).collect()}
    want = {(k, r["row_id"]) for k, q in queries.items() if q.has_filters for r in filters.allowed(store.messages, q).collect()}
    assert got == want and got
    newest = [(r["qid"], r["rank"], r["row_id"]) for r in filters.newest_many(store.messages, queries, 3).orderBy("qid", "rank").collect()]
    assert newest == [(k, n + 1, r["row_id"]) for k, q in sorted(queries.items()) for n, r in enumerate(filters.newest(store.messages, q, 3).collect())]


def test_filtered_vectors_like_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8))
    rows = [(i, i // 2, vectors[i].tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "chunk_id long, row_id long, embedding array<float>")
    asked = {f"q{i}": rng.normal(size=8).tolist() for i in range(5)}
    allowed = {(q, r) for q in asked for r in range(200) if rng.random() < 0.3 and q != "q4"}
    got = dense.top(table, asked, 7, spark.createDataFrame(sorted(allowed), "qid string, row_id long")).collect()
    want = set()
    for q, v in asked.items():
        score = vectors.astype(np.float32).astype(float) @ np.array(v)
        best = sorted({r: max((score[2 * r], -2 * r), (score[2 * r + 1], -2 * r - 1)) for r in range(200) if (q, r) in allowed}.items(), key=lambda x: -x[1][0])[:7]
        want |= {(q, r, n + 1) for n, (r, _) in enumerate(best)}
    assert {(r["qid"], r["row_id"], r["vector_rank"]) for r in got} == want


# ---------------------------------------------------------------- feeds and stopping


@pytest.fixture
def server():
    pages, asked = {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers.get("Prefer"), self.headers.get("Authorization")))
            found = pages.get(self.path, [(404, {}, {})])
            status, headers, body = found.pop(0) if len(found) > 1 else found[0]
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    run = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=run.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{run.server_port}", pages, asked
    run.shutdown()


def test_pages_of_a_server(spark, tmp_path, server):
    base, pages, asked = server
    start = feed.start_url(base, "in box")
    first = start.removeprefix(base)
    pages[first] = [(429, {"Retry-After": "0"}, {}), (200, {}, {"value": [{"id": "a", "subject": "A"}, {"id": "b", "subject": "B"}], "@odata.nextLink": f"{base}/two"})]
    pages["/two"] = [(200, {}, {"value": [{"id": "a", "@removed": {}}], "@odata.deltaLink": f"{base}/later"})]
    pages["/later"] = [(200, {}, {"value": [{"id": "c", "subject": "C"}], "@odata.deltaLink": f"{base}/later2"})]
    store = Store(spark, f"file://{tmp_path}/s")
    get = feed.HttpPages(lambda: "secret", 7)
    assert ingest.sync_pages(store, get, "in box", start) == {"upserted": 2, "removed": 1} and store.sync_state("in box") == f"{base}/later"
    assert ingest.sync_pages(store, get, "in box", start)["upserted"] == 1 and sorted(r["id"] for r in store.messages.select("id").collect()) == ["b", "c"]
    assert len(asked) == 4 and asked[0][1] == f"{feed.PREFER}, odata.maxpagesize=7" and asked[0][2] == "Bearer secret" and "in%20box" in asked[0][0]
    with pytest.raises(feed.FeedError):
        get(f"{base}/nowhere")
    # the same pages as a streaming source
    spark.dataSource.register(feed.FeedSource)
    rows = spark.readStream.format("message_feed").option("url", f"{base}/two").option("folder", "inbox").load()
    query = feed.of_items(rows).writeStream.format("memory").queryName("served").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.sql("select * from served").count() < 2:
            time.sleep(0.2)
    finally:
        query.stop()
    assert {"a", "c"} <= {r["id"] for r in spark.sql("select * from served").collect()}


def test_stopping(spark, tmp_path, server):
    base, pages, _ = server
    pages["/busy"] = [(503, {"Retry-After": "60"}, {})]
    stop = threading.Event()
    threading.Timer(0.3, stop.set).start()
    began = time.time()
    with pytest.raises(feed.Cancelled):
        feed.HttpPages(stop=stop)(f"{base}/busy")
    with pytest.raises(feed.Cancelled):
        feed.HttpPages(stop=stop)(f"{base}/busy")
    assert time.time() - began < 20
    # a search or any other work of Spark's
    stop = threading.Event()
    threading.Timer(1.0, stop.set).start()
    slow = lambda: spark.range(0, 64, 1, 64).select(F.expr("reflect('java.util.UUID', 'randomUUID')")).crossJoin(spark.range(50_000_000)).count()
    with pytest.raises(ingest.Cancelled):
        ingest.run_until(spark, slow, stop)
    assert ingest.run_until(spark, lambda: spark.range(5).count(), threading.Event()) == 5
    with pytest.raises(ZeroDivisionError):
        ingest.run_until(spark, lambda: 1 // 0, threading.Event())
    # a sync
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"seq": i, "folder": "inbox", "id": f"x{i}", "subject": "S"}))
    stop = threading.Event()
    stop.set()
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ingest.Cancelled):
        ingest.sync(feed.stream_files(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"), stop=stop)
    # going on, and a full resync under another name
    ingest.sync(feed.stream_files(spark, str(tmp_path / "in")), store, str(tmp_path / "cp"))
    assert store.messages.count() == 3
    ingest.sync(feed.stream_files(spark, str(tmp_path / "in")), store, str(tmp_path / "cp2"), name="again")
    assert store.messages.count() == 3 and store.messages.agg(F.min("row_id")).first()[0] > 3


def test_progress_counts_rows(caplog):
    class Event:
        class progress:  # noqa: N801
            numInputRows = 5

    p = ingest.Progress(0.0)
    p.onQueryStarted(None)
    with caplog.at_level("INFO"):
        p.onQueryProgress(Event)
        p.onQueryProgress(Event)
        p.onQueryIdle(None)
        p.onQueryTerminated(None)
    assert p.rows == 10 and "10 changes" in caplog.text
