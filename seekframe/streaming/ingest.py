"""Incremental ingest: a stream of changes into the store, drained and then stopped."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.models import Embedder
from ..operators import filters
from ..sources import feed
from ..sources.feed import Cancelled
from ..sources.store import Store

T = TypeVar("T")
log = logging.getLogger(__name__)


class Progress(StreamingQueryListener):
    """Logs what arrives, at most every two seconds."""

    def __init__(self, every: float = 2.0):
        self._every, self._last, self.rows = every, 0.0, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if time.monotonic() - self._last >= self._every:
            self._last = time.monotonic()
            log.info("%d changes", self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("ended after %d changes", self.rows)


def run_until(spark: SparkSession, work: Callable[[], T], stop: threading.Event, poll: float = 0.1) -> T:
    """``work()``, whose Spark jobs are cancelled when ``stop`` is set; then ``Cancelled`` is raised."""
    tag = f"run-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    out: dict = {}

    def run() -> None:
        sc.addJobTag(tag)
        try:
            out["value"] = work()
        except Exception as e:
            out["error"] = e
        finally:
            sc.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    while thread.is_alive():
        thread.join(poll)
        if stop.is_set():
            sc.cancelJobsWithTag(tag)
    if stop.is_set() and "value" not in out:
        raise Cancelled("the work was stopped")
    if "error" in out:
        raise out["error"]
    return out["value"]


def sync_pages(store: Store, get: Callable[[str], dict], folder: str, start: str, most: int = 0, stop: threading.Event | None = None) -> dict[str, int]:
    """Apply a folder's pages from where the last run ended; every page and its token are one version of the store."""
    done = {"upserted": 0, "removed": 0}
    for changes, following in feed.fetched(store.spark, get, folder, start, store.sync_state(folder), most):
        if stop is not None and stop.is_set():
            raise Cancelled("the sync was stopped")
        r = store.apply(changes, {folder: following})
        done = {k: v + r[k] for k, v in done.items()}
    return done


def sync(changes: DataFrame, store: Store, checkpoint: str, name: str = "sync", stop: threading.Event | None = None) -> list[dict[str, int]]:
    """Apply what a streaming ``changes`` has now, batch by batch, and end.

    A batch that is delivered again after a failure is recognised by its number, so every change counts once.  A full
    resync is the same with a new checkpoint and a new name.  ``stop`` ends it between two batches' jobs; what was applied stays.
    """
    done: list[dict[str, int]] = []

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            done.append(store.apply(batch, batch=f"{name}:{number}"))

    query = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(0.2):
        if stop is not None and stop.is_set():
            query.stop()
            raise Cancelled("the sync was stopped")
    return done


def sync_and_embed(changes: DataFrame, store: Store, checkpoint: str, provider: Embedder, name: str = "sync") -> dict[str, int]:
    done = sync(changes, store, checkpoint, name)
    return {"upserted": sum(d["upserted"] for d in done), "removed": sum(d["removed"] for d in done), "embedded": store.embed_pending(provider)}


def counters(changes: DataFrame) -> DataFrame:
    """``folder, upserted, removed`` of a batch of changes."""
    return changes.groupBy("folder").agg(F.count("message").alias("upserted"), F.count_if(F.col("message").isNull()).alias("removed"))


def rebuild(store: Store, provider: Embedder) -> dict[str, int]:
    """Clean, chunk and embed everything again; messages without a raw body are skipped and counted."""
    skipped = store.messages.where("body_raw is null").count()
    return {"reindexed": store.reindex(), "skipped": skipped, "embedded": store.embed_pending(provider)}


def reembed(store: Store, provider: Embedder) -> int:
    store.clear_embeddings()
    return store.embed_pending(provider)


def stats_line(store: Store) -> str:
    r = filters.stats(store.messages, store.chunks).first()
    return f"{r['messages']} messages, {r['chunks']} chunks, {r['embedded']} embedded ({store.meta('embedding_model') or 'no model'})"
