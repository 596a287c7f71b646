"""The search itself: parse, filter, retrieve, fuse, rerank, assemble; for one query or for many in one plan."""

from __future__ import annotations

import time
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, Mode
from ..functions.models import Embedder, Reranker
from ..functions.snippet import snippet, tokenize
from ..functions.text import one_line, truncated, without_header
from ..operators import dense, evaluate, filters, fusion, lexical, rerank
from ..query import Query, parse
from ..sources.store import Store


class Searcher:
    """Searches messages, their chunks and their index.  The tables may be persisted with ``load``."""

    def __init__(self, messages: DataFrame, chunks: DataFrame, provider: Embedder | None = None, reranker: Reranker | None = None, config: Config | None = None, stored_model: str | None = None, index: DataFrame | None = None, sizes: DataFrame | tuple[int, float] | None = None):
        self.spark: SparkSession = messages.sparkSession
        self.messages, self.chunks = messages, chunks
        self.provider, self.reranker = provider, reranker
        self.config, self.stored_model = config or Config(), stored_model
        # without an index, searches scan the texts for their own terms; load() builds it
        self.index, self.sizes = index, sizes
        self.vectors: DataFrame | None = None
        self._loaded: list[DataFrame] = []

    @classmethod
    def of(cls, store: Store, provider: Embedder | None = None, reranker: Reranker | None = None, config: Config | None = None) -> Searcher:
        """Over the last version of a store, with its index."""
        return cls(store.messages, store.chunks, provider, reranker, config, store.meta("embedding_model"), store.index, store.totals)

    def load(self) -> Searcher:
        """Keep the index and the vectors in memory, where they fit, between searches."""
        if not self._loaded:
            if self.index is None:
                texts = lexical.searchable(self.messages)
                self.index, self.sizes = lexical.indexed(texts), lexical.lengths(texts).persist()
                self._loaded = [self.sizes]
            self.index, self.vectors = self.index.persist(), dense.embedded(self.chunks).persist()
            self._loaded += [self.index, self.vectors]
        return self

    def _index(self, parts: dict[str, list[str]]) -> tuple[DataFrame, DataFrame | tuple[int, float]]:
        if self.index is not None and self.sizes is not None:
            # the scan of a stored index reads the files that may hold these terms
            return self.index.where(F.col("term").isin(*sorted(lexical.terms_of(parts)))), self.sizes
        return lexical.scanned(lexical.searchable(self.messages), lexical.terms_of(parts))

    def unload(self) -> None:
        for x in self._loaded:
            x.unpersist()
        self._loaded, self.vectors = [], None
        for model in (self.provider, self.reranker):
            if hasattr(model, "unload"):
                model.unload()

    def _vectors(self) -> DataFrame:
        return self.vectors if self.vectors is not None else dense.embedded(self.chunks, self.provider.dims)

    def _keyword(self, queries: dict[str, Query], limit: int) -> DataFrame:
        parts = {qid: q.parts for qid, q in queries.items()}
        rows = lexical.scored(*self._index(parts), lexical.asked(self.spark, parts))
        free = [qid for qid, q in queries.items() if not q.has_filters]
        out = None
        for own, limited in ((free, False), ([q for q in queries if q not in free], True)):
            if own:
                found = rows.where(F.col("qid").isin(own))
                allowed = filters.allowed_many(self.messages, {q: queries[q] for q in own}) if limited else None
                found = lexical.top(found, limit, "or" if self.config.search.match_any else "fallback", allowed, self.config.search.exact_overfetch)
                out = found if out is None else out.unionAll(found)
        return out

    def _vector(self, queries: dict[str, Query], limit: int) -> DataFrame:
        if self.provider is None:
            raise ValueError("no embedding provider is configured")
        dense.check_model(self.stored_model, self.provider.model_id)
        out = None
        for limited in (False, True):
            own = {qid: self.provider.embed_query(q.semantic_text) for qid, q in queries.items() if q.has_filters == limited}
            if own:
                allowed = filters.allowed_many(self.messages, {q: queries[q] for q in own}) if limited else None
                found = dense.top(self._vectors(), own, limit, allowed)
                out = found if out is None else out.unionAll(found)
        return out

    def search_many(self, texts: dict[str, str], mode: Mode | str = Mode.HYBRID, top: int = 10) -> DataFrame:
        """``qid, rank, score, row_id, snippet, keyword_rank, vector_rank`` for each query text."""
        mode, settings = Mode(mode), self.config.search
        parsed = {qid: parse(t) for qid, t in texts.items()}
        if mode == Mode.RERANK and self.reranker is None:
            raise ValueError("no reranker is configured")
        limit = max(settings.candidate_count, top)
        out = None
        bare = {qid: q for qid, q in parsed.items() if not q.has_text}
        if bare:
            none = F.lit(None).cast("int")
            out = filters.newest_many(self.messages, bare, top).select("qid", "rank", F.lit(0.0).alias("score"), "row_id", one_line(F.col("snippet")).alias("snippet"), none.alias("keyword_rank"), none.alias("vector_rank"))
        asked = {qid: q for qid, q in parsed.items() if q.has_text}
        if not asked:
            return out if out is not None else self.spark.createDataFrame([], "qid string, rank int, score double, row_id long, snippet string, keyword_rank int, vector_rank int")
        if mode == Mode.KEYWORD:
            fused = fusion.single(self._keyword(asked, limit), "keyword_rank")
        elif mode == Mode.VECTOR:
            fused = fusion.single(self._vector(asked, limit), "vector_rank")
        else:
            weight = F.create_map(*[x for qid, q in asked.items() for x in (F.lit(qid), F.lit(float(fusion.vector_weight(q, settings))))])[F.col("qid")]
            fused = fusion.reciprocal_ranks(self._keyword(asked, limit), self._vector(asked, limit), weight, settings.rrf_k)
        fused = fusion.ranked(fused)
        if mode == Mode.RERANK:
            fused = rerank.reranked(fused, self.messages, self.chunks, {qid: q.semantic_text for qid, q in asked.items()}, self.reranker, self.config.rerank.depth)
        rows = self._assembled(fused.where(F.col("place") <= top), asked)
        return rows if out is None else out.unionByName(rows)

    def _assembled(self, best: DataFrame, asked: dict[str, Query]) -> DataFrame:
        """Ranks over the messages found, and snippets; only the best rows come here."""
        phrases = {qid: [tokenize(p) for p in q.parts] for qid, q in asked.items()}

        @F.pandas_udf("string")
        def marked(qid: pd.Series, body: pd.Series) -> pd.Series:
            return pd.Series([snippet(b, phrases[q]) for q, b in zip(qid, body)], dtype=object)

        rows = best.join(self.messages.select("row_id", "body"), "row_id")
        rows = rows.join(self.chunks.select("chunk_id", F.col("text").alias("chunk")), "chunk_id", "left")
        body = F.coalesce("body", F.lit(""))
        words = F.when(F.col("keyword_rank").isNotNull(), marked("qid", body))
        near = F.when(F.col("vector_rank").isNotNull(), truncated(without_header(F.coalesce("chunk", F.lit(""))), 220))
        text = F.coalesce(F.when(words != "", words), near, truncated(body, 160))
        order = Window.partitionBy("qid").orderBy("place")
        return rows.select("qid", F.row_number().over(order).alias("rank"), "score", "row_id", one_line(text).alias("snippet"), "keyword_rank", "vector_rank")

    def search(self, text: str, mode: Mode | str = Mode.HYBRID, top: int = 10) -> DataFrame:
        return self.search_many({"q": text}, mode, top).drop("qid").orderBy("rank")

    def evaluate(self, cases: Sequence[dict], modes: Sequence[Mode | str] = tuple(Mode), top: int = 10) -> DataFrame:
        """Metrics of each mode over cases of ``query`` and ``expected`` references; all queries of a mode are one plan."""
        refs = self.spark.createDataFrame([(str(i), r) for i, c in enumerate(cases) for r in c.get("expected") or []], "qid string, ref string")
        expected = refs.join(filters.resolve(self.messages, refs.select("ref")), "ref").select("qid", "row_id").distinct().persist()
        known = [r["qid"] for r in expected.select("qid").distinct().collect()]
        rows, asked = [], []
        for mode in modes:
            began = time.perf_counter()
            own = self.search_many({q: cases[int(q)]["query"] for q in known}, mode, top).select("qid", "row_id", "rank").collect() if known else []
            each = (time.perf_counter() - began) * 1000 / max(len(known), 1)
            rows += [(str(mode), r["qid"], r["row_id"], r["rank"]) for r in own]
            asked += [(str(mode), q, each) for q in known]
        hits = self.spark.createDataFrame(rows, "mode string, qid string, row_id long, rank int")
        return evaluate.metrics(evaluate.first_ranks(hits, self.spark.createDataFrame(asked, "mode string, qid string, ms double"), expected))
