"""Search over a written store: one plan per question, for one query or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import bm25, ranking, vector_search
from folioscope.operators.catalog import chunk_range, equation_share
from folioscope.operators.hooks import embedder

MODES = ["hybrid", "semantic", "bm25"]


class KnowledgeBase:
    """A store as plans.indexing writes it, with optional titles (doc_id, title)."""

    def __init__(self, spark: SparkSession, store: str, embedder_name: str = "hashing", metadata: DataFrame | None = None, metric: str = "cosine"):
        self.spark, self.metric, self.metadata = spark, metric, metadata
        self.model, self.threshold = embedder(embedder_name)["factory"](), embedder(embedder_name)["minimum_threshold"]
        self.chunks, self.documents = spark.read.parquet(f"{store}/chunks"), spark.read.parquet(f"{store}/documents")
        self.index = bm25.Bm25Index.load(spark, f"{store}/bm25")

    def _asked(self, queries: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(zip(queries, self.model(queries)))], "query_id int, query string, vector array<double>")

    def _where(self, equations: bool | None, project: str | None, document_ids: list | None) -> Column | None:
        tests = [None if equations is None else F.col("has_equations") == equations, None if project is None else F.col("project_id") == project, None if document_ids is None else F.col("doc_id").isin(document_ids)]
        out = None
        for t in tests:
            out = t if out is None else out if t is None else out & t
        return out

    def _keywords(self, asked: DataFrame, n: int, among: DataFrame | None) -> DataFrame:
        """Keyword hits among the chunks that a filter leaves; without a written index there are none."""
        if self.index is None:
            return self.spark.createDataFrame([], "query_id int, chunk_id string, rank int, raw_score double, score double")
        return bm25.search(self.index, asked.select("query_id", "query"), n, among=among)

    def search_documents(self, queries: list[str], n: int = 10, *, mode: str = "hybrid", ranked_by: str = "similarity", n_candidates: int = 200, equations: bool | None = None, project: str | None = None) -> DataFrame:
        """query_id, doc_id, score, rank, chunk_count, the best chunk with its section and page, title.

        Filters hold in every mode, before any ranking. In hybrid mode keywords order what the vectors find."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}, not {mode!r}")
        if ranked_by not in ranking.METRICS:
            raise ValueError(f"ranked_by is one of {sorted(ranking.METRICS)}, not {ranked_by!r}")
        where = self._where(equations, project, None)
        asked = self._asked(queries)
        chunks = self.chunks if where is None else self.chunks.filter(where)
        fetch = vector_search.WIDE_FETCH if mode == "semantic" else n_candidates
        hits = vector_search.search(chunks, asked.select("query_id", "vector"), fetch, metric=self.metric)
        if mode == "semantic":
            docs = ranking.METRICS[ranked_by](hits, self.threshold, n)
        else:
            keyword = self._keywords(asked, n_candidates if mode == "hybrid" else 20 * n, None if where is None else chunks)
            docs = ranking.fused_documents(ranking.fuse(hits, keyword, n_candidates), n).drop("chunk_id") if mode == "hybrid" else ranking.keyword_documents(keyword, chunks, n)
        best = ranking.best_chunk(hits).select("query_id", "doc_id", F.col("chunk_id").alias("best_chunk_id"))
        shown = docs.join(best, ["query_id", "doc_id"], "left")
        shown = ranking.with_chunk_counts(shown, self.documents)
        parts = self.chunks.select(F.col("chunk_id").alias("best_chunk_id"), F.col("content").alias("best_chunk"), F.get("section", 0).alias("section"), F.get("page_numbers", 0).alias("page"))
        shown = parts.join(F.broadcast(shown), "best_chunk_id", "right")
        if self.metadata is not None:
            shown = shown.join(self.metadata.select("doc_id", "title"), "doc_id", "left")
        return shown.orderBy("query_id", "rank")

    def search_chunks(self, queries: list[str], k: int = 5, *, document_ids: list | None = None, equations: bool | None = None) -> DataFrame:
        where = self._where(equations, None, document_ids)
        hits = vector_search.search(self.chunks, self._asked(queries).select("query_id", "vector"), min(k, vector_search.CHUNK_CAP), metric=self.metric, where=where)
        return hits.join(self.chunks.select("chunk_id", "content", "page_numbers"), "chunk_id").orderBy("query_id", "rank")

    def search_within(self, query: str, doc_id, k: int = 5) -> DataFrame:
        return self.search_chunks([query], k, document_ids=[doc_id])

    def similar_chunks(self, chunk_id: str, n: int = 5, *, other_documents: bool = True) -> DataFrame:
        return vector_search.similar_chunks(self.chunks, chunk_id, n, other_documents=other_documents, metric=self.metric)

    def read(self, doc_id, first: int, last: int) -> DataFrame:
        return chunk_range(self.chunks, doc_id, first, last)

    def document(self, doc_id) -> DataFrame:
        row = self.documents.filter(F.col("doc_id") == doc_id)
        return row if self.metadata is None else row.join(self.metadata, "doc_id", "left")

    def status(self) -> DataFrame:
        return equation_share(self.chunks).crossJoin(F.broadcast(self.documents.agg(F.count(F.lit(1)).alias("documents"))))
