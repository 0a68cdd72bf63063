"""From ranked chunks to ranked documents: pooling, fusion, statistics, display chunks.

Chunk hits are (query_id, chunk_id, doc_id, similarity, rank), ranks from 0. Ties are decided by
ids, never by arrival.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
#: Ranks up to which Spark keeps the best rows of a task before it shuffles them; beyond it a task does it here.
GROUP_LIMIT, HELD_ROWS = 1_000, 200_000


def _best_of_task(k: int, by: str, order: tuple[tuple[str, bool], ...]):
    """Rows of a task that can be among the k best of their group."""

    def pruned(table: pa.Table) -> pa.Table:
        table = table.sort_by([(by, "ascending"), *[(c, "descending" if down else "ascending") for c, down in order]])
        group = table.column(by).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        return table.filter(pa.array(place < k))

    def run(batches):
        held, rows, least = [], 0, HELD_ROWS
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows > least:
                kept = pruned(pa.Table.from_batches(held))
                held, rows = kept.to_batches(), kept.num_rows
                least = max(HELD_ROWS, 2 * rows)
        if held:
            yield from pruned(pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)

    return run


def top_k(scored: DataFrame, k: int, *order: tuple[str, bool], by: str = "query_id") -> DataFrame:
    """The k best rows of each group with their rank from 0, by columns (name, descending) without nulls
    whose last one is unique. A task hands at most k rows of a group to the shuffle."""
    if k > GROUP_LIMIT:
        scored = scored.mapInArrow(_best_of_task(k, by, order), scored.schema)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]))
    # the filter on the number itself is what lets Spark cut each task's rows
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _named() -> Column:
    return F.col("doc_id").isNotNull() & (F.col("doc_id").cast("string") != "")


def _ranked(scored: DataFrame, *order: Column, n: int | None = None) -> DataFrame:
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "doc_id")))
    return (out if n is None else out.filter(F.col("rank") <= n)).withColumn("rank", F.col("rank") - 1)


def by_similarity(hits: DataFrame, n: int | None = None) -> DataFrame:
    """query_id, doc_id, score (best chunk's similarity), matching_chunks, rank."""
    pooled = hits.filter(_named()).groupBy("query_id", "doc_id").agg(F.greatest(F.lit(0.0), F.max("similarity")).alias("score"), F.count(F.lit(1)).alias("matching_chunks"))
    return _ranked(pooled, F.desc("score"), n=n)


def by_relevance(hits: DataFrame, threshold: float, n: int | None = None) -> DataFrame:
    """query_id, doc_id, score (chunks at or over the threshold), best, rank; documents without stay."""
    hit = (F.col("similarity") >= threshold).cast("int")
    pooled = hits.filter(_named()).groupBy("query_id", "doc_id").agg(F.sum(hit).cast("double").alias("score"), F.max("similarity").alias("best"))
    return _ranked(pooled, F.desc("score"), F.desc("best"), n=n)


METRICS = {"similarity": lambda hits, threshold, n: by_similarity(hits, n), "relevance": by_relevance}


def best_chunk(hits: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_id, similarity of each document's most similar chunk (the first of equals)."""
    best = F.max_by(F.struct("chunk_id", "similarity"), F.struct("similarity", -F.col("rank")))
    return hits.filter(_named()).groupBy("query_id", "doc_id").agg(best.alias("b")).select("query_id", "doc_id", "b.*")


def fetch_statistics(hits: DataFrame, threshold: float) -> DataFrame:
    over = F.col("similarity") >= threshold
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_fetched"), F.count_if(over).alias("chunks_above"), F.count_distinct(F.when(over & _named(), F.col("doc_id"))).alias("documents_found"), F.lit(1).alias("iterations"))


def fuse(semantic: DataFrame, keyword: DataFrame, n_candidates: int = 200, k: int = RRF_K, bm25_only: str = "drop") -> DataFrame:
    """Reciprocal rank fusion of two rankings of chunks; a missing rank counts n_candidates + 1.

    semantic: (query_id, chunk_id, doc_id, similarity, rank); keyword: (query_id, chunk_id, rank). Chunks
    that only the keyword ranking has carry no document and are dropped, or kept with "keep".
    """
    s = semantic.select("query_id", "chunk_id", "doc_id", "similarity", F.col("rank").alias("rank_semantic"))
    b = keyword.select("query_id", "chunk_id", F.col("rank").alias("rank_bm25"))
    both = s.join(b, ["query_id", "chunk_id"], "full_outer" if bm25_only == "keep" else "left")
    term = lambda c: 1 / (k + F.coalesce(F.col(c), F.lit(n_candidates + 1)))
    return both.withColumn("rrf_score", term("rank_semantic") + term("rank_bm25"))


def fused_documents(fused: DataFrame, n: int | None = None, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score (best chunk's), matching_chunks, chunk_id of that chunk, rank."""
    best = F.max_by("chunk_id", F.struct(F.round("rrf_score", digits), -F.coalesce(F.col("rank_semantic"), F.lit(1 << 30))))
    pooled = fused.filter(F.col("doc_id").isNotNull()).groupBy("query_id", "doc_id").agg(F.round(F.max("rrf_score"), digits).alias("score"), F.count(F.lit(1)).alias("matching_chunks"), best.alias("chunk_id"))
    return _ranked(pooled, F.desc("score"), n=n)


def keyword_documents(keyword: DataFrame, chunk_docs: DataFrame, n: int | None = None) -> DataFrame:
    """query_id, doc_id, score (best chunk's), matching_chunks, rank of documents that keywords find.

    chunk_docs (chunk_id, doc_id) says whose the chunks are; give the semantic candidates to keep only theirs.
    """
    pooled = keyword.join(chunk_docs.select("chunk_id", "doc_id"), "chunk_id").filter(_named()).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("matching_chunks"))
    return _ranked(pooled, F.desc("score"), n=n)


def with_chunk_counts(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Ranked documents with their number of chunks in all (null where unknown)."""
    return docs.join(registry.select("doc_id", F.nullif(F.col("chunk_count"), F.lit(0)).alias("chunk_count")), "doc_id", "left")
