"""Exact vector search: a scan with filters before the top-k, for one query or many.

Queries are few and stated; they are sent to the scan in blocks of about QUERY_BLOCK rows, whose size is
therefore bounded, and every task keeps its k best a query before anything is shuffled.

Of more than FEW queries a task first takes products of matrices with its rows: all pairs are compared, but only a
pair that its own rounding leaves a chance to be among the task's k nearest gets its distance from the built-ins.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioscope.functions.vectors import DISTANCES, as_doubles, norm, similarity
from folioscope.operators.ranking import GROUP_LIMIT, top_k
from folioscope.sources.places import written

QUERY_BLOCK, WIDE_FETCH, CHUNK_CAP = 1_000, 10_000, 100
#: Queries that are compared by built-ins alone, and rows of one product.
FEW, PRODUCT_ROWS = 16, 2_048
#: Squared lengths within which the bounds of rounding hold.
LEAST, MOST = 1e-200, 1e200


def _plain(square, metric: str):
    """Whether vectors of these squared lengths have a distance that a product comes near to."""
    return (square < MOST) & ((square > LEAST) | (metric != "cosine"))


def _spare(x: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Rows before which k rows of the same vector come by id."""
    out = np.zeros(len(x), bool)
    # equal rows have equal sums
    _, group, n = np.unique(x.sum(1), return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[group] > k)
    if len(some):
        some = some[pc.sort_indices(ids.take(pa.array(some))).to_numpy()]
        whole = np.ascontiguousarray(x[some]).view(f"V{x.shape[1] * 8}").ravel()
        group = np.unique(whole, return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        out[some[order[place >= k]]] = True
    return out


def _candidates(q: np.ndarray, k: int, metric: str, digits: int):
    """Batches of (chunk_id, doc_id, v) -> (place in q, chunk_id, doc_id, v) of the pairs that can be among the k
    nearest of the query, nothing held but each query's k-th distance so far."""
    width = q.shape[1]
    # bound of the rounding of both the product and the built-ins, of the squared lengths; two distances that are
    # the same when rounded lie less than a step apart
    room, step = 8 * (width + 8) * 2.0**-53, 1.01 * 10.0**-digits
    square = (q**2).sum(1)
    if metric == "cosine":
        q, square = q / np.sqrt(square)[:, None], np.ones(len(q))

    def pairs(b: pa.RecordBatch, at: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), *b.take(pa.array(row)).columns], names=["place", *b.schema.names])

    def run(batches):
        best = np.full((len(q), k), np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            there = pc.fill_null(pc.equal(pc.list_value_length(v), width), False)
            x = np.full((b.num_rows, width), np.nan)
            has = there.to_numpy(zero_copy_only=False)
            x[has] = v.filter(there).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            with np.errstate(over="ignore", invalid="ignore"):
                squares = (x**2).sum(1)
                good = np.flatnonzero(_plain(squares, metric))
            good = good[~_spare(x[good], b.column("chunk_id").take(pa.array(good)), k)]
            for low in range(0, len(good), PRODUCT_ROWS):
                rows = good[low : low + PRODUCT_ROWS]
                if metric == "cosine":
                    d = 1 - q @ (x[rows] / np.sqrt(squares[rows])[:, None]).T
                    margin = np.full(len(q), 2 * room)
                else:
                    d = square[:, None] + squares[rows] - 2 * q @ x[rows].T
                    margin = room * (square + squares[rows].max())
                nearer = np.flatnonzero(d.min(1) + margin < best.max(1))
                both = np.concatenate([best[nearer], d[nearer] + margin[nearer, None]], 1)
                best[nearer] = np.partition(both, k - 1, 1)[:, :k]
                at, j = np.nonzero(d <= (best.max(1) + margin + step)[:, None])
                if len(at):
                    yield pairs(b, at, rows[j])
            short = np.flatnonzero(np.isinf(best.max(1)))
            if len(short):  # rows without a distance, which come last, by id
                bare = np.flatnonzero(~has)
                bare = bare[pc.sort_indices(b.column("chunk_id").take(pa.array(bare))).to_numpy()[:k]]
                last = np.concatenate([bare, np.flatnonzero(has & ~_plain(squares, metric))])
                for at in short if len(last) else ():
                    yield pairs(b, np.full(len(last), at), last)

    return run


def _pairs(pool: DataFrame, ask: DataFrame, k: int, metric: str, digits: int) -> DataFrame:
    """Rows with the queries of a block that they can be among the k nearest of (all rows, if a query has no length)."""
    spark = pool.sparkSession
    rows = ask.collect()  # a block
    width = Counter(len(r.q or ()) for r in rows).most_common(1)[0][0] if rows else 0
    usable = [len(r.q or ()) == width > 0 and None not in r.q for r in rows]
    with np.errstate(over="ignore", invalid="ignore"):
        usable = [u and bool(_plain((np.array(r.q) ** 2).sum(), metric)) for u, r in zip(usable, rows)]
    plain, odd = [r for r, u in zip(rows, usable) if u], [r for r, u in zip(rows, usable) if not u]
    out = pool.crossJoin(F.broadcast(spark.createDataFrame(odd, ask.schema))) if odd else None
    if plain:
        schema = StructType([StructField("place", IntegerType()), *pool.schema.fields])
        near = pool.mapInArrow(_candidates(np.array([r.q for r in plain], float), k, metric, digits), schema)
        sent = spark.createDataFrame([(i, *r) for i, r in enumerate(plain)], StructType([StructField("place", IntegerType()), *ask.schema.fields]))
        near = near.join(F.broadcast(sent), "place").drop("place")
        out = near if out is None else near.unionByName(out)
    return pool.crossJoin(F.broadcast(ask)) if out is None else out


def _search_block(chunks: DataFrame, queries: DataFrame, k: int, many: bool, *, metric: str = "cosine", where: Column | None = None, digits: int = 9) -> DataFrame:
    pool = chunks if where is None else chunks.filter(where)
    pool = pool.select("chunk_id", "doc_id", as_doubles(F.col("embedding")).alias("v"))
    ask = queries.select("query_id", as_doubles(F.col("vector")).alias("q"))
    if metric == "cosine":
        distance = DISTANCES[metric](F.col("q"), F.col("v"), F.col("qn"), F.col("vn"))
        pool, ask = pool.withColumn("vn", norm(F.col("v"))), ask.withColumn("qn", norm(F.col("q")))
    else:
        distance = DISTANCES[metric](F.col("q"), F.col("v"))
    pairs = _pairs(pool, ask, k, metric, digits) if many and k <= GROUP_LIMIT else pool.crossJoin(F.broadcast(ask))
    scored = pairs.select("query_id", "chunk_id", "doc_id", F.round(distance, digits).alias("distance"))
    # without a vector there is no distance; such chunks come last
    ranked = top_k(scored.withColumn("far", F.coalesce("distance", F.lit(float("inf")))), k, ("far", False), ("chunk_id", False))
    return ranked.select("query_id", "chunk_id", "doc_id", "distance", similarity(F.col("distance")).alias("similarity"), "rank")


def search(chunks: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """query_id, chunk_id, doc_id, distance, similarity, rank (from 0) of the k nearest chunks.

    chunks: (chunk_id, doc_id, embedding, ...), queries: (query_id, vector), of any number: each block
    of queries is one broadcast, and of several each one's rows are written. Filters (where=) come first."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        return _search_block(chunks, queries, k, n > FEW, **options)
    blocks = -(-n // QUERY_BLOCK) * 2
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    return reduce(DataFrame.union, (written(_search_block(chunks, dealt.filter(F.col("_block") == i).drop("_block"), k, n > FEW, **options), "search-block") for i in range(blocks)))


def chunk_search(chunks: DataFrame, queries: DataFrame, k: int = 5, *, document_ids: list | None = None, where: Column | None = None, metric: str = "cosine") -> DataFrame:
    """Up to CHUNK_CAP chunks a query, of the given documents if any are given."""
    if document_ids is not None:
        mine = F.col("doc_id").isin(document_ids)
        where = mine if where is None else where & mine
    return search(chunks, queries, min(k, CHUNK_CAP), metric=metric, where=where)


def similar_chunks(chunks: DataFrame, chunk_id, n: int = 5, *, other_documents: bool = True, metric: str = "cosine") -> DataFrame:
    """Neighbours of a stored chunk's vector, itself left out, and its document's chunks too."""
    ref = chunks.filter(F.col("chunk_id") == chunk_id).select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector"), F.col("doc_id").alias("ref_doc")).limit(1)
    pool = chunks.filter(F.col("chunk_id") != chunk_id)
    if other_documents:
        pool = pool.join(F.broadcast(ref.select("ref_doc")), F.col("doc_id") == F.col("ref_doc"), "left_anti")
    return search(pool, ref, n, metric=metric)
