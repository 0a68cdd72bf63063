"""Okapi BM25 over a written postings table; k1 1.5, b 0.75, negative idf floored at a quarter of the mean."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import tokens, word_counts
from folioscope.operators.ranking import top_k
from folioscope.sources.places import remove, work_path

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words of queries that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Words that are named in a scan's filter, and postings that are sorted at once.
NAMED, RUN = 500, 500_000
_SCHEMAS = {"terms": "term string, df long, idf double", "corpus": "n long, avgdl double"}


@dataclass
class Bm25Index:
    """postings(term, chunk_id, seq, dl, tf), lengths(chunk_id, seq, dl), terms(term, df, idf), corpus(n, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> Bm25Index:
        return Bm25Index(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "terms", "corpus")])

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bm25Index | None:
        """The index at path, or None where there is none, or only a part of one."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/corpus/_SUCCESS")
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return Bm25Index.read(spark, path) if there else None


def by_term(batches):
    """Rows sorted by term in runs of about RUN."""
    held, rows = [], 0

    def run():
        yield from pa.Table.from_batches(held).sort_by("term").combine_chunks().to_batches(max_chunksize=20_000)

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= RUN:
            yield from run()
            held, rows = [], 0
    if rows:
        yield from run()


def wipe(spark: SparkSession, path: str) -> bool:
    """Remove a written index; whether there was one."""
    return remove(spark, path)


def build(chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "content", seq_col: str | None = None, path: str | None = None) -> Bm25Index:
    """Write the index of chunks under path (or a work folder) and read it back.

    seq_col gives the insertion order, which decides between equal scores (the id if not given). The
    chunks are read twice, for postings and lengths; all else comes from what is written. Words are counted
    where their text lies and postings sorted by term in runs of RUN, so that none is shuffled or spilled and
    a query reads few pages; corpus is written last and says that the index is whole."""
    spark = chunks.sparkSession
    path = path or work_path(spark, "bm25")
    own = chunks.select(F.col(id_col).alias("chunk_id"), F.col(seq_col or id_col).alias("seq"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    own = own.select("chunk_id", "seq", F.size("t").alias("dl"), "t")
    each = own.select("chunk_id", "seq", "dl", F.explode(word_counts(F.col("t"))).alias("w"))
    each = each.select("w.term", "chunk_id", "seq", "dl", F.col("w.tf").cast("long").alias("tf"))
    postings = each.mapInArrow(by_term, each.schema)
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    own.drop("t").write.mode("overwrite").parquet(f"{path}/lengths")
    postings, lengths = spark.read.schema(postings.schema).parquet(f"{path}/postings"), spark.read.schema(own.drop("t").schema).parquet(f"{path}/lengths")
    n, mean_length = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    raw = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = raw.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw.write.mode("overwrite").parquet(f"{path}/frequencies")
    raw = spark.read.schema(raw.schema).parquet(f"{path}/frequencies")
    floor = EPSILON * (raw.agg(F.avg("raw")).first()[0] or 0.0)
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(n, mean_length)], _SCHEMAS["corpus"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return Bm25Index(postings, lengths, *[spark.read.schema(_SCHEMAS[x]).parquet(f"{path}/{x}") for x in ("terms", "corpus")])


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, query) -> (query_id, term, qtf): repeated words count again."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scores(index: Bm25Index, queries: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, seq, score) of the chunks (of those named by `among`, if given) that share a
    word with the query."""
    asked = query_terms(queries)
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if few else (lambda df: df)
    words = [r.term for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
    named = (lambda df: df.filter(F.col("term").isin(words))) if len(words) <= NAMED else (lambda df: df)
    wanted = named(index.terms).join(sent(asked), "term")
    hits = named(index.postings).join(sent(wanted), "term")
    if among is not None:
        hits = hits.join(among.select("chunk_id"), "chunk_id", "left_semi")
    hits = hits.crossJoin(F.broadcast(index.corpus))  # one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id", "seq").agg(F.sum(part).alias("score"))


def search(index: Bm25Index, queries: DataFrame, n: int = 200, digits: int = 6, among: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank from 0, raw_score, score): the n best, scores over the best one's.

    `among` (chunk_id) says which chunks may be found; it is applied before the n best are taken, while
    word statistics stay those of the whole index. Chunks without a shared word score 0 and fill up the
    list in insertion order. Scores are rounded before they are ordered, so that ties are ties on every
    engine."""
    pool = index.lengths if among is None else index.lengths.join(among.select("chunk_id"), "chunk_id", "left_semi")
    scored = scores(index, queries, among).select("query_id", "chunk_id", "seq", F.round("score", digits).alias("s"))
    return with_fill(scored, pool, queries, n)


def with_fill(scored: DataFrame, pool: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The n best of (query_id, chunk_id, seq, s), lists filled up from the pool (chunk_id, seq) as in search."""
    fill = pool.orderBy("seq").limit(n).select("chunk_id", "seq").crossJoin(F.broadcast(queries.select("query_id")))
    both = scored.union(fill.select("query_id", "chunk_id", "seq", F.lit(0.0)))
    # a chunk that fills up and hits keeps its hit, below zero or not
    one = both.groupBy("query_id", "chunk_id", "seq").agg(F.coalesce(F.max(F.when(F.col("s") != 0, F.col("s"))), F.lit(0.0)).alias("s"))
    ranked = top_k(one, n, ("s", True), ("seq", False))
    top = F.max("s").over(Window.partitionBy("query_id"))
    return ranked.select("query_id", "chunk_id", "rank", F.col("s").alias("raw_score"), F.when(top > 0, F.col("s") / top).otherwise(0.0).alias("score"))
