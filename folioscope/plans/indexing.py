"""From documents to a searchable store: chunks, vectors, keyword index, document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import equation_counts, page_references
from folioscope.operators import bm25
from folioscope.operators.chunking import section_chunks
from folioscope.operators.dml import replace_chunks
from folioscope.operators.hooks import embed
from folioscope.sources.sinks import embedded_rows

CHUNK_COLUMNS = ["chunk_id", "doc_id", "chunk_index", "content", "section", "page_numbers", "has_equations", "display_eq_count", "inline_eq_count", "embedding"]


def chunk_documents(docs: DataFrame, embedder: str = "hashing", *, most: int = 3000, least: int = 200, shortest: int = 50) -> DataFrame:
    """(doc_id, content) -> chunk rows with stable ids, sections, pages, equations and vectors.

    Chunks under `shortest` characters are left out."""
    chunks = section_chunks(docs, most=most, least=least).filter(F.length(F.trim("content")) >= shortest)
    chunks = chunks.select("*", page_references(F.col("content")).alias("page_numbers"), equation_counts(F.col("content")).alias("e")).select("doc_id", "chunk_index", "content", "section", "page_numbers", "e.*")
    return embed(embedded_rows(chunks), embedder).select(*CHUNK_COLUMNS)


def index_documents(spark: SparkSession, docs: DataFrame, store: str, embedder: str = "hashing", *, previous: str | None = None, force: bool = False, **sizes) -> DataFrame:
    """Write a new store (chunks, keyword index, documents) under `store`.

    With a previous store only documents that it lacks are read (all of them with force); the new
    store holds both, and no chunks of an older version of a document. Returns the document rows."""
    old = spark.read.parquet(f"{previous}/chunks") if previous else None
    if old is not None and not force:
        docs = docs.join(old.select("doc_id").distinct(), "doc_id", "left_anti")
    fresh = chunk_documents(docs, embedder, **sizes)
    chunks = fresh if old is None else replace_chunks(old, fresh)
    chunks.write.parquet(f"{store}/chunks")
    written = spark.read.parquet(f"{store}/chunks")
    bm25.build(written, path=f"{store}/bm25")
    rows = written.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count")).withColumn("status", F.lit("extracted"))
    rows.write.parquet(f"{store}/documents")
    return spark.read.parquet(f"{store}/documents")
