"""Inserts, upserts, updates and deletes as plans over immutable tables: old table in, new table out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.sources.places import work_path


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not there yet are added (the first of equals by all columns); others are left out."""
    fresh = rows.join(table.select(*key), key, "left_anti")
    one = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in rows.columns if c not in key] or key))).filter("_n = 1").drop("_n")
    return table.unionByName(one, allowMissingColumns=True)


def insert_strict(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """As insert_new, but a key that is there, or comes twice, is an error."""
    twice = rows.groupBy(*key).count().filter("count > 1").select(*key)
    if not rows.join(table.select(*key), key, "left_semi").select(*key).union(twice).isEmpty():
        raise ValueError(f"a key of {key} is there already")
    return table.unionByName(rows, allowMissingColumns=True)


def inserted_flags(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows with whether an insert would take them."""
    there = table.select(*key).distinct().withColumn("_there", F.lit(True))
    return rows.join(there, key, "left").withColumn("inserted", F.col("_there").isNull()).drop("_there")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key by `order`; of equals the new one."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", "_new")


def upsert_sightings(table: DataFrame, rows: DataFrame) -> DataFrame:
    """First and last time that a file was seen at a place; pre-aggregated, so hot files do no harm."""
    key = ["content_sha256", "source_path", "machine_id"]
    return table.unionByName(rows).groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def replace_chunks(table: DataFrame, rows: DataFrame) -> DataFrame:
    """All chunks of the given documents are replaced, so that none of an older version is left."""
    return table.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows, allowMissingColumns=True)


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(table: DataFrame, delta: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns of the rows that delta names take delta's values."""
    new = delta.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = table.join(new, key, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their places from 1 by order: dealt by range, numbered in each task, and the tasks'
    counts added up (one row a task), so that no task holds all rows."""
    spark, path = rows.sparkSession, work_path(rows.sparkSession, "numbered")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", place).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return dealt.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_place") + 1).select(*rows.columns, name)


def append_log(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Log rows with the next numbers, in the order of their time."""
    last = table.agg(F.coalesce(F.max("log_id"), F.lit(0)).alias("_last"))
    fresh = numbered(rows.drop("log_id"), ["timestamp", "content_sha256", "action"], "_n").crossJoin(F.broadcast(last))
    return table.unionByName(fresh.withColumn("log_id", (F.col("_last") + F.col("_n")).cast("long")).drop("_n", "_last"))


def set_decisions(decisions: DataFrame, history: DataFrame, rows: DataFrame, domain: list[str]) -> tuple[DataFrame, DataFrame]:
    """New decisions, and history rows for those that are new or differ from the one before."""
    if not rows.filter(~F.col("decision").isin(domain) | F.col("decision").isNull()).isEmpty():
        raise ValueError(f"a decision is none of {domain}")
    changes = decision_changes(decisions.select("content_sha256", "decision", "decided_at").unionByName(rows.select("content_sha256", "decision", "decided_at")))
    fresh = changes.join(rows.select("content_sha256", F.col("decided_at").alias("changed_at")), ["content_sha256", "changed_at"], "left_semi")
    return upsert(decisions, rows, ["content_sha256"], "decided_at"), history.unionByName(fresh, allowMissingColumns=True)


def decision_changes(decisions: DataFrame) -> DataFrame:
    """content_sha256, old_decision, new_decision, changed_at of every decision unlike the one before."""
    before = F.lag("decision").over(Window.partitionBy("content_sha256").orderBy("decided_at"))
    out = decisions.select("content_sha256", before.alias("old_decision"), F.col("decision").alias("new_decision"), F.col("decided_at").alias("changed_at"))
    return out.filter(~F.col("old_decision").eqNullSafe(F.col("new_decision")))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """What is left; rows for which the condition is unknown stay."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_counts(table: DataFrame, condition: Column) -> DataFrame:
    return table.agg(F.count_if(condition).alias("deleted"), F.count_if(~F.coalesce(condition, F.lit(False))).alias("kept"))


def cascade_delete(documents: DataFrame, extractions: DataFrame, embeddings: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with the given content hashes go, with their extractions and embeddings."""
    gone = documents.join(hashes.select(F.col("content_hash")), "content_hash", "left_semi").select("doc_id")
    return tuple(t.join(gone, "doc_id", "left_anti") for t in (documents, extractions, embeddings))


def remove_from_catalog(tables: dict[str, DataFrame], hashes: DataFrame) -> dict[str, DataFrame]:
    """Every catalog table without the given files."""
    return {name: t.join(hashes.select("content_sha256"), "content_sha256", "left_anti") for name, t in tables.items()}


def renamed(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks with their document's current display name, and whether that is a change."""
    names = catalog.select(F.col("content_sha256").alias("doc_id"), "display_name")
    out = chunks.join(names, "doc_id", "left")
    differs = F.col("display_name").isNotNull() & ~F.col("pdf_name").eqNullSafe(F.col("display_name"))
    return out.withColumn("changed", differs).withColumn("pdf_name", F.coalesce("display_name", "pdf_name")).drop("display_name")


def index_gaps(chunks: DataFrame) -> DataFrame:
    """Documents whose chunk numbers are not 0, 1, 2, ... without repeats."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.count_distinct("chunk_index").alias("distinct"))
    bad = (F.col("first") != 0) | (F.col("last") + 1 != F.col("chunks")) | (F.col("distinct") != F.col("chunks"))
    return n.withColumn("has_gap", bad)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
