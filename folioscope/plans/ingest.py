"""From scanned files to catalog tables: new, duplicate and failed files, sightings, log, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.names import canonical_dir, exit_code, safe_filename
from folioscope.operators.dml import append_log, insert_new, upsert, upsert_sightings
from folioscope.operators.reconcile import ingest_classes, merge_metadata, to_resolve
from folioscope.sources.sinks import bib_entries


def ingest(scan: DataFrame, files: DataFrame, sightings: DataFrame, log: DataFrame, machine: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(path, length, content_sha256) and the old tables -> new files, sightings, log, and a summary row.

    Doing it again adds no file and marks every path as a duplicate."""
    at = F.lit(now).cast("timestamp")
    classed = ingest_classes(scan, files.select("content_sha256"))
    name = F.element_at(F.split("path", "/"), -1)
    fresh = classed.filter("outcome = 'new'").select("content_sha256", F.concat_ws("/", canonical_dir(F.col("content_sha256")), safe_filename(name)).alias("canonical_path"), safe_filename(name).alias("display_name"), name.alias("original_filename"), F.lit(None).cast("int").alias("page_count"), F.col("length").alias("file_size_bytes"), at.alias("ingested_at"))
    seen = classed.filter("outcome <> 'failed'").select("content_sha256", F.col("path").alias("source_path"), F.lit(machine).alias("machine_id"), at.alias("first_seen"), at.alias("last_seen"))
    logged = classed.select(F.lit(None).cast("long").alias("log_id"), "content_sha256", F.col("outcome").alias("action"), F.col("path").alias("source_path"), F.lit(None).cast("string").alias("detail"), at.alias("timestamp"))
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    summary = classed.agg(F.count(F.lit(1)).alias("scanned"), count("new"), count("duplicate"), count("failed")).withColumn("exit_code", exit_code(F.col("failed")))
    return insert_new(files, fresh, ["content_sha256"]), upsert_sightings(sightings, seen), append_log(log, logged), summary


def enrich(files: DataFrame, sources: DataFrame, resolved: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Merge the metadata of files that have none yet; returns the resolved table and the new entries."""
    wanted = to_resolve(files.select("content_sha256"), resolved)
    merged = merge_metadata(sources.join(wanted, "content_sha256", "left_semi")).withColumn("resolution_method", F.lit("rules")).withColumn("resolved_at", F.lit(now).cast("timestamp"))
    return upsert(resolved, merged, ["content_sha256"], "resolved_at"), bib_entries(merged)
