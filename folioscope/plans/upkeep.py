"""Keeping a library: removal over all stores, reconciling and its application, migration, backfill, details.

Tables are immutable: each program gives new tables, which the caller writes as a new version.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.catalog import target_filter
from folioscope.operators.dml import index_gaps


@dataclass
class Removal:
    """status: removed, not found, or ambiguous (then nothing is removed and matches lists the files)."""

    status: str
    matches: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    counts: DataFrame | None = None


def remove_document(files: DataFrame, target: str, stores: dict[str, tuple[DataFrame, str]]) -> Removal:
    """Remove one file from every store: name -> (table, the column that holds the file's hash).

    files: (content_sha256, display_name, ...). A target that means several files removes none."""
    matches = files.filter(target_filter(target)).dropDuplicates(["content_sha256"])
    found = matches.select("content_sha256").limit(2).collect()
    if len(found) != 1:
        return Removal("ambiguous" if found else "not found", matches.orderBy("content_sha256"))
    own = found[0].content_sha256
    is_own = {name: F.coalesce(F.col(key) == own, F.lit(False)) for name, (_, key) in stores.items()}
    tables = {name: df.filter(~is_own[name]) for name, (df, _) in stores.items()}
    counts = None
    for name, (df, _) in stores.items():
        one = df.agg(F.lit(name).alias("store"), F.count_if(is_own[name]).alias("removed"))
        counts = one if counts is None else counts.unionByName(one)
    return Removal("removed", matches, tables, counts)


def reconcile_actions(found: DataFrame, stored: DataFrame, linked: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """content_sha256, path, action: what makes scans, store and library agree.

    store: found on disk, not stored (the least path is taken); fetch: only the library has it, and it is
    not known to be missing there; link: stored (or to be), not in the library. Empty once applied."""
    held, other = stored.select("content_sha256").distinct(), linked.select("content_sha256").distinct()
    store = found.groupBy("content_sha256").agg(F.min("path").alias("path")).join(held, "content_sha256", "left_anti")
    fetch = other.join(held, "content_sha256", "left_anti").join(store, "content_sha256", "left_anti")
    if missing is not None:
        fetch = fetch.join(missing.select("content_sha256"), "content_sha256", "left_anti")
    link = held.union(store.select("content_sha256")).join(other, "content_sha256", "left_anti")
    none = F.lit(None).cast("string").alias("path")
    rows = store.select("content_sha256", "path", F.lit("store").alias("action"))
    rows = rows.union(fetch.select("content_sha256", none, F.lit("fetch")))
    return rows.union(link.select("content_sha256", none, F.lit("link")))


def apply_actions(actions: DataFrame, stored: DataFrame, linked: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored and linked files after the actions that did not fail (failed: content_sha256, action)."""
    done = actions if failed is None else actions.join(failed.select("content_sha256", "action"), ["content_sha256", "action"], "left_anti")
    gained = lambda *kinds: done.filter(F.col("action").isin(*kinds)).select("content_sha256")
    return stored.select("content_sha256").union(gained("store", "fetch")).distinct(), linked.select("content_sha256").union(gained("link")).distinct()


def migrated_extractions(extractions: DataFrame, documents: DataFrame, files: DataFrame, existing: DataFrame, extractor: str) -> DataFrame:
    """content_sha256, path of an extractor's texts to copy: of documents whose file the catalog has and
    that have none yet; of several the newest (by path)."""
    own = extractions.filter(F.col("extractor") == extractor).join(documents.select("doc_id", "content_sha256"), "doc_id")
    own = own.join(files.select("content_sha256"), "content_sha256", "left_semi").join(existing.select("content_sha256"), "content_sha256", "left_anti")
    return own.groupBy("content_sha256").agg(F.max("path").alias("path"))


def backfilled_chunks(vectors: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk rows that only the vector store has are added (doc_id, chunk_index, content); second the
    documents whose numbers then have gaps."""
    rows = vectors.select("doc_id", "chunk_index", "content").dropDuplicates(["doc_id", "chunk_index"])
    whole = chunks.select("doc_id", "chunk_index", "content").unionByName(rows.join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti"))
    return whole, index_gaps(whole).filter("has_gap")


def document_details(files: DataFrame, resolved: DataFrame, chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each file with its title and year, its number of chunks and its newest extraction, null where there is none."""
    n = chunks.groupBy(F.col("doc_id").alias("content_sha256")).agg(F.count(F.lit(1)).alias("chunk_count"))
    newest = extractions.groupBy("content_sha256").agg(F.max("path").alias("extraction_path"))
    out = files
    for part in (resolved.select("content_sha256", "title", "year"), n, newest):
        out = out.join(part, "content_sha256", "left")
    return out


def listed_experiments(experiments: DataFrame, project: str | None = None) -> DataFrame:
    """Experiments (of a project), newest first."""
    own = experiments if project is None else experiments.filter(F.col("project_id") == project)
    return own.orderBy(F.desc("created_date"), "experiment_id")


def comparison_summary(values: DataFrame, metric: str) -> DataFrame:
    """Experiments by a metric's value, the best first; those without a value come last."""
    return values.filter(F.col("metric") == metric).orderBy(F.desc_nulls_last("value"), "experiment_id")


def metadata_sources(sources: DataFrame, content_sha256: str) -> DataFrame:
    return sources.filter(F.col("content_sha256") == content_sha256).orderBy("extractor_name")
