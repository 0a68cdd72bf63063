"""Questions to the catalog: joins, counts, lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_LINKS, DONE_LINKS = ["failed", "pending"], ["imported", "pre-existing"]


def unlinked(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files without a link, or with one that failed or waits, in the order of their hashes."""
    state = links.select("content_sha256", "status", F.lit(True).alias("_linked"))
    out = files.join(state, "content_sha256", "left").filter(F.col("_linked").isNull() | F.col("status").isin(OPEN_LINKS))
    return out.drop("_linked").orderBy("content_sha256")


def unresolved(files: DataFrame, resolved: DataFrame) -> DataFrame:
    return files.join(resolved.select("content_sha256"), "content_sha256", "left_anti").select("content_sha256").orderBy("content_sha256")


def linked_count(files: DataFrame, links: DataFrame) -> DataFrame:
    done = links.filter(F.col("status").isin(DONE_LINKS))
    return files.join(done.select("content_sha256"), "content_sha256").agg(F.count(F.lit(1)).alias("linked"))


def recent_files(files: DataFrame, resolved: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The newest files with their metadata; of equal times the one that came later."""
    meta = resolved.select("content_sha256", "title", "authors", "year")
    return files.join(meta, "content_sha256", "left").orderBy(F.desc("ingested_at"), F.desc(seq)).limit(max(1, n))


def statistics(files: DataFrame, sightings: DataFrame, links: DataFrame, log: DataFrame) -> DataFrame:
    """One row of table sizes and the number of unlinked files."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(files, "canonical_files")
    for df, name in ((sightings, "source_sightings"), (links, "zotero_links"), (log, "ingest_log"), (unlinked(files, links), "unlinked")):
        out = out.crossJoin(F.broadcast(count(df, name)))
    return out


def stored_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"))


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def status_pivot(documents: DataFrame, states: list[str], project: str = "project_id", status: str = "status") -> DataFrame:
    """Per project the number of documents in each state (the domain is given, so one pass is enough)."""
    return documents.groupBy(project).agg(*[F.count_if(F.col(status) == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def conditional_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("approved", "rejected")], F.count(F.lit(1)).alias("total"))


def latest_per_key(rows: DataFrame, key: list[str], order: str, tie: str) -> DataFrame:
    """The newest row of each key; one pass of pre-aggregation, no sort of groups."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(order, tie))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def recent_log(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("log_id")).limit(max(1, n))


def chunk_range(chunks: DataFrame, doc_id, first: int, last: int) -> DataFrame:
    return chunks.filter((F.col("doc_id") == doc_id) & F.col("chunk_index").between(first, last)).orderBy("chunk_index")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))


def target_filter(target: str) -> Column:
    """What a removal target means: a full hash, six or more digits of one, else a piece of the name
    (in which % and _ stand for any text and any character)."""
    if re.fullmatch("[0-9a-fA-F]{64}", target):
        return F.col("content_sha256") == target.lower()
    if re.fullmatch("[0-9a-fA-F]{6,}", target):
        return F.startswith(F.col("content_sha256"), F.lit(target.lower()))
    return F.col("display_name").ilike(f"%{target}%")


def subset(documents: DataFrame, *, status: str | None = None, date_from=None, date_to=None, name_contains: str | None = None, size_range: tuple | None = None, sort_by: str = "added_date", descending: bool = True, limit: int | None = None) -> DataFrame:
    """Documents that meet all given criteria; the size counts only if both its bounds are given."""
    if sort_by not in ("added_date", "filename"):
        raise ValueError(f"sort_by is added_date or filename, not {sort_by}")
    tests = [None if status is None else F.col("status") == status, None if date_from is None else F.col("added_date") >= F.lit(date_from), None if date_to is None else F.col("added_date") <= F.lit(date_to)]
    if name_contains:
        tests.append(F.contains(F.lower("filename"), F.lit(name_contains.lower())))
    if size_range and None not in size_range:
        tests.append(F.col("file_size_bytes").between(*size_range))
    for t in tests:
        documents = documents if t is None else documents.filter(t)
    by = F.desc(sort_by) if descending else F.asc(sort_by)
    out = documents.orderBy(by, "doc_id")
    return out if limit is None else out.limit(limit)


def equation_share(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.round(100 * F.avg(F.col("has_equations").cast("int")), 1).alias("equation_percentage"))


#: Values up to which a list is a filter; longer ones are joined.
LIST_FILTER = 1_000


def lookup(table: DataFrame, column: str, values: list, order: str | None = None) -> DataFrame:
    """Rows whose column is one of the values (none for an empty list), newest first if an order is given."""
    if len(values) <= LIST_FILTER:
        out = table.filter(F.col(column).isin(values)) if values else table.limit(0)
    else:
        kind = table.schema[column].dataType.simpleString()
        wanted = table.sparkSession.createDataFrame([(v,) for v in set(values)], f"{column} {kind}")
        out = table.join(wanted, column, "left_semi")
    return out if order is None else out.orderBy(F.desc(order))


def exists(table: DataFrame, condition: Column) -> bool:
    """Whether any row meets the condition; reading stops at the first."""
    return not table.filter(condition).limit(1).isEmpty()


def approved(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("decision") == "approved").orderBy(F.desc("decided_at"), "content_sha256")


def decision_log(history: DataFrame, decision: str | None = None, limit: int = 500) -> DataFrame:
    rows = history if decision is None else history.filter(F.col("new_decision") == decision)
    return rows.orderBy(F.desc("changed_at"), F.desc("id")).limit(limit)
