"""Duplicates by content hash, merging of metadata sources, reconciling of stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sources in the order of their trust, and the fields that must be filled.
PRIORITY = ["grobid", "semantic_scholar", "doi_crossref", "arxiv", "xmp"]
FIELDS = ["title", "year", "journal", "abstract", "doc_type"]
TARGETS = ["title", "authors", "year", "abstract"]


def register(files: DataFrame, known: DataFrame | None = None, *, hash_col: str = "content_hash", seq: str = "seq") -> DataFrame:
    """Each file with the first file of its content (linked_to) and whether it is new: the first of its
    content, whose content is not known. Firsts come from a pre-aggregated minimum, not from sorted groups."""
    first = files.groupBy(hash_col).agg(F.min(F.struct(seq, "doc_id")).alias("f"))
    if known is None:
        first = first.withColumn("_known", F.lit(False))
    else:
        first = first.join(known.select(F.col(hash_col), F.lit(True).alias("_known")).distinct(), hash_col, "left")
    out = files.join(first, hash_col)
    is_first = (F.col(seq) == F.col(f"f.{seq}")) & (F.col("doc_id") == F.col("f.doc_id"))
    return out.select(*files.columns, F.col("f.doc_id").alias("linked_to"), (is_first & ~F.coalesce("_known", F.lit(False))).alias("is_new"))


def duplicate_groups(files: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    n = files.groupBy(hash_col).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return n.filter("copies > 1")


def ingest_classes(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Scanned files as new, duplicate or failed: empty files fail, the first path of new content is new."""
    ok = scan.filter(F.coalesce("length", F.lit(0)) > 0)
    first = ok.groupBy("content_sha256").agg(F.min("path").alias("first_path"))
    out = scan.join(first, "content_sha256", "left").join(stored.select("content_sha256", F.lit(True).alias("_stored")).distinct(), "content_sha256", "left")
    kind = F.when(F.coalesce("length", F.lit(0)) == 0, "failed").when(F.col("_stored") | (F.col("path") != F.col("first_path")), "duplicate").otherwise("new")
    return out.select(*scan.columns, kind.alias("outcome"))


def _trust(source: Column, priority: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(p) for p in priority]), source)
    return F.when(at > 0, at).otherwise(len(priority) + 1)


def merge_metadata(sources: DataFrame, priority: list[str] = PRIORITY, fields: list[str] = FIELDS) -> DataFrame:
    """Per file each field's value from the most trusted source that has it, and the longest list of
    authors (of equals the more trusted one's). Sources without a title take no part."""
    own = sources.filter(F.coalesce("title", F.lit("")) != "").withColumn("_p", _trust(F.col("extractor_name"), priority))
    best = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("_p", "extractor_name"))).alias(c) for c in fields]
    size = F.when(F.size("authors") > 0, F.struct(F.size("authors"), -F.col("_p")))
    return own.groupBy("content_sha256").agg(*best, F.max_by("authors", size).alias("authors"), F.array_sort(F.collect_set("extractor_name")).alias("source_extractors"))


def all_filled(sources: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """Per file whether every target field has a value in some source."""
    has = [F.count_if(F.size(c) > 0 if c == "authors" else F.col(c).isNotNull()) > 0 for c in targets]
    whole = has[0]
    for h in has[1:]:
        whole = whole & h
    return sources.groupBy("content_sha256").agg(whole.alias("all_filled"))


def to_resolve(files: DataFrame, resolved: DataFrame) -> DataFrame:
    return files.join(resolved.select("content_sha256"), "content_sha256", "left_anti")


def reconcile(found: DataFrame, stored: DataFrame, linked: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """One row of counts: what scans found, what is new, what only the other library has, what is not linked.

    found: (content_sha256, path) with repeats; stored, linked, missing: (content_sha256)."""
    unique = found.select("content_sha256").distinct()
    held, other = stored.select("content_sha256").distinct(), linked.select("content_sha256").distinct()
    back = other.join(held, "content_sha256", "left_anti")
    if missing is not None:
        back = back.join(missing.select("content_sha256"), "content_sha256", "left_anti")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    fresh = unique.join(held, "content_sha256", "left_anti")
    after = held.union(fresh).union(back).distinct()
    parts = [n(found, "found"), n(unique, "unique_files"), n(fresh, "new_files"), n(unique.join(held, "content_sha256", "left_semi"), "already_stored"), n(back, "only_in_library"), n(after.join(other, "content_sha256", "left_anti"), "not_linked")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out.withColumn("duplicates", F.col("found") - F.col("unique_files"))


def copy_plan(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """(content_sha256, path) to copy: forward's path wins, then the least."""
    both = forward.select("content_sha256", "path", F.lit(0).alias("o")).union(reverse.select("content_sha256", "path", F.lit(1)))
    return both.groupBy("content_sha256").agg(F.min(F.struct("o", "path"))["path"].alias("path"))


def staged_names(files: DataFrame) -> DataFrame:
    """File names free of collisions: the first of a name keeps it, others get eight digits of their
    hash, and a number if that is taken too."""
    name = F.coalesce(F.nullif(F.element_at(F.split("original_filename", "/"), -1), F.lit("")), F.concat(F.substring("content_sha256", 1, 8), F.lit(".pdf")))
    stem, dot = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    ext = F.when(dot == "", ".pdf").otherwise(dot)
    by_name = Window.partitionBy("_name").orderBy("seq", "content_sha256")
    by_hash = Window.partitionBy("_name", F.substring("content_sha256", 1, 8)).orderBy("seq", "content_sha256")
    out = files.withColumn("_name", name).withColumn("_n", F.row_number().over(by_name)).withColumn("_k", F.row_number().over(by_hash) - F.when(F.min("_n").over(Window.partitionBy("_name", F.substring("content_sha256", 1, 8))) == 1, 1).otherwise(0))
    marked = F.concat(stem, F.lit("_"), F.substring("content_sha256", 1, 8), F.when(F.col("_k") > 1, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise(""), ext)
    return out.withColumn("staged_name", F.when(F.col("_n") == 1, F.col("_name")).otherwise(marked)).drop("_name", "_n", "_k")


def sync_outcomes(wanted: DataFrame, library: DataFrame, imports: DataFrame) -> DataFrame:
    """content_sha256, status: pre-existing in the library, else imported or failed as `imports`
    (content_sha256, error) says, else pending."""
    there = library.select("content_sha256", F.lit(True).alias("_there")).distinct()
    tried = imports.groupBy("content_sha256").agg(F.min(F.col("error").isNotNull()).alias("_failed"))
    out = wanted.select("content_sha256").distinct().join(there, "content_sha256", "left").join(tried, "content_sha256", "left")
    status = F.when(F.col("_there"), "pre-existing").when(F.col("_failed").isNull(), "pending").when(F.col("_failed"), "failed").otherwise("imported")
    return out.select("content_sha256", status.alias("status"))
