"""Resolve and enrich: ask sources wave by wave, keep every answer, merge, rename, log. Running it again does nothing.

A library is four keyed tables (operators.tables): files, sources (one row per file and source, also where the source had
nothing, so that it is not asked again), resolved, log. A run

1. takes the files that are not resolved (all given ones with force);
2. goes through the waves: a file whose fields are all filled leaves; of the others those keys are asked that no kept
   answer stands for, each distinct key once; answers are kept before the next wave begins, so a run that stops in the
   middle goes on there;
3. merges what the sources say by trust (reconcile.merge_metadata) into `resolved`;
4. names the files anew and logs it, if asked to.

Errors of a lookup are that file's outcome: they are counted, not kept, and asked again next time.

Defined results: a file without any source that knows it stays unresolved, and is not asked again; with dry_run nothing
is asked or written; files of equal content are one file; hashes that the library lacks count as failed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import names, responses, text
from folioscope.operators.hooks import LOOKUPS, look_up
from folioscope.operators.reconcile import all_filled, merge_metadata
from folioscope.operators.tables import Table
from folioscope.schemas import CANONICAL_FILES, METADATA_RESOLVED
from folioscope.sources.places import written
from folioscope.sources.sinks import bib_entries

SOURCES = "content_sha256 string, extractor_name string, title string, authors array<string>, year int, journal string, abstract string, doc_type string, doi string, arxiv_id string, asked_at timestamp"
LOG = "content_sha256 string, action string, detail string, timestamp timestamp"
_FIELDS = [("title", "string"), ("authors", "array<string>"), ("year", "int"), ("journal", "string"), ("abstract", "string"), ("doc_type", "string"), ("doi", "string"), ("arxiv_id", "string")]


@dataclass(frozen=True)
class Step:
    """A source: its name in the order of trust (and of its registered lookup), the key that is asked for, and how an answer is
    read. Keys are made of a file's columns and of doi, arxiv_id, front and title, as far as they are known."""

    name: str
    key: Callable[[], Column]
    parse: Callable[[Column], Column]


def _doi() -> Column:
    return F.coalesce(F.col("doi"), text.doi_any(F.col("front")))


WAVES: Sequence[Sequence[Step]] = (
    (Step("xmp", lambda: F.col("canonical_path"), responses.xmp), Step("grobid", lambda: F.col("canonical_path"), responses.grobid)),
    (Step("doi_crossref", _doi, responses.crossref),),
    (Step("arxiv", lambda: F.coalesce(F.col("arxiv_id"), F.nullif(text.arxiv_base_id(F.col("original_filename")), F.lit(""))), responses.scholar),),
    (Step("semantic_scholar", lambda: F.coalesce(_doi(), F.col("title")), responses.scholar),),
)


class Library:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark = spark
        self.files = Table(spark, f"{path}/files", CANONICAL_FILES, ["content_sha256"], buckets)
        self.sources = Table(spark, f"{path}/sources", SOURCES, ["content_sha256", "extractor_name"], buckets)
        self.resolved = Table(spark, f"{path}/resolved", METADATA_RESOLVED, ["content_sha256"], buckets)
        self.log = Table(spark, f"{path}/log", LOG, ["content_sha256", "action", "timestamp"], buckets)


def _answers(keys: DataFrame, step: Step, now: Column, tries: int) -> tuple[DataFrame, DataFrame]:
    """(content_sha256, key) -> rows of the sources table, and the files whose lookup failed."""
    got = written(look_up(keys, step.name, tries=tries, base_seconds=0.5), "answers")
    known = keys.join(got, "key")
    good = known.filter("error IS NULL").withColumn("p", step.parse(F.col("response")))
    held = {f.name for f in good.schema["p"].dataType.fields}
    columns = [(F.col(f"p.{n}") if n in held else F.lit(None)).cast(k).alias(n) for n, k in _FIELDS]
    rows = good.select("content_sha256", F.lit(step.name).alias("extractor_name"), *columns, now.alias("asked_at"))
    return rows.withColumn("title", F.nullif(F.trim("title"), F.lit(""))), known.filter("error IS NOT NULL").select("content_sha256")


def resolve(library: Library, targets: DataFrame, fronts: DataFrame | None, now: str, *, waves: Sequence[Sequence[Step]] = WAVES, force: bool = False, tries: int = 4) -> tuple[DataFrame, int, int]:
    """Ask for the files of `targets` (content_sha256) until their fields are filled: their merged rows, the number of keys
    that were asked, and the number of files with an error and no answer."""
    at = F.lit(now).cast("timestamp")
    targets = written(targets.select("content_sha256").distinct(), "targets")
    asked, failed = 0, None
    files = library.files.read().join(targets, "content_sha256", "left_semi")
    front = fronts.select("content_sha256", F.col("front")) if fronts is not None else targets.withColumn("front", F.lit(None).cast("string"))

    def answers() -> DataFrame:
        own = library.sources.read().join(targets, "content_sha256", "left_semi")
        return own.filter(F.col("asked_at") >= at) if force else own

    for wave in waves:
        have = written(answers(), "have")
        done = all_filled(have.filter("title IS NOT NULL")).filter("all_filled").select("content_sha256")
        ids = have.groupBy("content_sha256").agg(F.max("doi").alias("doi"), F.max("arxiv_id").alias("arxiv_id"))
        titles = merge_metadata(have).select("content_sha256", "title")
        state = files.join(done, "content_sha256", "left_anti").join(front, "content_sha256", "left").join(ids, "content_sha256", "left").join(titles, "content_sha256", "left")
        for step in wave:
            if step.name not in LOOKUPS:
                continue
            there = have.filter(F.col("extractor_name") == step.name).select("content_sha256")
            keys = state.join(there, "content_sha256", "left_anti").select("content_sha256", step.key().alias("key")).filter("key IS NOT NULL AND key <> ''")
            keys = written(keys, "keys")
            n = keys.select("key").distinct().count()
            if not n:
                continue
            asked += n
            rows, errors = _answers(keys, step, at, tries)
            library.sources.upsert(rows, "asked_at")
            failed = errors if failed is None else failed.unionByName(errors)
    have = written(answers(), "have")
    merged = merge_metadata(have).withColumn("resolution_method", F.lit("rules")).withColumn("resolved_at", at)
    lost = 0 if failed is None else failed.distinct().join(have.filter("title IS NOT NULL").select("content_sha256"), "content_sha256", "left_anti").count()
    return merged, asked, lost


def enrich(library: Library, now: str, *, hashes: DataFrame | None = None, fronts: DataFrame | None = None, force: bool = False, rename: bool = True, dry_run: bool = False, waves: Sequence[Sequence[Step]] = WAVES, tries: int = 4) -> tuple[dict[str, int], DataFrame]:
    """A run over the library: its summary (total, already_resolved, asked, resolved, renamed, unknown, failed) and the
    entries of what was resolved."""
    spark, at = library.spark, F.lit(now).cast("timestamp")
    files = library.files.read()
    wanted = written((files if hashes is None else hashes).select("content_sha256").distinct(), "wanted")
    known = wanted.join(files.select("content_sha256"), "content_sha256", "left_semi")
    cached = known.join(library.resolved.read().select("content_sha256"), "content_sha256", "left_semi")
    targets = known if force else known.join(cached, "content_sha256", "left_anti")
    total, there, already = wanted.count(), known.count(), 0 if force else cached.count()
    summary = {"total": total if hashes is not None else there - already, "already_resolved": already if hashes is not None else 0, "asked": 0, "resolved": 0, "renamed": 0, "unknown": 0, "failed": total - there}
    if dry_run:
        summary["resolved"] = there - already
        return summary, bib_entries(spark.createDataFrame([], METADATA_RESOLVED))
    merged, asked, lost = resolve(library, targets, fronts, now, waves=waves, force=force, tries=tries)
    merged = written(merged.select(*library.resolved.columns), "merged")
    n = merged.count()
    summary |= {"asked": asked, "resolved": n, "failed": summary["failed"] + lost, "unknown": there - already - n - lost}
    library.resolved.upsert(merged, "resolved_at")
    if rename and n:
        named = files.join(merged.select("content_sha256", "title", "authors", "year"), "content_sha256")
        nothing = F.lit(None).cast("string")
        new = names.display_name(F.get("authors", 0), F.col("year"), F.col("title"), nothing, F.col("original_filename"))
        moved = named.withColumn("new", new).filter(~F.col("new").eqNullSafe(F.col("display_name")))
        path = F.concat(F.regexp_replace("canonical_path", "[^/]*$", ""), F.col("new"))
        moved = written(moved.withColumn("canonical_path", path).withColumn("display_name", F.col("new")).select(*library.files.columns), "renamed")
        summary["renamed"] = moved.count()
        library.files.upsert(moved, "ingested_at")
        library.log.insert_new(moved.select("content_sha256", F.lit("enriched_rename").alias("action"), F.concat(F.lit("renamed to "), "display_name").alias("detail"), at.alias("timestamp")))
    return summary, bib_entries(merged)
