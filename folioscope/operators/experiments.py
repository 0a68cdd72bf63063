"""Comparison of search experiments in long form, project reports, run tallies.

Results are (experiment_id, query, doc_id, similarity), one row per hit; queries that were asked
come as (experiment_id, query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_similarity(results: DataFrame) -> DataFrame:
    """Mean over an experiment's answered queries of their mean similarity."""
    per_query = results.groupBy("experiment_id", "query").agg(F.avg("similarity").alias("s"))
    return per_query.groupBy("experiment_id").agg(F.round(F.avg("s"), 6).alias("avg_similarity"))


def overlap(results: DataFrame, baseline: str) -> DataFrame:
    """Share of the baseline's documents that an experiment finds too, mean over the baseline's queries."""
    docs = results.select("experiment_id", "query", "doc_id").distinct()
    base = docs.filter(F.col("experiment_id") == baseline).select("query", "doc_id")
    size = base.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    both = docs.join(base, ["query", "doc_id"]).groupBy("experiment_id", "query").agg(F.count(F.lit(1)).alias("k"))
    every = results.select("experiment_id").distinct().crossJoin(F.broadcast(size))
    share = every.join(both, ["experiment_id", "query"], "left").select("experiment_id", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("share"))
    return share.groupBy("experiment_id").agg(F.round(F.avg("share"), 6).alias("result_overlap"))


def coverage(asked: DataFrame, results: DataFrame) -> DataFrame:
    """Share of the asked queries that have an answer."""
    answered = results.select("experiment_id", "query").distinct().withColumn("hit", F.lit(1))
    return asked.join(answered, ["experiment_id", "query"], "left").groupBy("experiment_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("query_coverage"))


METRICS = {"avg_similarity": average_similarity, "result_overlap": overlap, "query_coverage": coverage}


def compare(asked: DataFrame, results: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """(metric, experiment_id, value); metrics of no known name give no rows."""
    parts = {"avg_similarity": lambda: average_similarity(results), "result_overlap": lambda: overlap(results, baseline), "query_coverage": lambda: coverage(asked, results)}
    out = asked.sparkSession.createDataFrame([], "metric string, experiment_id string, value double")
    for m in metrics:
        if m in parts:
            out = out.union(parts[m]().select(F.lit(m), F.col("experiment_id").cast("string"), F.col(m)))
    return out


def counts_by(experiments: DataFrame, column: str) -> DataFrame:
    return experiments.groupBy(column).agg(F.count(F.lit(1)).alias("experiments"))


def exported_results(results: DataFrame, n: int = 200) -> DataFrame:
    """Results as JSON lines, contents cut at n characters."""
    from folioscope.functions.text import preview

    cut = results.withColumn("content", preview(F.col("content"), n)) if "content" in results.columns else results
    return cut.select(F.to_json(F.struct(*cut.columns)).alias("value"))


def outcome_tally(rows: DataFrame, status: str = "status") -> DataFrame:
    s = F.col(status)
    return rows.agg(F.count_if(s == "success").alias("success"), F.count_if(s == "error").alias("error"), F.count_if(s.isin("skipped", "duplicate")).alias("skipped"), F.count(F.lit(1)).alias("total"))


def method_coverage(rows: DataFrame) -> DataFrame:
    """Per extraction method how many files have a title and an abstract, and 'any' over all methods."""
    t, a = F.coalesce("title", F.lit("")) != "", F.coalesce("abstract", F.lit("")) != ""
    own = rows.groupBy("method").agg(F.count_if(t).alias("titles"), F.count_if(a).alias("abstracts"))
    each = rows.groupBy("content_sha256").agg(F.max(t).alias("t"), F.max(a).alias("a"))
    return own.union(each.agg(F.lit("any"), F.count_if("t"), F.count_if("a")))


def project_stats(documents: DataFrame) -> DataFrame:
    """Per project its documents, their chunks, first and last date."""
    return documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.min("added_date").alias("first_added"), F.max("added_date").alias("last_added"))
