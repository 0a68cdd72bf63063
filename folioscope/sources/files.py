"""Scans of files and tables. Files come as (path, modificationTime, length), contents only on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.names import size_mb

PDF = "*.[pP][dD][fF]"


def scan_files(spark: SparkSession, roots: list[str], pattern: str = PDF, *, recursive: bool = True, content: bool = False) -> DataFrame:
    """Distinct files under the roots; a root that is not there raises. Without content no file is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(roots)
    return (df if content else df.drop("content")).dropDuplicates(["path"])


def with_hashes(files: DataFrame) -> DataFrame:
    """Files (with content) with the hash of their bytes instead of the bytes."""
    return files.withColumn("content_sha256", F.sha2("content", 256)).drop("content")


def first_path_per_hash(files: DataFrame) -> DataFrame:
    return files.groupBy("content_sha256").agg(F.min("path").alias("path"))


def recent_files(files: DataFrame, n: int) -> DataFrame:
    return files.select("path", "modificationTime", "length", size_mb(F.col("length")).alias("size_mb")).orderBy(F.desc("modificationTime"), "path").limit(n)


def not_yet_translated(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files without an output of their hash, the smallest first."""
    return files.join(outputs.select("content_sha256"), "content_sha256", "left_anti").orderBy("length", "path")


def newest_extraction(outputs: DataFrame, tools: list[str]) -> DataFrame:
    """Per hash the path of the most trusted tool's last output (tools are listed best first)."""
    trust = F.array_position(F.array(*[F.lit(t) for t in reversed(tools)]), F.col("tool"))
    return outputs.groupBy("content_sha256").agg(F.max_by(F.struct("tool", "path"), F.struct(trust, "path")).alias("b")).select("content_sha256", "b.*")


def with_decisions(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """Files with what was decided on them, newest first."""
    out = files.join(decisions.select("content_sha256", "decision"), "content_sha256", "left")
    return out.withColumn("decision", F.coalesce("decision", F.lit("undecided"))).orderBy(F.desc("modificationTime"), "path")


def batch_input(spark: SparkSession, source, n: int | None = None) -> DataFrame:
    """(path) from a JSON file of paths, a list of paths or a list of {'path': ...}; its first n."""
    if isinstance(source, str):
        text = spark.read.option("wholetext", True).text(source)
        plain = F.from_json("value", "array<string>")
        paths = F.transform(plain, lambda x: F.coalesce(F.get_json_object(x, "$.path"), x))
        df = text.select(F.posexplode(paths).alias("seq", "path"))
    else:
        df = spark.createDataFrame([(i, x["path"] if isinstance(x, dict) else str(x)) for i, x in enumerate(source)], "seq int, path string")
    df = df.orderBy("seq")
    return (df if n is None else df.limit(n)).select("path")


def json_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, value) of a JSON file of one object; empty where the file is missing or broken."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], f"key string, value {schema}")
    return text.select(F.explode(F.from_json("value", f"map<string,{schema}>")).alias("key", "value"))


def remaining(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that a checkpoint does not list as done."""
    return files.join(done.select("path"), "path", "left_anti")
