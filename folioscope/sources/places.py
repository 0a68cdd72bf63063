"""Where work is put that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder of any store that Spark knows; whether it was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; only where that is unset in a local session
    (as in tests) in a folder of its own, else in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        at = spark.conf.get("spark.sql.warehouse.dir")
    if not at:
        at = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="folioscope-work-"))
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the work folder, read again: cuts lineage, and a lost executor costs no more than this step.
    The table goes when the application ends."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
