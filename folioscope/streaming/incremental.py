"""Incremental forms as Structured Streaming: each batch is an upsert into a keyed table (operators.tables).

A batch reads and writes the hash buckets that its keys fall into, no others, and commits with the batch's number, so
a batch that is repeated after a failure changes nothing. Results that are whole in every batch, and the keyword index of
index_stream, lie in numbered folders instead (operators.segments has the index that grows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import bm25
from folioscope.operators.dml import insert_new, upsert_sightings
from folioscope.operators.tables import Merge, Table
from folioscope.schemas import DOCUMENT_STATES
from folioscope.sources.places import remove


def _versions(spark: SparkSession, path: str, mark: str = "_SUCCESS") -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{mark}"))
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and done(n))


def current(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A keyed table as it is, or of numbered folders the newest whole version (before a batch); else an empty table."""
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_log")
    if before is None and log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(log):
        return Table(spark, path, schema, []).read()
    have = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/v={have[-1]:012d}") if have else spark.createDataFrame([], schema)


def keep_upserted(stream: DataFrame, path: str, schema: str, key: list[str], merge: Merge, checkpoint: str) -> StreamingQuery:
    """Fold a stream into a keyed table by merge(old, batch), bucket by bucket; takes what is there and ends."""

    def fold(batch: DataFrame, number: int) -> None:
        Table(batch.sparkSession, path, schema, key).merge(batch, merge, app=(checkpoint, number))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, schema: str = "content_sha256 string, path string") -> StreamingQuery:
    """Content is taken in once, whatever batch or path brings it again."""
    return keep_upserted(stream.select(*[c.split()[0] for c in schema.split(", ")]), path, schema, ["content_sha256"], lambda old, new: insert_new(old, new.groupBy("content_sha256").agg(F.min("path").alias("path")), ["content_sha256"]), checkpoint)


def sightings_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """First and last time that a file was seen at a place."""
    schema = "content_sha256 string, source_path string, machine_id string, first_seen timestamp, last_seen timestamp"
    return keep_upserted(stream.select(*[c.split()[0] for c in schema.split(", ")]), path, schema, ["content_sha256", "source_path", "machine_id"], upsert_sightings, checkpoint)


def first_last_seen(stream: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The same as a running aggregate, for update or complete mode."""
    return stream.groupBy(*key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def state_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Newest state per document of (doc_id, status, at), of states at one time the one that comes later in a document's
    life; failed ones can be read back and run again."""
    place = F.array_position(F.array(*[F.lit(x) for x in DOCUMENT_STATES]), F.col("status"))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new.select("doc_id", "status", "at")).groupBy("doc_id").agg(F.max_by(F.struct("status", "at"), F.struct("at", place, "status")).alias("b")).select("doc_id", "b.*")

    return keep_upserted(stream, path, "doc_id string, status string, at timestamp", ["doc_id"], merge, checkpoint)


def to_retry(states: DataFrame) -> DataFrame:
    return states.filter(F.col("status") == "failed").select("doc_id")


def windowed_counts(stream: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """Events per window and key; rows later than `late` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("window_start"), *keys, "events")


def index_stream(stream: DataFrame, chunks_path: str, index_path: str, checkpoint: str, schema: str = "chunk_id string, content string") -> StreamingQuery:
    """New chunks are added once; after each batch the keyword index of all of them is built anew, as a
    version of its own: readers of the one before are not disturbed (current_index)."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, chunks_path, schema, before=number)
        insert_new(old, batch, ["chunk_id"]).write.mode("overwrite").parquet(f"{chunks_path}/v={number:012d}")
        bm25.build(current(spark, chunks_path, schema), path=f"{index_path}/v={number:012d}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, index_path: str) -> bm25.Bm25Index | None:
    """The newest whole keyword index that index_stream has written."""
    for v in reversed(_versions(spark, index_path, "corpus/_SUCCESS")):
        return bm25.Bm25Index.load(spark, f"{index_path}/v={v:012d}")
    return None


def drop_versions(spark: SparkSession, path: str, keep: int = 2, mark: str = "_SUCCESS") -> list[int]:
    """Remove all but the newest `keep` versions of a table or index; their numbers."""
    old = _versions(spark, path, mark)[:-keep] if keep else _versions(spark, path, mark)
    for v in old:
        remove(spark, f"{path}/v={v:012d}")
    return old
