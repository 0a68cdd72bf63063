"""A document's state as a stateful stream: legal moves, timers for documents that are stuck, illegal moves beside.

A stream of (doc_id, status, at) asks documents to move. A move that the table of moves allows changes the state; any other is
reported and changes nothing. A document that works (extracting, indexing) and hears nothing for `patience` of event
time, as the watermark tells it, is reported as stuck and fails, so that it can be tried again.

The operator keeps one row a document in the state store (RocksDB, so state may exceed memory) and gives one row for each
thing that happened: doc_id, at, seq, from_status, to_status, kind ('move', 'illegal', 'stuck'). Rows of a batch are taken in the order of
their time, then of `seq`; batches in the order in which they come. A query that is started again goes on where its
checkpoint ends, timers included.

Defined results: rows without a document, status or time are left out; a status that is not known is an illegal move; a
repeated status is one, too (from a state to itself); late rows, behind the watermark, are left out by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The states of a document and where each may go; a new document has none yet.
NEW = "new"
MOVES = {
    NEW: ("pending", "extracting"),
    "pending": ("extracting", "failed"),
    "extracting": ("extracted", "indexed", "failed"),
    "extracted": ("indexing", "indexed", "failed"),
    "indexing": ("indexed", "failed"),
    "indexed": ("extracting",),
    "failed": ("pending", "extracting"),
}
WORKING = ("extracting", "indexing")
_EVENTS = "doc_id {kind}, at timestamp, seq long, from_status string, to_status string, kind string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DocumentStates(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, at timestamp")

    def _timer(self, status: str, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in WORKING:
            self.handle.registerTimer(at_ms + self.patience_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        from pyspark.sql import Row

        status = self.state.get()[0] if self.state.exists() else NEW
        moved = None
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            kind = "move" if r["status"] in MOVES[status] else "illegal"
            yield Row(doc_id=key[0], at=r["at"], seq=r["seq"], from_status=status, to_status=r["status"], kind=kind)
            if kind == "move":
                status, moved = r["status"], r
        if moved is not None:
            self.state.update((status, moved["at"]))
            self._timer(status, moved["at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        from pyspark.sql import Row

        status, at = self.state.get()
        if status in WORKING:
            yield Row(doc_id=key[0], at=at, seq=None, from_status=status, to_status="failed", kind="stuck")
            self.state.update(("failed", at))

    def close(self) -> None:
        pass


def document_states(stream: DataFrame, *, patience: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(doc_id, status, at, seq) -> what happened, as a stream in append mode."""
    kind = stream.schema["doc_id"].dataType.simpleString()
    rows = stream.select("doc_id", "status", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq")).filter("doc_id IS NOT NULL AND status IS NOT NULL AND at IS NOT NULL")
    rows = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late)
    number, unit = patience.split()
    ms = int(float(number) * 1000 * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")])
    return rows.groupBy("doc_id").transformWithState(DocumentStates(ms), _EVENTS.format(kind=kind), "Append", "EventTime")


def follow_states(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Write what happens under path, a folder a batch (a repeated batch writes the same again); takes what is there and
    ends. The state store has to be RocksDB: the setting is the session's, and is put back once the query runs."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        out = document_states(stream, **options)
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        return out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def happened(spark, path: str, doc_type: str = "string") -> DataFrame:
    return spark.read.schema(_EVENTS.format(kind=doc_type) + ", batch int").parquet(path)


def state_summary(events: DataFrame) -> DataFrame:
    """doc_id, status, moves, illegal, stuck: a row per document, from what happened to it."""
    counts = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("move", "moves"), ("illegal", "illegal"), ("stuck", "stuck"))]
    changed = F.col("kind") != "illegal"
    # a stuck document's row comes after its batch's moves
    last = F.max_by(F.when(changed, F.col("to_status")), F.when(changed, F.struct("batch", F.col("kind") == "stuck", "at", "seq")))
    return events.groupBy("doc_id").agg(F.coalesce(last, F.lit(NEW)).alias("status"), *counts)
