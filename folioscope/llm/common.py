"""What the training-data operators share: the shared folder, written tables, Arrow batches.

Every operator takes a frame with an id and a text column (names are parameters), keeps to those
columns and ignores all others, so extra columns with clashing names do no harm.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests on one machine) a folder is made; on a cluster without the
    setting the warehouse folder, which is shared too, is taken.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="folioscope-shared-")
    return _OWN_DIR[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write df to the shared folder (in folders by some columns) and read it back: cuts lineage, survives lost executors.

    The table goes when the application ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
#: Rows of an Arrow batch: texts are long, and both sides hold whole batches.
BATCH_ROWS = 1_000
#: What workers remember between tasks, by the operator whose memory it is, and how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    _REMEMBERED[name] = forget


def keep_only(*names: str) -> None:
    """Called where a task begins: what other operators left in this worker goes."""
    for name, forget in _REMEMBERED.items():
        if name not in names:
            forget()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (they may not have it installed).

    The archive is put in the shared folder through Spark's own file systems."""
    app = spark.sparkContext.applicationId
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for top, dirs, names in os.walk(os.path.join(root, "folioscope")):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, root))
    into = fresh_path(spark, "folioscope") + ".zip"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(into)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(data.getvalue())
    stream.close()
    spark.sparkContext.addPyFile(into)
    _SHIPPED.add(app)


def slices(batches, rows: int = 512, chars: int = 4_000_000):
    """Cut Arrow batches into smaller ones by rows and, roughly, by bytes: bounds Python memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * chars / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, column: int | str = "text") -> list[str]:
    """A text column as Python strings; null becomes the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]
