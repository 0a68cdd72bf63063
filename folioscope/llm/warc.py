"""Operator 1, WARC fixity audit with Merkle trees.

Records of an archive are hashed (SHA-256) and put in ranges of RANGE_BYTES by their offset; a range's
digest covers its records' offsets and hashes in order. Above them, FAN_OUT nodes of a level make one
of the next, until one root is left (LEVELS levels at least, as many for both replicas). Two replicas
are compared at the roots; only below nodes that differ are children compared, and only records of
ranges that differ are looked at.

The offset is that of the archive's index, so a record that is missing or damaged in one replica does
not move the others: a replica's records take the places of the index's equal ones, then those of
changed ones with their id, and what is left (records that only the replica has) follows the archive's
end. Ranges, nodes and running sums hold bounded numbers of rows, whatever an archive's size.

Defined results: a null payload is an empty one; a null id is -1, a null archive ''; repeated records
each have a place of their own, in the order of their hashes; an archive that only one replica has
differs at its root, and all its records are reported; empty tables give no rows. Damaged files give
what can be read of them, with an error (parse_warc).
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.common import materialise

RANGE_BYTES, FAN_OUT, LEVELS = 65_536, 16, 5
#: Bytes of a gzip member that are inflated at once, and of payloads in a batch of rows.
CHUNK, BATCH_BYTES = 1 << 16, 4_000_000


def record_text(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC response record as text."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), record_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def running(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group that come before, by order.

    Rows are dealt by range over many tasks, so a group of any size is split; the tasks' sums, one row
    for each group and task, are added up."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_value", value.cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(width, *group, *order, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "dealt-by-range")
    rows = Window.partitionBy(*group, "_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(parts), F.lit(0)).alias("_base"))
    own = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(rows), F.lit(0)))
    return own.join(sums, [*group, "_part"]).select(*df.columns, (F.col("_base") + F.col("_own")).alias(name))


def _hashed(pages: DataFrame, archive: Column, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long"))
    flat = pages.select(F.coalesce(archive.cast("string"), F.lit("")).alias("archive"), key.alias("record_id"), record_text(key, F.col(url_col), payload).alias("record"))
    return flat.select("archive", "record_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))


def record_table(pages: DataFrame, archive: Column, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages as the index of their archives: archive, record_id, offset, length, sha256.

    Only lengths and hashes pass the shuffle that adds up offsets, in the order of ids."""
    hashed = _hashed(pages, archive, id_col, url_col, payload_col)
    placed = running(hashed, ["archive"], ["record_id", "sha256"], F.col("length"), "offset")
    return placed.select("archive", "record_id", "offset", "length", "sha256")


def replica_table(pages: DataFrame, index: DataFrame, archive: Column, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages as a replica's records with their places (placed)."""
    return placed(_hashed(pages, archive, id_col, url_col, payload_col), index)


def placed(records: DataFrame, index: DataFrame) -> DataFrame:
    """A replica's records (archive, record_id, length, sha256) with their places: those of the index's equal records, of
    its changed ones with the same id, or after the archive's end. Ids may be of any type. What is placed so does not
    depend on the order of the replica: one whose records stand in another order is intact."""
    one = F.lit(1)
    same_record, same_id = ["archive", "record_id", "sha256"], ["archive", "record_id"]
    a = materialise(running(index, same_record, ["offset"], one, "k"), "index-records")
    b = running(records, same_record, [], one, "k")
    b = materialise(b.join(a.select(*same_record, "k", "offset"), [*same_record, "k"], "left"), "replica-records")
    free = running(a.drop("k").join(b.select("archive", "offset"), ["archive", "offset"], "left_anti"), same_id, ["offset"], one, "k")
    rest = running(b.filter("offset IS NULL").select("archive", "record_id", "length", "sha256"), same_id, ["sha256"], one, "k")
    rest = materialise(rest.join(free.select(*same_id, "k", "offset"), [*same_id, "k"], "left"), "replica-rest")
    ends = index.groupBy("archive").agg(F.max(F.col("offset") + F.col("length")).alias("end"))
    extra = running(rest.filter("offset IS NULL").select("archive", "record_id", "length", "sha256"), ["archive"], ["record_id", "sha256"], F.col("length"), "after")
    extra = extra.join(ends, "archive", "left").withColumn("offset", F.coalesce("end", F.lit(0)) + F.col("after"))
    columns = ["archive", "record_id", "offset", "length", "sha256"]
    return b.filter("offset IS NOT NULL").select(columns).union(rest.filter("offset IS NOT NULL").select(columns)).union(extra.select(columns))


def height(*replicas: DataFrame) -> int:
    """Levels above the ranges until every archive has one node; the same for all replicas."""
    most = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) // RANGE_BYTES
    k = 0
    while most:
        most, k = most // FAN_OUT, k + 1
    return max(k, LEVELS)


def merkle_tree(records: DataFrame, levels: int) -> DataFrame:
    """archive, level (0: ranges), node, digest; the root is node 0 of the last level."""

    def joined(order: Column, text: Column) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
        return F.sha2(F.array_join(F.transform(pairs, lambda x: x["t"]), ","), 256)

    line = F.concat_ws(":", F.col("offset").cast("string"), F.col("sha256"))
    level = records.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node")).agg(joined(F.col("offset"), line).alias("digest"))
    level = materialise(level.select("archive", F.lit(0).alias("level"), "node", "digest"), "merkle-level")
    tree = level
    for k in range(1, levels + 1):
        up = F.floor(F.col("node") / FAN_OUT).cast("long")
        level = level.groupBy("archive", up.alias("up")).agg(joined(F.col("node"), F.col("digest")).alias("digest"))
        level = materialise(level.select("archive", F.lit(k).alias("level"), F.col("up").alias("node"), "digest"), "merkle-level")
        tree = tree.union(level)
    return tree


def audit(a: DataFrame, b: DataFrame, tree_a: DataFrame, tree_b: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that differ (archive, level, node), and damaged records (archive, record_id, offset, state).

    state: corrupt (hashes differ), missing (only in a), extra (only in b)."""

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select("archive", "node", F.col("digest").alias("other"))
        return x.join(y, ["archive", "node"], "full_outer").filter(~F.col("digest").eqNullSafe(F.col("other"))).select("archive", "node")

    at = lambda tree, k: tree.filter(F.col("level") == k).select("archive", "node", "digest")
    now = materialise(differing(at(tree_a, levels), at(tree_b, levels)), "merkle-differing")
    found = now.withColumn("level", F.lit(levels))
    for k in range(levels - 1, -1, -1):
        parents = now.select("archive", F.col("node").alias("up"))
        below = lambda tree: at(tree, k).withColumn("up", F.floor(F.col("node") / FAN_OUT).cast("long")).join(parents, ["archive", "up"], "left_semi").select("archive", "node", "digest")  # noqa: E731,B023
        now = materialise(differing(below(tree_a), below(tree_b)), "merkle-differing")
        found = found.union(now.withColumn("level", F.lit(k)))
    within = lambda t: t.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).join(now, ["archive", "node"], "left_semi")
    x = within(a).select("archive", "offset", F.col("record_id").alias("ra"), F.col("sha256").alias("sa"))
    y = within(b).select("archive", "offset", F.col("record_id").alias("rb"), F.col("sha256").alias("sb"))
    both = x.join(y, ["archive", "offset"], "full_outer").filter(~F.col("sa").eqNullSafe(F.col("sb")))
    state = F.when(F.col("sb").isNull(), "missing").when(F.col("sa").isNull(), "extra").otherwise("corrupt")
    return found, both.select("archive", F.coalesce("ra", "rb").alias("record_id"), "offset", state.alias("state"))


def fixity_report(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: per archive its archive, n_records and n_bytes (of a), root_a, root_b, intact,
    n_ranges_differ, n_damaged; and per damaged record its archive, record_id, offset, state."""
    a, b = materialise(a, "replica-a"), materialise(b, "replica-b")
    levels = height(a, b)
    tree_a, tree_b = merkle_tree(a, levels), merkle_tree(b, levels)
    nodes, damaged = audit(a, b, tree_a, tree_b, levels)
    damaged = materialise(damaged, "damaged-records")
    root = lambda tree, name: tree.filter(F.col("level") == levels).select("archive", F.col("digest").alias(name))
    sizes = a.groupBy("archive").agg(F.count(F.lit(1)).alias("n_records"), F.sum("length").alias("n_bytes"))
    wide = nodes.filter("level = 0").groupBy("archive").agg(F.count(F.lit(1)).alias("n_ranges_differ"))
    hurt = damaged.groupBy("archive").agg(F.count(F.lit(1)).alias("n_damaged"))
    out = root(tree_a, "root_a").join(root(tree_b, "root_b"), "archive", "full_outer")
    for part in (sizes, wide, hurt):
        out = out.join(part, "archive", "left")
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    intact = F.col("root_a").eqNullSafe(F.col("root_b")).alias("intact")
    return out.select("archive", count("n_records"), count("n_bytes"), "root_a", "root_b", intact, count("n_ranges_differ"), count("n_damaged")), damaged


def _records(data: bytes, at: int = 0):
    """Yield (offset, headers, block, error) of uncompressed records; after damage it goes on at the
    next line that begins a record."""
    while at < len(data):
        begin = at
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            at = data.find(b"\nWARC/", at + 1) + 1 or len(data)
            if data[begin:at].strip():
                yield begin, {}, data[begin:at], "no record" if end >= 0 else "cut"
            continue
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            at = data.find(b"\nWARC/", end) + 1 or len(data)
            yield begin, headers, data[end + 4 : at], "bad length"
            continue
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        if len(block) < int(size):
            yield begin, headers, block, "cut"
            return
        if data[at : at + 4] in (b"\r\n\r\n", b""):
            at += 4
        yield begin, headers, block, None


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """A gzip member inflated chunk by chunk: its bytes, where the next begins, what is wrong with it."""
    inflate, out, begin = zlib.decompressobj(31), [], at
    view = memoryview(data)
    try:
        while not inflate.eof and at < len(data):
            out.append(inflate.decompress(view[at : at + CHUNK]))
            at += CHUNK
    except zlib.error:
        again = data.find(b"\x1f\x8b\x08", begin + 3)
        return b"".join(out), again if again > 0 else len(data), "bad gzip"
    if not inflate.eof:
        return b"".join(out), len(data), "cut"
    return b"".join(out), min(at, len(data)) - len(inflate.unused_data), None


def parse_warc(data: bytes):
    """Yield (offset, headers, block, error) of each record; gzip files hold a member for each record.

    Offsets are those of the records (or their members) in the file as it is stored. error is null, or
    what is wrong: cut, bad length, bad gzip, no record; reading goes on at the next record."""
    at = 0
    while data.startswith(b"\x1f\x8b", at):
        begin = at
        raw, at, error = _member(data, at)
        found = False
        for _, headers, block, own in _records(raw):
            found = True
            yield begin, headers, block, error or own
        if error and not found:
            yield begin, {}, b"", error
    for offset, headers, block, error in _records(data, at):
        yield offset, headers, block, error


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files: archive, record_id (text), offset, length, uri, payload,
    sha256, error.

    Files are read by Spark, so any store that it reads will do: one task holds a file, 2 GB at most;
    records leave it in batches."""
    names = ["archive", "record_id", "offset", "length", "uri", "payload", "sha256", "error"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, rows, size = b.column("path")[i].as_py(), [], 0
                for o, h, block, error in parse_warc(b.column("content")[i].as_py()):
                    rows.append((name, h.get("warc-record-id"), o, len(block), h.get("warc-target-uri"), block, hashlib.sha256(block).hexdigest(), error))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return files.select("path", "content").mapInArrow(run, "archive string, record_id string, offset long, length long, uri string, payload binary, sha256 string, error string")


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the files under a folder: archive (the file's path below it), record_id (text, '' if there is none),
    offset, length, sha256, error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    below = F.when(F.startswith("archive", F.lit(base + "/")), F.substring("archive", len(base) + 2, 1 << 20)).otherwise(F.element_at(F.split("archive", "/"), -1))
    rows = read_warc(spark, path).select(below.alias("archive"), F.coalesce("record_id", F.lit("")).alias("record_id"), "offset", "length", "sha256", "error")
    return materialise(rows, "file-records")


def audit_files(spark: SparkSession, path: str, replica: str) -> tuple[DataFrame, DataFrame]:
    """The audit of a folder of WARC files against a replica: files are compared by their path below the folders.

    Per archive its archive, n_records, n_bytes, root_a, root_b, intact, n_ranges_differ, n_damaged; and per damaged record
    its archive, record_id, state, offset (in the first folder's file; null for extras) and error (of the replica's
    record). Places are sums over the records in the order of the file, so records that share a gzip member or are empty
    have places of their own, and a lost record moves no other."""
    own, other = file_records(spark, path), file_records(spark, replica)
    index = running(own, ["archive"], ["offset", "record_id", "sha256"], F.col("length") + 1, "place")
    index = materialise(index.withColumnRenamed("offset", "at").withColumnRenamed("place", "offset"), "file-index")
    columns = ["archive", "record_id", "offset", "length", "sha256"]
    report, damaged = fixity_report(index.select(columns), placed(other.select("archive", "record_id", "length", "sha256"), index.select(columns)))
    errors = other.filter("error IS NOT NULL").groupBy("archive", "record_id").agg(F.min("error").alias("error"))
    damaged = damaged.join(index.select("archive", "offset", "at"), ["archive", "offset"], "left").join(errors, ["archive", "record_id"], "left")
    return report, damaged.select("archive", "record_id", "state", F.col("at").alias("offset"), "error")
