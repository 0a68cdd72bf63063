"""Operator 5, token-id output: flat unsigned integer files with 64-bit document offsets.

Layout of a written folder (all little-endian):
  shard-00000-<attempt>.bin   the ids of the shard's documents, back to back, uint16 or uint32
  shard-00000-<attempt>.idx   uint64: n, then n + 1 offsets (in ids) into the .bin, then n doc ids (int64)
  manifest.parquet            one row per shard: shard, name, n_docs, n_ids, base (ids of all shards before)
Shards hold ascending, disjoint ranges of doc ids and about SHARD_BYTES each (in small tables less, so
that every core has one). A shard's base is the prefix sum of the shards before it, so any document's
global position is base + its own offset, and a reader maps only the shards that it needs; from a
remote store it reads ranges. Files of attempts that failed are in no manifest and are removed.

Texts are encoded where they lie; only ids (two or four bytes each) pass the shuffle that orders them.

Defined results: a null text counts as empty and gets the end id alone; repeated doc ids keep one
entry per row, ordered by a hash of their texts; an empty table writes no shard; null doc ids come first
as -1.
"""

from __future__ import annotations

import bisect
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import fresh_path, slices, texts_of
from folioscope.llm.tokens import Encoder, crc32

#: Bytes of text that a shard is meant to hold, and the least for which a shard is made; keys looked at.
SHARD_BYTES, LEAST_BYTES, SAMPLE = 128 << 20, 1 << 20, 100_000
_MANIFEST = "shard int, name string, n_docs long, n_ids long, base long"


def _filesystem(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _put(uri: str, name: str, chunks) -> None:
    system, path = _filesystem(uri)
    with system.open_output_stream(f"{path}/{name}") as out:
        for chunk in chunks:
            out.write(chunk)


def _ranges(uri: str, name: str, dtype):
    """A function that gives numbers a to b of a file: mapped to memory, or read from a remote store."""
    system, path = _filesystem(uri)
    full, kind = f"{path}/{name}", np.dtype(dtype)
    if isinstance(system, fs.LocalFileSystem):
        whole = np.memmap(full, kind, "r") if os.path.getsize(full) else np.empty(0, kind)
        return lambda a, b: whole[a:b]
    file = system.open_input_file(full)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)


def boundaries(rows: DataFrame, shards: int | None) -> tuple[list[tuple], int]:
    """The first keys (doc_id, tie, row) of all shards but the first, so that shards hold about equal bytes
    of text; from one scan that counts and one that takes about SAMPLE keys."""
    sizes = rows.select("doc_id", "tie", "row", F.octet_length("text").alias("size"))
    n, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is None:
        shards = max(-(-size // SHARD_BYTES), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES), 1)
    if shards == 1:
        return [], 1
    some = F.pmod(F.xxhash64("doc_id", "tie", "row"), F.lit(-(-n // SAMPLE))) == 0
    keys = sorted(tuple(r) for r in sizes.filter(some).collect())
    ends = np.cumsum([k[3] for k in keys])
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards) if keys else []
    return [keys[i][:3] for i in cuts], shards


def encoded(rows: DataFrame, firsts: list[tuple], tokenizer_path: str, end_id: int, *, spaced: bool, dtype: str) -> DataFrame:
    """doc_id, tie, row, the shard that the row goes to, n and ids (as they are written)."""
    kind = np.dtype(dtype)

    def run(batches):
        enc, end = Encoder.shared(tokenizer_path, spaced), np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            sizes, ids = [], []
            for x in enc.encode(texts_of(b)):
                flat = np.frombuffer(x + end, "<u4")
                if flat.max() > np.iinfo(kind).max:
                    raise ValueError(f"id {flat.max()} does not fit {kind}")
                sizes.append(len(flat)), ids.append(flat.astype(kind).tobytes())
            keys = [b.column(c) for c in ("doc_id", "tie", "row")]
            shard = [bisect.bisect_right(firsts, k) for k in zip(*(c.to_pylist() for c in keys))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(shard, pa.int32()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "tie", "row", "shard", "n", "ids"])

    return rows.mapInArrow(run, "doc_id long, tie long, row long, shard int, n long, ids binary")


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, *, spaced: bool, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode and write docs in ascending id order under the folder URI out; returns the manifest.

    Beside the sample of keys only one row per shard comes to the driver, for the prefix sums."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
    firsts, shards = boundaries(src, shards)
    system, path = _filesystem(out)
    system.create_dir(path, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        shard, ids, lengths = TaskContext.get().partitionId(), [], []
        name = f"shard-{shard:05d}-{uuid.uuid4().hex}"

        def flat():
            for b in batches:
                ids.append(b.column("doc_id").to_numpy(zero_copy_only=False))
                lengths.append(b.column("n").to_numpy(zero_copy_only=False))
                yield from (x.as_buffer() for x in b.column("ids"))

        _put(out, f"{name}.bin", flat())
        if ids:
            n = np.concatenate(lengths)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype("<u8")
            _put(out, f"{name}.idx", [np.array([len(n)], "<u8").tobytes(), offsets.tobytes(), np.concatenate(ids).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": pa.array([name]), "n_docs": pa.array([len(n)], pa.int64()), "n_ids": pa.array([int(n.sum())], pa.int64())})

    rows = encoded(src, firsts, tokenizer_path, end_id, spaced=spaced, dtype=dtype)
    ordered = rows.repartitionById(shards, "shard").sortWithinPartitions("doc_id", "tie", "row")
    sizes = sorted(tuple(r) for r in ordered.mapInArrow(write, "shard int, name string, n_docs long, n_ids long").collect())
    manifest, base = [], 0
    for shard, name, n_docs, n_ids in sizes:
        manifest.append((shard, name, n_docs, n_ids, base))
        base += n_ids
    known = {name for _, name, *_ in manifest}
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.base_name.startswith("shard-") and info.base_name.rpartition(".")[0] not in known:
            system.delete_file(info.path)
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest.parquet")
    return spark.read.schema(_MANIFEST).parquet(f"{out}/manifest.parquet")


def read_token_files(spark: SparkSession, out: str, *, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches):
        for b in batches:
            for name, n, base in zip(b.column("name").to_pylist(), b.column("n_docs").to_pylist(), b.column("base").to_pylist()):
                index, flat = _ranges(out, f"{name}.idx", "<i8"), _ranges(out, f"{name}.bin", dtype)
                for at in range(0, n, 4096):
                    to = min(n, at + 4096)
                    offsets, ids = index(1 + at, 2 + to), index(n + 2 + at, n + 2 + to)
                    # so many documents at once as a few MB of ids are
                    i = at
                    while i < to:
                        j = max(int(np.searchsorted(offsets, offsets[i - at] + (1 << 21), "right")) - 1 + at, i + 1)
                        span = flat(int(offsets[i - at]), int(offsets[j - at]))
                        own = [x.astype("<u4") for x in np.split(span, (offsets[i - at + 1 : j - at] - offsets[i - at]).astype(np.intp))]
                        cols = {"doc_id": pa.array(ids[i - at : j - at], pa.int64()), "start": pa.array(base + offsets[i - at : j - at], pa.int64()), "n_tokens": pa.array([len(x) for x in own], pa.int64()), "ids_crc32": pa.array([crc32(x.tobytes()) for x in own], pa.int64())}
                        if with_ids:
                            cols["ids"] = pa.array([x.astype("i8") for x in own], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(cols)
                        i = j

    manifest = spark.read.schema(_MANIFEST).parquet(f"{out}/manifest.parquet")
    return manifest.repartitionByRange(max(manifest.count(), 1), "shard").select("name", "n_docs", "base").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, *, spaced: bool, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a new folder in the shared place and read the files back."""
    out = fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, out, tokenizer_path, end_id, spaced=spaced, dtype=dtype, id_col=id_col, text_col=text_col)
    return read_token_files(docs.sparkSession, out, dtype=dtype)
