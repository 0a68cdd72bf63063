"""Operator 3, best-fit packing: hierarchical residual packing of token pieces into sequences.

1. Every document is encoded and cut into pieces of at most `size` ids (only longer ones are cut;
   the first piece takes the remainder, the others are full). Each task packs its own pieces by
   best fit, longest first, CHUNK pieces at a time, and emits the nearly full bins (at most 1 / SPARE of a
   sequence free) that hold a long piece. Full pieces are sequences of their own.
2. All other bins go on, however many they are: what they hold are the items of the rounds above. An item is
   its length, so a task hands on a count per length, and a group of FAN_IN tasks is packed by best fit with
   equal bins as one (`best_fit_counts`): at most FAN_IN * size rows in, whatever the input's size. A
   group emits its nearly full bins and hands on the counts of the rest, up a tree; the last one emits all.
3. What a group emitted says which of its items, counted per length, lie where. That is sent back down: a
   group's items are its children's, one child after the other, so joins on group and length end at
   ranges of a task's own items, and each piece finds its range.

Defined results: a null or empty text is a piece of the end id alone; an empty table gives no
rows; repeated rows are packed once each; ties go by length, then by arrival in the written table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.common import materialise, slices, texts_of
from folioscope.llm.tokens import Encoder, crc32

SPARE, FAN_IN, CHUNK = 128, 32, 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, live boolean"


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest first: per item its bin and its place there, and per bin its fill.

    A bit per free amount says whether an open bin has just that much room, so the fullest bin
    that still takes an item is found by one shift and one lowest set bit.
    """
    bins, at, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], at[i] = b, fills[b]
        fills[b] += need
        if left := room - need:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, at, fills


def emitted(fills, longest, size: int):
    """Which bins are emitted: nearly full ones that hold a piece of more than half a sequence. Every packing needs a bin
    for each of these; bins of short pieces alone go on, for elsewhere those may fill up what is half empty."""
    return (np.asarray(fills) >= size - size // SPARE) & (2 * np.asarray(longest) > size)


def best_fit_counts(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of so many items of each length: (lengths in a bin, number of such bins).

    Bins of the same content are one entry, so an item goes into all bins that are the best for it at once."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], need: int, times: int, n: int, room: int) -> None:
        if n:
            by_room.setdefault(room - times * need, []).append((content + (need,) * times, n))

    for need in sorted(counts, reverse=True):
        left = counts[need]
        # the best bin for one item is the best for the next one, too, until that does not fit any more
        for room in sorted(r for r in by_room if r >= need):
            times = room // need
            for content, n in by_room.pop(room) if left else ():
                whole = min(n, left // times)
                put(content, need, times, whole, room)
                left -= whole * times
                rest = min(left, times) if whole < n else 0
                put(content, need, rest, 1 if rest else 0, room)
                left -= rest
                put(content, need, 0, n - whole - (rest > 0), room)
        put((), need, size // need, left // (size // need), size)
        put((), need, left % (size // need), 1 if left % (size // need) else 0, size)
    return [x for room in sorted(by_room) for x in by_room[room]]


_PLAN = "kind string, node long, child long, length long, first long, n long, seq long, offset long"


def _merge(size: int, level: int, last: bool):
    """Pack a group's items. Rows: `base` (a child's items of a length are the group's from `first` on), `plan` (the
    group's n items from `first` on lie in the sequences from `seq` on, at `offset`), `left` (n items go on, which
    were those from `first` on)."""

    def merge(pdf):
        pdf = pdf.sort_values(["child", "length"], ignore_index=True)
        node = int(pdf["node"].iloc[0])
        rows, counts = [], {}
        for child, length, n in zip(pdf["child"].tolist(), pdf["length"].tolist(), pdf["n"].tolist()):
            rows.append(("base", node, child, length, counts.get(length, 0), n, 0, 0))
            counts[length] = counts.get(length, 0) + n
        used, seq = dict.fromkeys(counts, 0), (level << 24 | node) << 32
        for content, n in best_fit_counts(counts, size):
            if not last and not emitted(sum(content), content[0], size):
                continue
            offset = 0
            for length in content:
                # numbers under zero are not a task's
                rows.append(("plan", node, -1, length, used[length], n, -seq - n, offset))
                used[length] += n
                offset += length
            seq += n
        rows += [("left", node, -1, length, used[length], n - used[length], 0, 0) for length, n in counts.items() if n > used[length]]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PLAN.split(", ")])

    return merge


def _placed(counts: DataFrame, tasks: int, size: int) -> DataFrame:
    """(task, length, n) -> (bin, length, first, n, seq, offset): a task's n items of a length from `first` on lie in the
    sequences from `seq` on, at `offset`."""
    level = counts.select((F.col("bin").cast("long")).alias("child"), "length", "n")
    rounds, width, k = [], 1, 0
    while True:
        width, k = width * FAN_IN, k + 1
        grouped = level.withColumn("node", F.floor(F.col("child") / FAN_IN).cast("long"))
        rounds.append(materialise(grouped.groupBy("node").applyInPandas(_merge(size, k, width >= tasks), _PLAN), "packed-tree"))
        if width >= tasks:
            break
        level = rounds[-1].filter("kind = 'left'").select(F.col("node").alias("child"), "length", "n")
    range_ = ["length", "first", "n", "seq", "offset"]
    down = None
    for now in reversed(rounds):
        own = now.filter("kind = 'plan'").select("node", *range_)
        if down is not None:
            # what came from above counts the items that went on from here
            shift = now.filter("kind = 'left'").select("node", "length", F.col("first").alias("shift"))
            own = own.unionByName(down.join(shift, ["node", "length"]).withColumn("first", F.col("first") + F.col("shift")).select("node", *range_))
        base = now.filter("kind = 'base'").select("node", "length", "child", F.col("first").alias("base"), F.col("n").alias("held"))
        start, end = F.greatest("first", "base"), F.least(F.col("first") + F.col("n"), F.col("base") + F.col("held"))
        both = own.join(base, ["node", "length"]).filter(start < end)
        down = both.select(F.col("child").alias("node"), "length", (start - F.col("base")).alias("first"), (end - start).alias("n"), (F.col("seq") + start - F.col("first")).alias("seq"), "offset")
        down = materialise(down, "packed-places")
    return down.withColumnRenamed("node", "bin")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, *, spaced: bool, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence and place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with_ids the piece's ids as little-endian unsigned 32-bit bytes."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _PIECES + ", ids binary" * with_ids

    def local(batches):
        from pyspark import TaskContext

        task, enc = TaskContext.get().partitionId(), Encoder.shared(tokenizer_path, spaced)
        end = np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        names = [x.split()[0] for x in schema.split(", ")]
        # doc_id, piece, start, length, crc and perhaps ids of the chunk's pieces
        held: list[list] = [[] for _ in kinds]
        made, handed = 0, np.zeros(size + 1, np.int64)

        def packed():
            """The chunk's pieces: emitted ones with their bin and place, others with their number among the task's
            items of their length."""
            nonlocal held, made
            lengths = np.array(held[3])
            bins, at, fills = best_fit(lengths, size)
            longest = np.zeros(len(fills), np.int64)
            longest[bins[at == 0]] = lengths[at == 0]
            live = ~emitted(fills, longest, size)[bins]
            number = (task << 32) + made + bins
            number[live] = task
            order = np.flatnonzero(live)
            order = order[np.argsort(lengths[order], kind="stable")]
            own = lengths[order]
            at[order] = handed[own] + np.arange(len(own)) - np.searchsorted(own, own)
            handed[:] += np.bincount(own, minlength=size + 1)
            cols = [pa.array(x, k) for x, k in zip(held, kinds)]
            made += len(fills)
            held = [[] for _ in kinds]
            table = pa.RecordBatch.from_arrays(cols[:5] + [pa.array(number), pa.array(at), pa.array(live)] + cols[5:], names=names)
            for i in range(0, table.num_rows, 20_000):
                yield table.slice(i, 20_000)

        for b in slices(batches):
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(texts_of(b))):
                flat = memoryview(x + end)
                n, at, k = len(flat) // 4, 0, 0
                while at < n:
                    to = at + (n - at - 1) % size + 1
                    part = flat[4 * at : 4 * to]
                    for column, value in zip(held, (doc, k, at, to - at, crc32(part), bytes(part) if with_ids else None)):
                        column.append(value)
                    at, k = to, k + 1
            if len(held[0]) >= CHUNK:
                yield from packed()
        if held[0]:
            yield from packed()

    pieces = materialise(src.mapInArrow(local, schema), "packed-pieces")
    counts = pieces.filter("live").groupBy("bin", "length").agg(F.count(F.lit(1)).alias("n"))
    tasks = (pieces.filter("live").agg(F.max("bin")).first()[0] or 0) + 1
    places = _placed(counts, tasks, size)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    stay = pieces.filter("NOT live").select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    # a range stands before its first piece, so each piece's range is the last one before it
    live = pieces.filter("live").select(*columns, "bin", "at", F.lit(None).cast("struct<first:long,seq:long,offset:long>").alias("range"), F.lit(1).alias("is_piece"))
    ranges = places.select("bin", "length", F.col("first").alias("at"), F.struct("first", "seq", "offset").alias("range"), F.lit(0).alias("is_piece"))
    before = Window.partitionBy("bin", "length").orderBy("at", "is_piece")
    found = live.unionByName(ranges, allowMissingColumns=True).withColumn("range", F.last("range", True).over(before)).filter("is_piece = 1")
    moved = found.select(*columns, (F.col("range.seq") + F.col("at") - F.col("range.first")).alias("sequence_id"), F.col("range.offset").alias("offset"))
    return stay.unionByName(moved)
