"""Chunkers in Arrow batches: page chunks and section chunks.

Both are greedy in a document and independent between documents, and one pass over a document's text: running
lengths say where a chunk starts, and a chunk's pages are looked up among the sorted page marks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import equation_counts

_MARK = re.compile(r"<!-- Pages ([0-9]+)-([0-9]+) -->")
#: White space as Spark's patterns take it, so that both trim alike.
_BLANK = " \t\n\x0b\f\r"
#: Characters of chunks that are put into one Arrow batch.
BATCH_CHARS = 4_000_000


def _page_at(starts: list[int], marks: list[tuple[int, int, int]], position: int, total: int) -> int:
    """Page of a position: spread evenly between a mark and the next; 1 before any mark."""
    i = bisect_right(starts, position)
    if not i:
        return 1
    at, first, last = marks[i - 1]
    end = starts[i] if i < len(starts) else total
    if position >= end:
        return 1
    return first if first == last else min(last, first + int((last - first + 1) * ((position - at) / (end - at)) // 1))


def _paragraph_groups(content: str, most: int) -> Iterator[str]:
    """Paragraphs put together: a new group begins where the text so far and the paragraph are longer than `most`
    together (the blank line between them is not counted). Empty paragraphs at a group's start leave no trace."""
    group: list[str] = []
    length = 0
    for p in content.split("\n\n"):
        if length and length + len(p) > most:
            yield "\n\n".join(group)
            group, length = [p], len(p)
        elif length:
            group.append(p)
            length += 2 + len(p)
        else:
            group, length = [p], len(p)
    yield "\n\n".join(group)


def page_chunks_of(content: str, most: int = 2000) -> Iterator[tuple[str, list[int]]]:
    """Chunks of up to `most` characters with their pages, which eleven places of the chunk tell; [1] without marks.
    Only the last chunk can be blank; it is left out."""
    marks = [(m.start(), int(m[1]), int(m[2])) for m in _MARK.finditer(content)]
    starts, start = [m[0] for m in marks], 0
    groups = list(_paragraph_groups(content, most))
    if not groups[-1].strip(_BLANK):
        groups.pop()
    for text in groups:
        pages = {_page_at(starts, marks, start + len(text) * k // 10, len(content)) for k in range(11)} if marks else {1}
        yield text.strip(_BLANK), sorted(pages)
        start += len(text) + 2


def _chunk_table(docs: DataFrame, id_col: str, text_col: str, kinds: dict[str, tuple[str, pa.DataType]], chunks_of: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """One row per chunk: id, chunk_index and what chunks_of gives. A long document fills several batches."""
    names = [id_col, "chunk_index", *kinds]

    def run(batches):
        for b in batches:
            types = [b.schema.field(0).type, pa.int32(), *[k for _, k in kinds.values()]]
            rows: list[tuple] = []
            size = 0
            for i in range(b.num_rows):
                # one text at a time becomes a Python string
                key, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for index, chunk in enumerate(chunks_of(text or "")):
                    rows.append((key, index, *chunk))
                    size += len(chunk[0])
                    if size >= BATCH_CHARS or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

    own = ", ".join(f"{name} {kind}" for name, (kind, _) in kinds.items())
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, chunk_index int, {own}")


def merge_small(chunks: list[tuple[str, list[str]]], least: int) -> list[tuple[str, list[str]]]:
    """A chunk under `least` characters goes before the next one (whose heading counts), the last one
    behind the one before it."""
    out: list[tuple[str, list[str]]] = []
    waiting: list[str] = []
    heading: list[str] = []
    for text, heading in chunks:
        waiting.append(text)
        whole = "\n\n".join(waiting)
        if len(whole) >= least:
            out.append((whole, heading))
            waiting = []
    if "".join(waiting):
        rest = "\n\n".join(waiting)
        out = [*out[:-1], (f"{out[-1][0]}\n\n{rest}", out[-1][1])] if out else [(rest, heading)]
    return out


def _packed_paragraphs(paragraphs: list[str], most: int, head: int = 0) -> list[str]:
    """Paragraphs put together while head + their joined length stays within `most`."""
    groups: list[list[str]] = []
    length = 0
    for p in paragraphs:
        if groups and (not length or head + length + 2 + len(p) <= most):
            groups[-1].append(p)
            length += len(p) + (2 if length else 0)
        else:
            groups.append([p])
            length = len(p)
    return ["\n\n".join(g).lstrip("\n") if not g[0] else "\n\n".join(g) for g in groups]


def _plain_chunks(text: str, most: int) -> list[str]:
    """Page chunks' texts of a text without headings (the joined length leaves out one blank line)."""
    out, now = [], ""
    for p in text.split("\n\n"):
        if now and len(now) + len(p) > most:
            out.append(now.strip())
            now = p
        else:
            now = f"{now}\n\n{p}" if now else p
    return out + ([now.strip()] if now.strip() else [])


def section_chunks_of(content: str, most: int = 3000, least: int = 200) -> list[tuple[str, list[str]]]:
    """Chunks at the highest level of headings, each with its heading; long sections are cut at blank
    lines and carry their heading line again."""
    levels = [len(h) for h in re.findall(r"(?m)^(#{1,6}) +.+$", content)]
    if not levels:
        return [(t, []) for t in _plain_chunks(content, most)]
    mark = "#" * min(levels)
    starts = [m for m in re.finditer(rf"(?m)^{mark}(?!#) +(.+)$", content)]
    edges = [m.start() for m in starts] + [len(content)]
    out: list[tuple[str, list[str]]] = []
    if preamble := content[: edges[0]].strip():
        out += [(t, []) for t in ([preamble] if len(preamble) <= most else _plain_chunks(preamble, most))]
    for m, end in zip(starts, edges[1:]):
        body = content[m.start() : end].strip()
        heading = re.sub(r"__(.+?)__", r"\1", re.sub(r"\*\*(.+?)\*\*", r"\1", m[1])).strip()
        if len(body) <= most:
            out.append((body, [heading]))
        else:
            line = f"{mark} {heading}"
            parts = _packed_paragraphs(re.split(r"\n\n+", body), most, len(line) + 2)
            out += [(f"{line}\n\n{p.strip()}", [heading]) for p in parts if p.strip()]
    if not out:
        return [(content, [])]
    return merge_small(out, least) if least > 0 else out


def section_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "content", most: int = 3000, least: int = 200) -> DataFrame:
    """One row per chunk: id, chunk_index, content, section (array of its heading)."""

    kinds = {"content": ("string", pa.string()), "section": ("array<string>", pa.list_(pa.string()))}
    return _chunk_table(docs, id_col, text_col, kinds, lambda text: section_chunks_of(text, most, least))


def chunk_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "content", most: int = 2000) -> DataFrame:
    """Page chunks, one per row: id, chunk_index, content, page_numbers."""
    kinds = {"content": ("string", pa.string()), "page_numbers": ("array<int>", pa.list_(pa.int32()))}
    return _chunk_table(docs, id_col, text_col, kinds, lambda text: page_chunks_of(text, most))


def with_metadata(chunks: DataFrame, offset: int = 0) -> DataFrame:
    """Chunks with their ordinal (from `offset`), length and equation counts."""
    e = equation_counts(F.col("content"))
    return chunks.select("*", e.alias("e")).select(*[c for c in chunks.columns if c != "chunk_index"], (F.col("chunk_index") + offset).alias("chunk_index"), F.length("content").alias("chunk_length"), "e.*")
