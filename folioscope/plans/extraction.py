"""Text of paged files, a window of pages at a time: a window that fails costs its pages, not the file."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import shifted_page_images

#: name -> factory of a reader (content, first page, last page) -> text; pages count from 1.
PAGE_READERS: dict[str, Callable[[], Callable[[bytes, int, int], str]]] = {}


def register_page_reader(name: str, factory: Callable[[], Callable[[bytes, int, int], str]]) -> None:
    PAGE_READERS[name] = factory


#: Plain text whose pages end with form feeds.
register_page_reader("form_feed", lambda: lambda data, first, last: "".join(data.decode("utf-8").split("\f")[first - 1 : last]))


def extract_windows(files: DataFrame, reader: str, *, step: int = 3, most: int = 500, least: int = 50) -> DataFrame:
    """(path, content, page_count) -> path, first, last, text, error; text of `least` characters or less
    is an error too, and so are the pages beyond `most`, which are not read (also where the page count is not known
    and the last window read still had text)."""
    if reader not in PAGE_READERS:
        raise ValueError(f"unknown page reader {reader!r}; there are: {', '.join(sorted(PAGE_READERS)) or 'none'}")
    factory = PAGE_READERS[reader]

    def run(batches):
        read = factory()
        for b in batches:
            out: list[tuple] = []
            for path, data, pages in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("page_count").to_pylist()):
                total = min(pages or most, most)
                for first in range(1, total + 1, step):
                    last = min(first + step - 1, total)
                    try:
                        text = read(data, first, last)
                        ok = len(text or "") > least
                        out.append((path, first, last, text if ok else None, None if ok else "Empty or insufficient content"))
                    except Exception as e:  # noqa: BLE001 - whatever a reader raises is that window's outcome
                        out.append((path, first, last, None, f"{type(e).__name__}: {e}"))
                if not pages and out[-1][3] is not None:
                    out.append((path, most + 1, None, None, f"Not read: what is beyond {most} pages"))
                if pages and pages > most:
                    out.append((path, most + 1, pages, None, f"Not read: more than {most} pages"))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "first", "last", "text", "error"])

    return files.select("path", "content", "page_count").mapInArrow(run, "path string, first int, last int, text string, error string")


def stitched(windows: DataFrame) -> DataFrame:
    """path, content (windows in order, each under a comment that names its pages), good, failed."""
    piece = F.concat(F.lit("\n\n<!-- Pages "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(" -->\n\n\n"), F.col("text"))
    own = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(F.col("first").alias("o"), piece.alias("p")))))
    return windows.groupBy("path").agg(F.array_join(F.transform(own, lambda x: x["p"]), "\n").alias("content"), F.count("text").alias("good"), F.count_if(F.col("text").isNull()).alias("failed"))


def with_header(extracted: DataFrame, pages: DataFrame) -> DataFrame:
    """Contents under comments that say how the extraction went; nothing where no window was read."""
    out = extracted.join(pages.select("path", "page_count"), "path", "left")
    line = lambda label, value: F.concat(F.lit(f"<!-- {label}: "), value.cast("string"), F.lit(" -->"))
    head = F.concat_ws("\n", F.concat(F.lit("<!-- Extraction of "), F.element_at(F.split("path", "/"), -1), F.lit(" -->")), line("Actual page count", F.nullif(F.col("page_count"), F.lit(0))), line("Successful chunks", F.col("good")), line("Failed chunks", F.col("failed")))
    return out.withColumn("content", F.when(F.col("good") > 0, F.concat(head, F.lit("\n\n"), F.col("content"))).otherwise("")).drop("page_count")


def converted(parts: DataFrame) -> DataFrame:
    """(path, first_page from 0, text) -> path, content: parts in order, image names counted through."""
    moved = shifted_page_images(F.col("text"), F.col("first_page"))
    own = F.array_sort(F.collect_list(F.struct(F.col("first_page").alias("o"), moved.alias("t"))))
    return parts.groupBy("path").agg(F.array_join(F.transform(own, lambda x: x["t"]), "\n\n").alias("content"))
