"""Sinks: tables, CSV, JSON lines, BibTeX, content-addressed copies."""

from __future__ import annotations

import hashlib
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.names import bib_entry, citation_key


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bib_entries(resolved: DataFrame) -> DataFrame:
    """content_sha256, citation_key, value (the entry) of resolved metadata."""
    key = citation_key(F.col("authors"), F.col("year"), F.col("title"), F.col("content_sha256"))
    keyed = resolved.withColumn("citation_key", key)
    entry = bib_entry(*[F.col(c) for c in ("citation_key", "doc_type", "authors", "year", "title", "journal", "abstract")])
    return keyed.select("content_sha256", "citation_key", entry.alias("value"))


def write_bib(resolved: DataFrame, path: str) -> None:
    bib_entries(resolved).select("value").write.mode("overwrite").text(path)


def embedded_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with an id that stays the same when a document is read again."""
    return chunks.withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def store_copy(path: str, root: str, sha: str, name: str) -> str:
    """Copy a file to its content-addressed place and check the copy; a file that is there stays."""
    into = os.path.join(root, "sha256", sha[:2], sha[2:4], sha)
    os.makedirs(into, exist_ok=True)
    there = sorted(x for x in os.listdir(into) if x.lower().endswith(".pdf"))
    if len(there) > 1:
        raise ValueError(f"more than one file in {into}")
    if there:
        return os.path.join(into, there[0])
    to = os.path.join(into, name)
    shutil.copy2(path, to)
    with open(to, "rb") as f:
        if hashlib.file_digest(f, "sha256").hexdigest() != sha:
            os.remove(to)
            raise ValueError(f"the copy of {path} differs from it")
    return to


def store_files(plan: DataFrame, root: str) -> DataFrame:
    """(content_sha256, path, name) -> the same with stored_path and error; root is a shared folder.

    Copies are made by the tasks; a copy that is repeated finds its file there."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for sha, path, name in zip(pdf["content_sha256"], pdf["path"], pdf["name"]):
                try:
                    out.append((store_copy(path.removeprefix("file:"), root, sha, name), None))
                except (OSError, ValueError) as e:
                    out.append((None, str(e)))
            yield pdf.assign(stored_path=pd.Series([x for x, _ in out], dtype=object, index=pdf.index), error=pd.Series([x for _, x in out], dtype=object, index=pdf.index))

    return plan.select("content_sha256", "path", "name").mapInPandas(run, "content_sha256 string, path string, name string, stored_path string, error string")
