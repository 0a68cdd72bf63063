"""Folders as tables and as streams: a data source that lists files in parallel and goes on where it was.

    register(spark)
    spark.read.format("file_listing").option("pattern", "*.pdf").load("/papers")
    spark.readStream.format("file_listing").option("roots", "/papers,/inbox").load()

The folders of the first level below each root are dealt to partitions, at most PARTITIONS of them, and walked there; only
their names pass the driver. Filters on size, modified, root and the beginning of path are taken over: files (and by the path whole
folders) that they leave out make no rows. A root that cannot be read is a row with its error, not a failed query. On
local disks links are followed to what they stand for, each folder and file once.

A stream's offset is a time of modification: a batch is what was modified after the last one's and up to its own, which
lies `settle` seconds (2) back, so that files of the same moment come together. Files that are moved in with an older
time than the offset are not seen by it; a batch listing sees them.

Hidden files (names that begin with "." or "_") are left out. Stores are those that pyarrow's file systems open.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

PARTITIONS, SETTLE = 64, 2.0
SCHEMA = "path string, size long, modified timestamp, root string, error string"
_COMPARED = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


@dataclass
class Folders(InputPartition):
    """What a task lists: (root, folder, whether what is below it is meant, too), and between which times (ns)."""

    folders: list[tuple[str, str, bool]]
    after: int = -1
    until: int | None = None


def _open(uri: str) -> tuple[fs.FileSystem, str, str]:
    """A file system, the path in it, and what a path is prefixed with to be a URI again."""
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri), ""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: len(uri) - len(path.lstrip("/"))] if not uri.startswith("file:") else ""


def _hidden(path: str) -> bool:
    return path.rsplit("/", 1)[-1][:1] in ("_", ".")


class Listing:
    """What batch and stream readers share: options, the dealing of folders, and the walk."""

    def __init__(self, options: dict):
        named = options.get("roots") or options.get("path") or ""
        self.roots = [x.strip() for x in named.split(",") if x.strip()]
        if not self.roots:
            raise ValueError("file_listing needs a path or roots")
        self.pattern = options.get("pattern", "*")
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.settle = float(options.get("settle", SETTLE))
        self.tests: list[tuple] = []

    def deal(self) -> list[Folders]:
        own: list[tuple[str, str, bool]] = []
        for root in self.roots:
            own.append((root, "", False))
            if self.recursive:
                try:
                    system, path, _ = _open(root)
                    own += [(root, i.base_name, True) for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory and not _hidden(i.path)]
                except (OSError, ValueError):
                    # the root's own row says why
                    pass
        n = min(len(own), PARTITIONS)
        return [Folders(own[i::n]) for i in range(n)]

    def rows(self, part: Folders) -> Iterator[tuple]:
        for root, folder, below in part.folders:
            try:
                system, base, lead = _open(root)
                local = isinstance(system, fs.LocalFileSystem)
                if not folder and system.get_file_info(base).type != fs.FileType.Directory:
                    raise FileNotFoundError(f"{root} is no folder")
                yield from self._walk(system, f"{base.rstrip('/')}/{folder}".rstrip("/") or "/", lead, root, below, part, set() if local else None)
            except (OSError, ValueError) as error:
                yield (None, None, None, root, f"{type(error).__name__}: {error}")

    def _walk(self, system, folder: str, lead: str, root: str, below: bool, part: Folders, seen: set | None) -> Iterator[tuple]:
        todo = [folder]
        while todo:
            at = todo.pop()
            if seen is not None:
                real = os.path.realpath(at)
                if real in seen:
                    continue
                seen.add(real)
            for info in system.get_file_info(fs.FileSelector(at)):
                if _hidden(info.path):
                    continue
                if info.type == fs.FileType.Directory:
                    if below and self._can_begin(lead + info.path + "/"):
                        todo.append(info.path)
                elif info.type == fs.FileType.File and fnmatch(info.base_name.lower(), self.pattern.lower()):
                    path = os.path.realpath(info.path) if seen is not None else info.path
                    if path != info.path:
                        # a link and what it stands for are one file
                        if path in seen:
                            continue
                        seen.add(path)
                    ns = info.mtime_ns or 0
                    if ns > part.after and (part.until is None or ns <= part.until):
                        row = (lead + path, info.size, datetime.fromtimestamp(ns // 1000 / 1e6, UTC), root, None)
                        if all(test(row) for test in self._row_tests()):
                            yield row

    def _row_tests(self):
        names = {"path": 0, "size": 1, "modified": 2, "root": 3}
        for column, kind, value in self.tests:
            i = names[column]
            if kind is StringStartsWith:
                yield lambda row, i=i, v=value: row[i].startswith(v)
            else:
                yield lambda row, i=i, v=value, f=_COMPARED[kind]: f(row[i], v)

    def _can_begin(self, folder: str) -> bool:
        """Whether a path below the folder can begin as asked for."""
        return all(folder.startswith(v) or v.startswith(folder) for c, k, v in self.tests if k is StringStartsWith and c == "path")


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.listing = Listing(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if isinstance(value, datetime) and value.tzinfo is None:
                value = value.astimezone(UTC)
            if type(f) in _COMPARED and column in ("size", "modified", "root") or type(f) is StringStartsWith and column == "path":
                self.listing.tests.append((column, type(f), value))
            # rows that tell of errors have nulls, so Spark looks at the filter, too
            yield f

    def partitions(self) -> list[Folders]:
        return self.listing.deal()

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.listing.rows(partition)


class ListingStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.listing = Listing(options)

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - int(self.listing.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        if end["ns"] <= start["ns"]:
            return []
        return [Folders(p.folders, start["ns"], end["ns"]) for p in self.listing.deal()]

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.listing.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; it takes filters over, which the session has to allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileListing)
