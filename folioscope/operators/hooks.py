"""Extension points by name: embedders and extractors that run as Arrow batches on the executors.

A hook is a function of a list of inputs, made on each worker by its factory (so models load there
once). Models and services themselves are no part of this package; `hashing` is a deterministic
embedder for tests and for corpora that need no model.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

EMBEDDERS: dict[str, dict] = {}
EXTRACTORS: dict[str, Callable] = {}


def _named(table: dict, name: str, kind: str):
    if name not in table:
        raise ValueError(f"unknown {kind} {name!r}; there are: {', '.join(sorted(table)) or 'none'}")
    return table[name]


def register_embedder(name: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, minimum_threshold: float) -> None:
    EMBEDDERS[name] = {"factory": factory, "dimension": dimension, "minimum_threshold": minimum_threshold}


def register_extractor(name: str, factory: Callable[[], Callable[[bytes], str]]) -> None:
    EXTRACTORS[name] = factory


def embedder(name: str) -> dict:
    return _named(EMBEDDERS, name, "embedder")


def embed(chunks: DataFrame, name: str, text_col: str = "content", out: str = "embedding") -> DataFrame:
    """Chunks with their vectors, Arrow batch by batch."""
    factory = embedder(name)["factory"]

    def run(batches):
        model = factory()
        for b in batches:
            vectors = model([x or "" for x in b.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, out])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField(out, ArrayType(FloatType()))]))


def extract(files: DataFrame, name: str) -> DataFrame:
    """(path, content) -> (path, text, error): a file that fails is a row with its error, not a lost job."""
    factory = _named(EXTRACTORS, name, "extractor")

    def run(batches):
        read = factory()
        for b in batches:
            texts, errors = [], []
            for data in b.column("content").to_pylist():
                try:
                    texts.append(read(data))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever an extractor raises is that file's outcome
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def hashing_embedder(dimension: int = 64):
    """Words hashed to signed places of a unit vector."""

    def model(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return model


register_embedder("hashing", hashing_embedder, 64, 0.1)
register_extractor("text", lambda: lambda data: data.decode("utf-8"))


class Retry(Exception):
    """Raised by a lookup that should be tried again later (a service that asks to slow down)."""


LOOKUPS: dict[str, Callable[[], Callable[[str], str]]] = {}
#: Rows and characters of keys and answers that a task of look_up holds before it hands them on.
HELD_ROWS, HELD_CHARS = 500, 1_000_000


def register_lookup(name: str, factory: Callable[[], Callable[[str], str]]) -> None:
    LOOKUPS[name] = factory


def look_up(keys: DataFrame, name: str, *, key_col: str = "key", tries: int = 4, base_seconds: float = 1.0) -> DataFrame:
    """(key) -> key, response, error, attempts from a service, each key once.

    A lookup that raises Retry waits base_seconds, then twice as long each time; other errors are the
    row's outcome. Answers are handed on by HELD_ROWS and HELD_CHARS. Responses are text for the functions in functions/responses.py."""
    factory = _named(LOOKUPS, name, "lookup")

    def run(batches):
        import time

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["key", "response", "error", "attempts"])

        ask = factory()
        for b in batches:
            out, held = [], 0
            for key in b.column(0):
                key, answer, error = key.as_py(), None, None
                for attempt in range(1, tries + 1):
                    try:
                        answer, error = ask(key), None
                        break
                    except Retry as e:
                        error = str(e) or "asked to retry"
                        if attempt < tries:
                            time.sleep(base_seconds * 2 ** (attempt - 1))
                    except Exception as e:  # noqa: BLE001 - whatever a lookup raises is that key's outcome
                        error = f"{type(e).__name__}: {e}"
                        break
                out.append((key, answer, error, attempt))
                held += len(key or "") + len(answer or "") + len(error or "")
                if len(out) >= HELD_ROWS or held >= HELD_CHARS:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    return keys.select(keys[key_col].cast("string").alias("key")).distinct().mapInArrow(run, "key string, response string, error string, attempts int")
