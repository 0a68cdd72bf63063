"""An embedder fitted on the corpus: a truncated singular value decomposition of hashed TF-IDF, by subspace iteration.

The matrix of documents and WIDTH hashed words is never built. A pass multiplies each partition's rows A by a basis Q and
back, A'(A Q); the sums over partitions are WIDTH rows of some dozen numbers, pre-aggregated before they are shuffled, and
only they come to the driver, where the basis is made orthogonal again. A few passes give the leading right singular
vectors; a text's embedding is its TF-IDF row times these, at unit length. The model is WIDTH times `dimension` numbers,
whatever the corpus' size, so it travels with the tasks.

Defined results: null and empty texts, and texts of words that are in all documents' buckets alone, have the zero vector;
documents count once per row; an empty corpus cannot be fitted; the same corpus in other partitions gives the same
subspace up to rounding, each vector's largest entry is positive.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.hooks import register_embedder
from folioscope.sources.places import written

#: Buckets of words, passes over the corpus, vectors beside the wanted ones, texts that are multiplied at once.
WIDTH, PASSES, SPARE, TEXTS = 8_192, 4, 8, 64
_WORD = re.compile(r"\w+")


def counts_of(text: str | None, width: int) -> dict[int, float]:
    """Damped counts of a text's words by bucket, with the sign that their hash gives them."""
    out: dict[int, float] = {}
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        h = zlib.crc32(word.encode())
        at = h % width
        out[at] = out.get(at, 0.0) + (1 + np.log(n)) * (1 if h >> 31 else -1)
    return out


@dataclass
class Latent:
    """idf by bucket and the basis (bucket, dimension)."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            own = counts_of(text, len(self.idf))
            at = np.fromiter(own, int, len(own))
            row = np.fromiter(own.values(), float, len(own)) * self.idf[at]
            size = np.linalg.norm(row)
            v = (row / size) @ self.basis[at] if size else np.zeros(self.basis.shape[1])
            length = np.linalg.norm(v)
            out.append((v / length if length > 1e-12 else v).tolist())
        return out


def _rows(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of unit TF-IDF rows; texts without a word have none."""
    row, at, value = [], [], []
    for i, text in enumerate(texts):
        own = counts_of(text, len(idf))
        cols = np.fromiter(own, int, len(own))
        vals = np.fromiter(own.values(), float, len(own)) * idf[cols]
        size = np.linalg.norm(vals)
        if size:
            row.append(np.full(len(cols), i))
            at.append(cols)
            value.append(vals / size)
    return (np.concatenate(x) if x else np.empty(0, k) for x, k in ((row, int), (at, int), (value, float)))


def _summed(rows: DataFrame, key: str, vector: str) -> dict[int, np.ndarray]:
    """Sums of vectors by key, pre-aggregated; at most a row per bucket."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    out = rows.select(key, array_to_vector(vector).alias("v")).groupBy(key).agg(Summarizer.sum(F.col("v")).alias("v"))
    return {r[key]: r.v.toArray() for r in out.collect()}


def fit(docs: DataFrame, dimension: int = 64, *, text_col: str = "text", width: int = WIDTH, passes: int = PASSES, seed: int = 7) -> Latent:
    """Fit on all texts of docs, `passes` + 2 times read."""
    texts = written(docs.select(F.col(text_col).cast("string").alias("text")), "latent-texts")

    def buckets(batches):
        for b in batches:
            held = np.zeros(width)
            for x in b.column("text"):
                held[list(counts_of(x.as_py(), width))] += 1
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(held[at])})

    n = texts.count()
    if not n:
        raise ValueError("there is no text to fit")
    held = texts.mapInArrow(buckets, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    idf = np.zeros(width)
    for r in held:
        idf[r.at] = np.log((1 + n) / (1 + r.n))
    size = min(dimension + SPARE, width)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(0, 1, (width, size)))[0]

    def product(basis: np.ndarray) -> np.ndarray:
        """A'(A Q) over all texts."""

        def run(batches):
            total = np.zeros_like(basis)
            for b in batches:
                for at in range(0, b.num_rows, TEXTS):
                    row, cols, vals = _rows(b.column("text").slice(at, TEXTS).to_pylist(), idf)
                    y = np.zeros((TEXTS, basis.shape[1]))
                    np.add.at(y, row, vals[:, None] * basis[cols])
                    np.add.at(total, cols, vals[:, None] * y[row])
            live = np.flatnonzero(np.abs(total).sum(1))
            if len(live):
                yield pa.RecordBatch.from_pydict({"at": pa.array(live), "v": pa.array(list(total[live]), pa.list_(pa.float64()))})

        out = np.zeros_like(basis)
        for at, v in _summed(texts.mapInArrow(run, "at long, v array<double>"), "at", "v").items():
            out[at] = v
        return out

    for _ in range(passes):
        basis = np.linalg.qr(product(basis))[0]
    values, turn = np.linalg.eigh((small := basis.T @ product(basis)) / 2 + small.T / 2)
    best = np.argsort(-values, kind="stable")[:dimension]
    vectors = basis @ turn[:, best]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Latent(idf, vectors, np.sqrt(np.maximum(values[best], 0)))


def register(model: Latent, name: str = "latent", threshold: float = 0.3) -> str:
    """Make the model an embedder by name, for embed, index_documents and KnowledgeBase."""
    register_embedder(name, lambda: model, model.basis.shape[1], threshold)
    return name


def embedding(text: Column, model: Latent) -> Column:
    """The embedding of a text column, in batches by predict_batch_udf."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    def make():
        return lambda texts: np.array(model([x or "" for x in np.ravel(texts)]), np.float32)

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=256)(F.coalesce(text, F.lit("")))
