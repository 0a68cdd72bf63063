"""Operator 9, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, neighbouring pairs and pairs with one word
between. Training is the FTRL-proximal update with a rate per coordinate and L1, so most weights are
exactly zero: what is sent to the executors are the few that are not.

Labels are learned only from rows whose crc32(doc id as text) mod 4 is not HELD_OUT, and from at
most TRAIN_TOXIC toxic and TRAIN_OTHER other ones (those least by a hash of the id). Toxic texts are
rare, so the sample holds more of them than there are; the intercept is set right by their share among
all labels that may be learned from. The sample is learned in order by one task of an executor, whose
result, the weights, is all that the driver gets. All documents are scored.

Defined results: a null, empty or word-free text has no features and gets the intercept's score;
repeated labels of a document count as toxic if one is; of a document's repeated rows one is learned
from (the least by its features); without any label the intercept is NO_LABELS, a score of nearly 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keep_only, remembers, slices
from folioscope.llm.contamination import words_of

HELD_OUT = 2
#: Labelled rows that the model is fitted on, at most, and passes over them.
TRAIN_TOXIC, TRAIN_OTHER, PASSES = 5_000, 7_000, 8
BITS = 22
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.05
NO_LABELS = -35.0
THRESHOLD = 0.3
_KNOWN_MOST = 150_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_MOST:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()
remembers("word hashes", _HASHES.clear)


def grams(text: str | None) -> np.ndarray:
    """Hashed features of a text, repeats included: words, pairs, pairs with one word between."""
    words = words_of(text)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    a, b, c, d = _MIX
    with np.errstate(over="ignore"):
        parts = [h * a, (h[:-1] * b + h[1:]) * a, (h[:-2] * c + h[2:]) * d]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


def packed(features: np.ndarray) -> bytes:
    """Distinct features in order, as deflated gaps: the sample stays small on the driver."""
    return zlib.compress(np.diff(np.unique(features), prepend=0).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int32)


class Ftrl:
    """Weights of the model; bias is a coordinate that every text has and that L1 spares."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, features: np.ndarray, label: int) -> float:
        at = np.append(features, 1 << BITS)
        w = self.weights(at)
        p = sigmoid(w.sum())
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        return p

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z[:-1]) > L1)
        return at.astype(np.int32), self.weights(at).astype(np.float32), float(self.weights(np.array([1 << BITS]))[0])


def sigmoid(x: float) -> float:
    return 1 / (1 + float(np.exp(-min(max(x, -35.0), 35.0))))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float]:
    """doc_id, label and distinct features of the sample, a row for each document, and the share of toxic
    ones among all that may be learned from; the labels of a bounded number of ids are sent out."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    allowed = named.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != HELD_OUT).groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    share = allowed.agg(F.avg("label")).first()[0] or 0.0
    part = lambda label, rows: allowed.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = part(1, TRAIN_TOXIC).union(part(0, TRAIN_OTHER))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def featured(batches):
        keep_only("word hashes")
        for b in slices(batches):
            own = [packed(grams(x)) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "label": b.column("label"), "features": pa.array(own, pa.binary())})

    joined = src.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    rows = joined.mapInArrow(featured, "doc_id long, label int, features binary")
    return rows.groupBy("doc_id", "label").agg(F.min("features").alias("features")), share


def fit(rows: list[tuple[int, bytes]], share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The compact weights; the intercept moves from the sample's odds of toxic texts to those of `share`."""
    model = Ftrl()
    for _ in range(PASSES):
        for label, features in rows:
            model.learn(unpacked(features), label)
    at, w, bias = model.compact()
    own = sum(label for label, _ in rows) / len(rows)
    if 0 < own < 1 and 0 < share < 1:
        bias += float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return at, w, bias


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """The compact weights, learned by one task from the bounded sample."""
    rows, share = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)

    def learn(batches):
        keep_only()
        held = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("features").to_pylist())]
        held.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[0]))
        if held:
            at, w, bias = fit([(label, features) for _, label, features in held], share)
            yield pa.RecordBatch.from_pydict({"at": pa.array([at.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    got = rows.repartition(1).mapInArrow(learn, "at binary, w binary, bias double").first()
    if got is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), NO_LABELS
    return np.frombuffer(bytes(got.at), np.int32), np.frombuffer(bytes(got.w), np.float32), got.bias


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """The compact weights, sent to all tasks."""
    return docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))


def _dense(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    dense = np.zeros(1 << BITS, np.float32)
    dense[at] = w
    return dense


def _score(text: str | None, dense: np.ndarray, bias: float) -> float:
    mine = grams(text)
    mine = np.unique(mine[dense[mine] != 0])
    return sigmoid(bias + float(dense[mine].sum(dtype=np.float64)))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold)."""
    sent = _fitted(docs, labels, id_col, text_col, label_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def score(batches):
        keep_only("word hashes")
        at, w, bias = sent.value
        dense = _dense(at, w)
        for b in slices(batches):
            out = [_score(x, dense, bias) for x in b.column("text").to_pylist()]
            ids = b.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": pa.array([held_out(x) for x in ids], pa.bool_()), "score": pa.array(out, pa.float64()), "predicted": pa.array([int(x >= threshold) for x in out], pa.int32())})

    return src.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, all columns as they are, whose score is under the threshold; one pass, no shuffle."""
    sent = _fitted(docs, labels, id_col, text_col, label_col)

    def clean(batches):
        keep_only("word hashes")
        at, w, bias = sent.value
        dense = _dense(at, w)
        for b in slices(batches):
            yield b.filter(pa.array([_score(x, dense, bias) < threshold for x in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
