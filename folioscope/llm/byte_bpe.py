"""Operator 13, byte-level BPE encoding and decoding as a monoid tree reduction.

Encoded segments are a monoid: `join(encode(x), encode(y)) == encode(x + y)`. A match of the pattern is
encoded by halves, recursively, and neighbours are joined: the tokens next to the boundary are merged
anew, in a window that grows on the side that is not stable yet.

When is a side stable? The merges run lowest rank first, leftmost among equals. Restricted to a part of
the bytes that no merge has crossed so far, such a run is the part's own run. So a row of tokens is the
encoding of its bytes exactly if each two neighbours, alone, encode as themselves: the first merge that
crossed a boundary would cross it in the run of the two alone, too. Tokens outside a window were
neighbours in an encoding before, tokens inside are neighbours in the window's encoding, and the two
pairs at the window's edges are looked at (`stays`). Nothing else can change.

Between matches of the pattern nothing merges, so there the product is plain concatenation: of ids up the
tree, and of bytes on the way back. Distinct matches are encoded once a worker. Texts are rows of their
own: no shuffle; a match of any length costs n log n, long runs of one letter included.

Defined results: a null or empty text has no ids; ids are those of the tiktoken library (a match that is an
entry is that entry); equal rows give equal rows; an empty table gives no rows; other columns are ignored;
an id that the vocabulary lacks is an error when decoding.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keep_only, remembers, slices, texts_of

#: Bytes that are merged directly; longer matches are halved. A power of two: halves of a periodic run then
#: end where its tokens do.
LEAF = 64
#: Distinct matches and pairs that a worker remembers; beyond it the memory starts anew. Longer matches are
#: not remembered.
CACHE_MATCHES, CACHE_PAIRS, CACHE_CHARS = 600_000, 200_000, 200
_LOADED: dict[tuple[str, str], "ByteBpe"] = {}
remembers("byte_bpe", _LOADED.clear)


class ByteBpe:
    """A vocabulary of byte strings by rank, from a file of lines `base64 rank`."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}
        self.entries = {rank: entry for entry, rank in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @staticmethod
    def shared(path: str, pattern: str) -> "ByteBpe":
        keep_only("byte_bpe")
        if (path, pattern) not in _LOADED:
            _LOADED.clear()
            _LOADED[path, pattern] = ByteBpe(path, pattern)
        return _LOADED[path, pattern]

    def merged(self, window: bytes) -> list[int]:
        """The merges themselves, over a heap of neighbouring parts: n log n."""
        n, ranks = len(window), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks(window[i : i + 2])) is not None]
        heapify(heap)
        # after[i] is where the part from i ends; 0 where no part begins any more
        while heap:
            _, i, end = heappop(heap)
            mid = after[i]
            if not mid or mid >= end or after[mid] != end:
                continue
            after[i], after[mid] = end, 0
            if end < n:
                before[end] = i
                if (rank := ranks(window[i : after[end]])) is not None:
                    heappush(heap, (rank, i, after[end]))
            if i and (rank := ranks(window[before[i] : end])) is not None:
                heappush(heap, (rank, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[window[i : after[i]]])
            i = after[i]
        return out

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens next to each other stay as they are."""
        pair = (left, right)
        if (stable := self.pairs.get(pair)) is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            stable = self.pairs[pair] = self.merged(self.entries[left] + self.entries[right]) == [left, right]
        return stable

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes together."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        i, j, grow_left, grow_right = len(left), 0, 1, 1
        while True:
            i, j = max(i - grow_left, 0), min(j + grow_right, len(right))
            window = self.merged(self.joined(left[i:] + right[:j]))
            left_holds = not i or self.stays(left[i - 1], window[0])
            right_holds = j == len(right) or self.stays(window[-1], right[j])
            if left_holds and right_holds:
                return left[:i] + window + right[j:]
            # the unstable side's window doubles
            grow_left = 0 if left_holds else len(left) - i
            grow_right = 0 if right_holds else j

    def tree(self, match: bytes) -> list[int]:
        if len(match) <= LEAF:
            return self.merged(match)
        half = LEAF << ((len(match) - 1) // LEAF).bit_length() - 1
        return self.join(self.tree(match[:half]), self.tree(match[half:]))

    def _learn(self, match: str) -> tuple[int, ...]:
        own = match.encode()
        ids = (self.ranks[own],) if own in self.ranks else tuple(self.tree(own))
        if len(match) <= CACHE_CHARS:
            if len(self.known) >= CACHE_MATCHES:
                self.known.clear()
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, learn, put = self.known.get, self._learn, out.extend
        for match in self.matches(text):
            put(known(match) or learn(match))
        return out

    def joined(self, ids: list[int]) -> bytes:
        """Decoding: the entries' bytes, concatenated."""
        return b"".join(map(self.entries.__getitem__, ids))


def encode_ids(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: array<int>."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bpe = ByteBpe.shared(path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.encode(x) for x in texts_of(b)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes: what the ids stand for (null ids: no bytes). A lone id may be a part of a letter."""
    src = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        bpe = ByteBpe.shared(path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.joined(x or []) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded again, in one pass over the texts."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bpe = ByteBpe.shared(path, pattern)
        for b in slices(batches):
            sizes, of_ids, of_bytes = [], [], []
            for text in texts_of(b):
                ids = bpe.encode(text)
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.joined(ids)).hexdigest())
            cols = [b.column("doc_id"), pa.array(np.array(sizes, "i8")), pa.array(of_ids), pa.array(of_bytes)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
