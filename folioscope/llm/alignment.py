"""Operator 12, cross-tokenizer alignment by a dictionary of groups.

Two tokenizers cut the same bytes. Where tokens of both end, a group ends; a group is its A-ids and B-ids,
which alone say what overlaps in it, so all work is done once a distinct group:

1. One pass over the texts. A text is cut before a space behind a non-space, where neither vocabulary joins
   (checked when B's is loaded); each distinct piece is encoded by both libraries and grouped once a worker. A
   row keeps its distinct groups with their frequencies, and the pairs that several of its groups hold.
2. The dictionary: distinct groups with the number of documents that have them; each is expanded into its
   linked pairs once. A pair's count is the sum of its groups' documents, less the times that a document
   has it by more than one group. Counts go back to the groups by joins on pairs.
3. Rows meet their groups' sums by group key. The HOT groups of most documents, whose size is bounded
   (keys of at most 32 bytes), are sent to the rows; the others are joined by a shuffle. What a row gets
   from sent groups is one row before anything is shuffled, so no frequent word is a hot key.

Keys are the ids themselves up to 31 bytes, else their SHA-256.

Defined results: texts that are null or empty, or whose tokens of either kind do not give space + text back,
have zeros and '' for the groups; a text of spaces has its tokens; repeated rows count as documents each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keep_only, materialise, remembers, slices, texts_of
from folioscope.llm.tokens import Encoder

#: Groups whose sums are sent to all tasks: at most HOT * 50 bytes.
HOT = 100_000
#: Distinct pieces and groups that a worker remembers, and the longest of these pieces.
CACHE_PIECES, CACHE_GROUPS, CACHE_CHARS = 250_000, 200_000, 200
#: Where a piece ends: before a space, behind a character that neither rule takes for white space.
_PIECE_END = re.compile(r"(?<=\S)(?= )")
_LOADED: dict[tuple[str, str], "Aligner"] = {}
remembers("alignment", _LOADED.clear)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the
    others for the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if chr(b) not in out:
            out[chr(256 + b - sum(p < b for p in plain))] = b
    return out


class Aligner:
    """Both tokenizers, their entries' bytes, and what was learned of pieces and groups."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Encoder(a_path, True), SentencePieceProcessor(model_file=b_path)
        self.a.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(map(alphabet.__getitem__, entry)) if all(c in alphabet for c in entry) else entry.encode() for entry, i in self.a.tokenizer.get_vocab(True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in pieces):
            raise ValueError("an entry goes on behind a space: texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.a_length = np.zeros(max(self.a_bytes) + 1, "i8")
        for i, x in self.a_bytes.items():
            self.a_length[i] = len(x)
        self.b_length = np.array([len(x) for x in self.b_bytes], "i8")
        self.space = self.b.piece_to_id("▁")
        self.kind = np.dtype("<u2" if max(max(self.a_bytes), len(pieces)) < 1 << 16 else "<u4")
        self.forget()

    @staticmethod
    def shared(a_path: str, b_path: str) -> "Aligner":
        keep_only("alignment")
        if (a_path, b_path) not in _LOADED:
            _LOADED.clear()
            _LOADED[a_path, b_path] = Aligner(a_path, b_path)
        return _LOADED[a_path, b_path]

    def forget(self) -> None:
        """Groups are numbered anew, from 1: between slices of texts only. 0 stands for bytes that do not agree."""
        self.pieces, self.before, self.groups, self.small = {}, {}, {}, {}
        self.keys, self.pairs, self.shown, self.counts = [b""], [np.empty(0, "i8")], [""], [(0, 0, 0)]

    def expand(self, a_ids: list[int], b_ids: list[int]) -> Counter:
        """Linked occurrence pairs of one group, whose tokens end together only at its end."""
        out, j = Counter(), 0
        a_end, b_end = 0, len(self.b_bytes[b_ids[0]])
        for a in a_ids:
            a_end += len(self.a_bytes[a])
            out[a, b_ids[j]] += 1
            while b_end < a_end:
                j += 1
                b_end += len(self.b_bytes[b_ids[j]])
                out[a, b_ids[j]] += 1
        return out

    def key(self, a_ids: list[int], b_ids: list[int]) -> bytes:
        """The number of A-ids (one byte, or 255 and four bytes), A-ids, B-ids."""
        n = len(a_ids)
        return (bytes([n]) if n < 255 else b"\xff" + n.to_bytes(4, "little")) + np.array([*a_ids, *b_ids], self.kind).tobytes()

    def ids_of(self, key: bytes) -> tuple[list[int], list[int]]:
        n, at = (key[0], 1) if key[0] < 255 else (int.from_bytes(key[1:5], "little"), 5)
        ids = np.frombuffer(key, self.kind, offset=at).tolist()
        return ids[:n], ids[n:]

    def group(self, a_ids: tuple[int, ...], b_ids: tuple[int, ...]) -> int:
        """The number of a group that is met for the first time."""
        linked = self.expand(a_ids, b_ids)
        self.groups[a_ids, b_ids] = number = len(self.keys)
        self.keys.append(self.key(a_ids, b_ids))
        self.pairs.append(np.array([x << 32 | y for x, y in linked], "i8"))
        self.shown.append(f"{','.join(map(str, a_ids))}|{','.join(map(str, b_ids))}")
        self.counts.append((len(a_ids), len(b_ids), linked.total()))
        return number

    def cut(self, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the groups of tokens of the same bytes, and where each group's bytes end."""
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        ends = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        to_a, to_b = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        n_a, n_b = to_a - from_a, to_b - from_b
        numbers = np.zeros(len(ends), "u4")
        # groups of up to four ids are numbered by the ids in one integer, each kind in one go
        wide = self.kind.itemsize * 8
        for x, y in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)):
            at = np.flatnonzero((n_a == x) & (n_b == y)) if (x + y) * wide <= 64 else []
            if not len(at):
                continue
            code = np.zeros(len(at), "u8")
            for ids, first, n in ((a_ids, from_a, x), (b_ids, from_b, y)):
                for k in range(n):
                    code = code << np.uint64(wide) | ids[first[at] + k].astype("u8")
            codes, place, of = np.unique(code, return_index=True, return_inverse=True)
            known = []
            for c, i in zip(codes.tolist(), at[place].tolist()):
                if (number := self.small.get((x, y, c))) is None:
                    number = self.small[x, y, c] = self.group(tuple(a_ids[from_a[i] : to_a[i]].tolist()), tuple(b_ids[from_b[i] : to_b[i]].tolist()))
                known.append(number)
            numbers[at] = np.array(known, "u4")[of]
        for i in np.flatnonzero(numbers == 0).tolist():
            own = tuple(a_ids[from_a[i] : to_a[i]].tolist()), tuple(b_ids[from_b[i] : to_b[i]].tolist())
            numbers[i] = self.groups.get(own) or self.group(*own)
        return numbers, ends

    def learn(self, new: list[str]) -> None:
        """Encode and group distinct pieces; each begins with a space, which B adds by itself."""
        self.a.known = {}
        self.a._learn(set(new))
        a_ids = [self.a.known[x] for x in new]
        b_ids = [x if len(piece) > 1 else [self.space] for piece, x in zip(new, self.b.encode([x[1:] for x in new], num_threads=1))]
        self.a.known = {}
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        whole = [x.encode() for x in new]
        flat_a, flat_b = np.frombuffer(b"".join(a_ids), "<u4").astype("i8"), list(chain.from_iterable(b_ids))
        good, want = [True] * len(new), b"".join(whole)
        # tokens never stand for more bytes than they were made of, so if all together agree each piece does
        if b"".join(map(of_a, flat_a.tolist())) != want or b"".join(map(of_b, flat_b)) != want:
            good = [b"".join(map(of_b, y)) == w and b"".join(map(of_a, np.frombuffer(x, "<u4").tolist())) == w for x, y, w in zip(a_ids, b_ids, whole)]
            flat_a = np.frombuffer(b"".join(x for x, ok in zip(a_ids, good) if ok), "<u4").astype("i8")
            flat_b = [i for x, ok in zip(b_ids, good) if ok for i in x]
        numbers, ends = self.cut(flat_a, np.array(flat_b, "i8"))
        sizes = np.cumsum([len(w) for w, ok in zip(whole, good) if ok])
        edges = np.concatenate([[0], np.searchsorted(ends, sizes) + 1]).tolist() if len(sizes) else [0]
        flat, at = numbers.tobytes(), 0
        for piece, ok in zip(new, good):
            if ok:
                self.pieces[piece] = flat[4 * edges[at] : 4 * edges[at + 1]]
                at += 1
            else:
                self.pieces[piece] = bytes(4)

    def align(self, texts: list[str]):
        """(n_a, n_b, n_groups, n_links, groups_sha256, keys, freqs, again) of each text."""
        if len(self.keys) > CACHE_GROUPS:
            self.forget()
        elif len(self.pieces) > CACHE_PIECES:
            self.pieces, self.before = {}, self.pieces
        cut = [_PIECE_END.split(" " + x) if x else [] for x in texts]
        new = set(chain.from_iterable(cut)).difference(self.pieces)
        for piece in new.intersection(self.before):
            self.pieces[piece] = self.before[piece]
        if new := list(new.difference(self.before)):
            self.learn(new)
        nothing, known = (0, 0, 0, 0, "", [], [], []), self.pieces.__getitem__
        counts = np.array(self.counts, "i8")
        for pieces in cut:
            numbers = np.frombuffer(b"".join(map(known, pieces)), "<u4")
            if not len(numbers) or not numbers.all():
                yield nothing
                continue
            shown = hashlib.sha256(";".join(map(self.shown.__getitem__, numbers.tolist())).encode()).hexdigest()
            own, freqs = np.unique(numbers, return_counts=True)
            n_a, n_b, n_links = (int(x) for x in freqs @ counts[own])
            groups = own.tolist()
            pairs, held = np.unique(np.concatenate([self.pairs[i] for i in groups]), return_counts=True)
            yield n_a, n_b, len(numbers), n_links, shown, [self.keys[i] for i in groups], freqs, np.repeat(pairs, held - 1)
        for piece in {p for x in cut for p in x if len(p) > CACHE_CHARS}:
            del self.pieces[piece]


def _short(key: Column) -> Column:
    return F.when(F.length(key) < 32, key).otherwise(F.unhex(F.sha2(key, 256)))


def grouped(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, keys and freqs of distinct groups, and `again`:
    the pairs that the row's groups hold more than once, so often."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "freqs", "again"]

    def run(batches):
        aligner = Aligner.shared(a_path, b_path)
        for b in slices(batches, chars=1_000_000):
            cols = zip(*aligner.align(texts_of(b)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *[pa.array(x, k) for x, k in zip(cols, kinds)]], names=["doc_id", "row", *names])

    schema = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<binary>, freqs array<long>, again array<long>"
    return src.mapInArrow(run, schema)


def links_of(groups: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, docs) -> (short, docs, pair, n): each distinct group expanded once, n occurrence pairs each."""

    def run(batches):
        aligner = Aligner.shared(a_path, b_path)
        for b in slices(batches, rows=4096):
            out = [(short, docs, x << 32 | y, n) for key, short, docs in zip(*(b.column(c).to_pylist() for c in ("key", "short", "docs"))) for (x, y), n in aligner.expand(*aligner.ids_of(key)).items()]
            cols = [pa.array(x, k) for x, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["short", "docs", "pair", "n"])

    return groups.select("key", _short(F.col("key")).alias("short"), "docs").mapInArrow(run, "short binary, docs long, pair long, n long")


def pair_counts(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(pair, count): the documents that hold the pair linked."""
    several = rows.select(F.explode("again").alias("pair")).groupBy("pair").agg((-F.count(F.lit(1))).alias("n"))
    return links.select("pair", F.col("docs").alias("n")).unionByName(several).groupBy("pair").agg(F.sum("n").alias("count"))


def alignment(docs: DataFrame, a_path: str, b_path: str, **columns) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per document."""
    rows = materialise(grouped(docs, a_path, b_path, **columns), "aligned-rows")
    groups = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
    links = materialise(links_of(groups, a_path, b_path), "aligned-links")
    counts = materialise(pair_counts(links, rows), "aligned-pairs")
    first = F.shiftright("pair", 32)
    # at most one row of an A-id: bounded by the vocabulary
    best = counts.groupBy(first.alias("a")).agg(F.max("count").alias("best"))
    scored = counts.join(F.broadcast(best), first == F.col("a")).select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    sums = links.join(scored, "pair").groupBy("short").agg(F.first("docs").alias("docs"), F.sum(F.col("n") * F.col("count")).alias("total"), F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("best"))
    sums = materialise(sums, "aligned-groups")
    hot = sums.orderBy(F.desc("docs"), "short").limit(HOT)
    hot = materialise(hot.select("short", "total", "best"), "aligned-hot")
    cold = sums.join(F.broadcast(hot.select("short")), "short", "left_anti").select("short", "total", "best")

    each = rows.select("row", F.explode(F.arrays_zip("keys", "freqs")).alias("g")).select("row", _short(F.col("g.keys")).alias("short"), F.col("g.freqs").alias("freq"))
    worth = ["row", (F.col("freq") * F.col("total")).alias("total"), (F.col("freq") * F.col("best")).alias("best")]
    sent = each.join(F.broadcast(hot), "short").select(*worth)
    met = each.join(F.broadcast(hot.select("short")), "short", "left_anti").join(cold, "short").select(*worth)
    given = sent.unionByName(met).groupBy("row").agg(F.sum("total").alias("count_sum"), F.sum("best").alias("n_best"))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("row", *own, "groups_sha256").join(given, "row", "left").select(*own, zero("n_best"), zero("count_sum"), "groups_sha256")
