"""Operator 7, benchmark decontamination by a generalised suffix automaton of test items.

The automaton holds every word sequence of the items. Training words are streamed through it; at
each word the longest suffix that occurs in an item is known. Where that reaches the window length
(13 words, or a whole shorter item) the words of the match are hit. Spans of hit words can be cut.

Reading words costs far more than matching, so only stretches whose neighbouring word pairs all
occur in the items are streamed; elsewhere the automaton would fall back to its start anyway.

The items are a stated query set. They are cut into blocks of about BLOCK_WORDS words, longer items
into parts that overlap by a window less one word. Blocks are sent out as words, and an automaton is
built from each where it is used. One scan of the documents takes any number of blocks: a task keeps
the automata of up to BLOCKS_HELD blocks; with more, it gathers GATHER_BYTES of texts and holds one
automaton after the other beside them. Every row is decided by its own text, however many blocks.

Defined results: null or word-free texts have no words and are not contaminated; items without
words are never found; repeated items count by item id; ids compare as strings.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keep_only, slices

#: Words of items that one automaton holds, automata that a task keeps, and texts gathered where there are more.
BLOCK_WORDS, BLOCKS_HELD, GATHER_BYTES = 50_000, 4, 16_000_000
#: Bytes that are part of no word become spaces, A-Z become a-z; bytes from 0x80 on are kept.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class ItemAutomaton:
    """A generalised suffix automaton over word numbers, with what occurs at its states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for item, words in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if seq:
                numbered.append((item, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        self.least = min((min(window, len(s)) for _, s in numbered), default=window)
        n = len(self.length)
        self.items: list[set[str]] = [set() for _ in range(n)]
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, seq in numbered:
            at = 0
            for c in seq:
                at = self.next[at][c]
                v = at
                while v > 0 and self.length[v] >= window and item not in self.items[v]:
                    self.items[v].add(item)
                    v = self.link[v]
            if len(seq) < window:
                self.short.setdefault(at, []).append((len(seq), item))
        # per state: itself and its ancestors where a short item ends
        self.short_chain: list[tuple[tuple[int, str], ...]] = [()] * n
        for v in sorted(range(n), key=self.length.__getitem__):
            own = tuple(self.short.get(v, ()))
            self.short_chain[v] = own + (self.short_chain[self.link[v]] if v else ())
        pairs = {a * len(self.vocab) + b for _, s in numbered for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        """Add one word after `last`, as for a single sequence, reusing what other items made."""
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, c, q)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves), self.link.append(-1), self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), np.int64, len(words))

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit, found = np.zeros(len(words) + 1, np.int64), set()
        if not len(words) or not self.vocab:
            return hit[:-1] > 0, found
        seq = self.numbers(words)
        if self.least > 1:
            known = np.zeros(len(seq) + 1, bool)
            pair = seq[:-1] * len(self.vocab) + seq[1:]
            both = (seq[:-1] >= 0) & (seq[1:] >= 0)
            if both.any() and len(self.pairs):
                at = np.searchsorted(self.pairs, pair)
                both &= self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair
            known[1:-1] = both  # known[i]: words i - 1 and i are a pair of some item
            need = self.least - 1
        else:
            known = np.zeros(len(seq) + 1, bool)
            known[:-1] = seq >= 0  # known[i]: word i is in some item
            need = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= need:
                self._stream(seq, a - (self.least > 1), b, hit, found)
        return np.cumsum(hit)[:-1] > 0, found

    def _stream(self, seq: np.ndarray, a: int, b: int, hit: np.ndarray, found: set[str]) -> None:
        state, size = 0, 0
        for i, c in enumerate(seq[a:b].tolist(), a):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c not in self.next[state]:
                state, size = 0, 0
                continue
            state, size = self.next[state][c], size + 1
            if size >= self.window:
                v = state
                while self.length[self.link[v]] >= self.window:
                    v = self.link[v]
                found |= self.items[v]
                hit[i + 1 - self.window] += 1
                hit[i + 1] -= 1
            for n, item in self.short_chain[state]:
                if n <= size:
                    found.add(item)
                    hit[i + 1 - n] += 1
                    hit[i + 1] -= 1


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int):
    """Words of the items, a block at a time; the stated query set passes the driver by blocks."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    step = max(BLOCK_WORDS, window)
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if item is None or not words:
            continue
        for at in range(0, max(len(words) - window + 1, 1), step):
            part = words[at : at + step + window - 1]
            block.append((item, part))
            held += len(part)
            if held >= BLOCK_WORDS:
                yield block
                block, held = [], 0
    if block:
        yield block


class _Block:
    """Words of items as they are sent, and their automaton, built where it is used first."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items, self.window, self.built = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "built": None}

    def automaton(self) -> ItemAutomaton:
        self.built = self.built or ItemAutomaton(self.items, self.window)
        return self.built


def _sent(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list:
    """The blocks as broadcasts; each is bounded, and those that are not held lie on the executors' disks."""
    return [docs.sparkSession.sparkContext.broadcast(_Block(x, window)) for x in _blocks(benchmark, item_col, text_col, window)]


class _Matcher:
    """Texts against all blocks; lives as long as a task."""

    def __init__(self, sent: list):
        self.sent = sent
        self.held = [x.value.automaton() for x in sent] if len(sent) <= BLOCKS_HELD else None

    def gathered(self, batches):
        """Lists of slices of batches, so many that loading automata is paid for by many texts."""
        now, size = [], 0
        for b in slices(batches):
            now.append(b)
            size += b.nbytes
            if self.held is not None or size >= GATHER_BYTES:
                yield now
                now, size = [], 0
        if now:
            yield now

    def _automata(self):
        if self.held is not None:
            yield from self.held
            return
        for x in self.sent:
            yield x.value.automaton()
            x.__dict__.pop("_value", None)  # a worker would keep it

    def found(self, texts: list[str | None]) -> list[tuple[list[bytes], np.ndarray, set[str]]]:
        """Per text its words, which of them are hit, and the items that occur."""
        out = [(words, np.zeros(len(words), bool), set()) for words in map(words_of, texts)]
        for automaton in self._automata():
            for words, hit, items in out:
                h, f = automaton.match(words)
                hit |= h
                items |= f
        return out


def _contaminated(words: list[bytes], hit: np.ndarray, share: int) -> bool:
    n = int(hit.sum())
    return n > 0 and share * n >= len(words)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with_text also
    hit_spans (first and end word of each run of hit words) and clean_text (those words cut out).

    contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    schema += ", hit_spans array<array<int>>, clean_text string" * with_text
    sent = _sent(docs, benchmark, item_col, item_text_col, window)

    def report(batches):
        keep_only()
        matcher = _Matcher(sent)
        for group in matcher.gathered(batches):
            texts = [x for b in group for x in b.column("text").to_pylist()]
            out: list[list] = [[] for _ in range(7)]
            for text, (words, hit, found) in zip(texts, matcher.found(texts)):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist() if hit.any() else []
                spans = [list(x) for x in zip(edge[::2], edge[1::2])]
                digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
                row = (len(words), int(hit.sum()), len(found), digest, _contaminated(words, hit, share), spans, cut(text, spans) if with_text else None)
                for column, value in zip(out, row):
                    column.append(value)
            ids = pa.chunked_array([b.column("doc_id") for b in group]).combine_chunks()
            cols = {"doc_id": ids, "n_words": pa.array(out[0], pa.int64()), "n_hit": pa.array(out[1], pa.int64()), "n_items": pa.array(out[2], pa.int64())}
            cols |= {"items_sha256": pa.array(out[3], pa.string()), "contaminated": pa.array(out[4], pa.bool_())}
            if with_text:
                cols |= {"hit_spans": pa.array(out[5], pa.list_(pa.list_(pa.int32()))), "clean_text": pa.array(out[6], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(report, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text is not contaminated; one pass, no shuffle."""
    sent = _sent(docs, benchmark, item_col, item_text_col, window)

    def clean(batches):
        keep_only()
        matcher = _Matcher(sent)
        for group in matcher.gathered(batches):
            got = iter(matcher.found([x for b in group for x in b.column(text_col).to_pylist()]))
            for b in group:
                keep = [not _contaminated(words, hit, share) for words, hit, _ in (next(got) for _ in range(b.num_rows))]
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def cut(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words of the spans (and what stands between the words of one span)."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    spaced = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], spaced, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    keep, at = [], 0
    for a, b in spans:
        keep.append(raw[at : begin[a]])
        at = int(end[b - 1])
    return b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")
