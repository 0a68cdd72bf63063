"""Operator 6, near-duplicates by order MinHash, verified by banded alignment.

1. A text's k-mers are runs of K words, labelled by their occurrence. Each of TREES hash functions
   takes the two least k-mers and keeps them in text order, so a match tells of shared words in the
   same order. Copies (the same words) have one digest; it stands for them from here on.
2. Sketches are dealt by range of (sketch, then 16 bits each of the next four sketches) and sorted.
   Texts with equal sketches stand together, the more alike the closer. A group of up to NEAR + 1
   texts gives all its pairs; in a larger one (shared passages, many near copies) each text is first
   paired with the next one, so pairs stay in proportion to texts, and a hot group is dealt over
   many tasks. Rows at the ends of tasks are matched in a second, small pass.
3. Pairs are verified: edit distance over words by a bit-parallel band, at least SIMILARITY of the
   longer text's length must agree. Verified links make classes by connected components.
4. Large groups that still have several classes are compared whole, by pairs of blocks: texts of
   different classes that share enough words for the limit are verified, until no similar pair of the
   group is unlinked. A group of one class, such as many near copies, needs no more pairs.

Defined results: a null text is a class of its own; texts without words are copies only if they are
equal; texts under K words count as one k-mer; repeated rows are copies, of which one row is kept;
texts that only come without an id are matched as copies alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.llm.common import keep_only, materialise, slices
from folioscope.llm.contamination import words_of
from folioscope.llm.graph import components
from folioscope.llm.toxicity import _HASHES

K, TREES, NEAR = 5, 48, 8
SIMILARITY = 0.8
#: Texts to verify whose ids may be sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Texts, and words, of a block: large groups are compared block by block, each pair of blocks by itself.
BLOCK, BLOCK_WORDS = 1_024, 500_000
#: Columns of the matrix that bounds shared words, and how many of them the rarer words share.
COLUMNS, TAIL = 4_096, 1_024
#: Step of the length classes of large groups; lengths of similar texts are less than one step apart.
LENGTHS = -math.log(SIMILARITY - 0.01)
#: Copies from which a text counts as hot in the last join.
MANY_COPIES = 100
_ODD = np.random.default_rng(6).integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)
_SEEDS = np.random.default_rng(66).integers(0, 1 << 32, TREES, np.uint32)
_WIDE = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD[8]
        return x ^ (x >> np.uint64(29))


def kmers(words: list[bytes]) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers, in text order."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k, n = min(K, len(h)), max(len(h) - K, 0) + 1
    with np.errstate(over="ignore"):
        x = _mix(sum(h[i : i + n] * _ODD[i] for i in range(k)))
        order = np.argsort(x, kind="stable")
        y = x[order]
        first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
        if len(first) < n:
            nth = np.empty(n, np.uint64)
            nth[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            x = np.where(nth > 0, _mix(x + nth * _ODD[9]), x)
    return x


def sketches(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per tree: the sketch (two least k-mers in text order) and the sort key from the next trees."""
    x = kmers(words)
    short = (x >> np.uint64(32)).astype(np.uint32)

    def least(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = short[None, :] ^ seeds[:, None]
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        h ^= h >> np.uint32(16)
        one = h.argmin(1)
        h[np.arange(len(seeds)), one] = 0xFFFFFFFF
        return one, h.argmin(1)

    if len(x) <= _WIDE:
        one, two = least(_SEEDS)
    else:
        parts = [least(_SEEDS[i : i + 1]) for i in range(TREES)]
        one, two = (np.concatenate(p) for p in zip(*parts))
    with np.errstate(over="ignore"):
        s = _mix(x[np.minimum(one, two)] * _ODD[10] + x[np.maximum(one, two)] * _ODD[11] + np.arange(TREES, dtype=np.uint64) * _ODD[12])
    low = s & np.uint64(0xFFFF)
    sub = sum(np.roll(low, -i) << np.uint64(64 - 16 * i) for i in range(1, 5))
    return s.view(np.int64), sub.view(np.int64)


def digests_of(text: str | None, words: list[bytes]) -> tuple[int, int] | tuple[None, None]:
    """What copies share: two hashes of the words in order, of the raw text where it has none. The first
    stands for the text; the second tells texts apart that share the first by chance."""
    if text is None:
        return None, None
    raw = b" ".join(words) if words else b"\x00" + text.encode("utf-8", "surrogatepass")
    both = xxhash.xxh128_intdigest(raw)
    return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (any numbers), digest, check, n (words) and, once per digest and task, the sketches."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        keep_only("word hashes")
        seen: set[int] = set()
        for b in slices(batches):
            digests, checks, sizes, keys = [], [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                d, check = digests_of(text, words)
                digests.append(d), checks.append(check), sizes.append(len(words))
                if words and d not in seen:
                    seen.add(d)
                    keys.append(np.concatenate(sketches(words)).tobytes())
                else:
                    keys.append(None)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "row": b.column("row"), "digest": pa.array(digests, pa.int64()), "check": pa.array(checks, pa.int64()), "n": pa.array(sizes, pa.int32()), "keys": pa.array(keys, pa.binary())})

    return src.mapInArrow(run, "doc_id long, row long, digest long, check long, n int, keys binary")


def _exploded(batches):
    keep_only()
    for b in slices(batches, rows=2048):
        flat = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64).reshape(b.num_rows, 2, TREES)
        yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].ravel()), pa.array(flat[:, 1].ravel()), *(pa.array(np.repeat(b.column(c).to_numpy(), TREES)) for c in ("digest", "n", "class"))], names=["key", "sub", "digest", "n", "class"])


def _pairs(key: np.ndarray, digest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sorted rows: all of a small group, of a large one each row and the next. Third the texts
    that are in a large group, or in a piece that can be of one."""
    first = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(first)
    size = np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key))))
    out = []
    for w in range(1, NEAR + 1):
        same = key[w:] == key[:-w]
        if w > 1:
            same &= size[w:] <= NEAR + 1
        at = np.flatnonzero(same)
        small, large = np.minimum(n[at], n[at + w]), np.maximum(n[at], n[at + w])
        at = at[small >= SIMILARITY * large]
        out.append(np.stack([np.minimum(digest[at], digest[at + w]), np.maximum(digest[at], digest[at + w])]))
    return (*np.unique(np.concatenate(out, 1), axis=1), np.unique(digest[size > NEAR]))


def _candidates(ends: bool):
    """Over rows sorted by (key, sub, digest): pairs as (0, a, b, 0, 0), texts of large groups as
    (2, digest, 0, 0, 0), and with ends the rows near the ends of the task as (1, key, sub, digest, n)."""

    def run(batches):
        keep_only()
        keep = NEAR
        held, head, tail = None, [], None
        told: set[int] = set()
        names = ["key", "sub", "digest", "n"]

        def rows(kind, cols):
            size = len(cols[0])
            zero = np.zeros(size, np.int64)
            cols = [*cols, zero, zero, zero][:4]
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *[pa.array(c.astype(np.int64)) for c in cols]], names=["kind", "x", "y", "z", "n"])

        def matched(cols):
            a, z, large = _pairs(cols[0], cols[2], cols[3])
            fresh = [x for x in large.tolist() if x not in told]
            told.update(fresh)
            if len(a):
                yield rows(0, [a, z])
            if fresh:
                yield rows(2, [np.array(fresh, np.int64)])

        def distinct(cols):
            same = np.concatenate([[False], (cols[0][1:] == cols[0][:-1]) & (cols[2][1:] == cols[2][:-1])])
            return [c[~same] for c in cols]

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            cols = distinct(cols)
            if ends and not head:
                head = [[c[:keep].copy() for c in cols]]
            tail = [c[-keep:].copy() for c in cols]
            # rows of the last key wait for the next batch, unless it alone fills the batch
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            cut = last or max(len(cols[0]) - keep, 0)
            yield from matched([c[: last or len(c)] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield from matched(held)
            if ends:
                for part in (*head, tail):
                    yield rows(1, part)

    return run


def candidates(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (digest, n, keys): distinct pairs (a, b) of digests that stand near each other in some tree,
    and the digests that are in large groups."""
    schema = "kind int, x long, y long, z long, n long"
    flat = sketch.select("digest", "n", F.col("digest").alias("class"), "keys").mapInArrow(_exploded, "key long, sub long, digest long, n int, class long").drop("class")
    width = int(sketch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = flat.repartitionByRange(width, "key", "sub").sortWithinPartitions("key", "sub", "digest")
    found = materialise(dealt.mapInArrow(_candidates(True), schema), "candidates")
    ends = found.filter("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("sub"), F.col("z").alias("digest"), F.col("n").cast("int").alias("n"))
    met = materialise(ends.coalesce(1).sortWithinPartitions("key", "sub", "digest").mapInArrow(_candidates(False), schema), "candidates-met")
    both = found.union(met)
    return both.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), both.filter("kind = 2").select(F.col("x").alias("digest")).distinct()


def distance(a: list, b: list, limit: int) -> int:
    """Edit distance of two sequences, or limit + 1 if it is larger: bit-parallel over a band of
    2 * limit + 2 rows that moves down the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    top = min(limit, len(a))
    if not b:
        return len(a)
    if not top:
        return int(a != b)
    width = 2 * top + 2
    full = (1 << width) - 1
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    vp, vn = full ^ ((1 << (width - top - 1)) - 1), 0
    diagonal, across = 1 << (width - 1), 1 << (width - 2)
    now, worst = top, top + len(b) - (len(a) - top)
    start = top + 1 - width
    for j, y in enumerate(b):
        x = rows.get(y, 0)
        if x:
            x = (x >> start if start >= 0 else x << -start) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | full ^ (d0 | vp)
        hn = d0 & vp
        if j < len(a) - top:
            now += not d0 & diagonal
        else:
            now += bool(hp & across) - bool(hn & across)
            across >>= 1
        if now > worst:
            return limit + 1
        vp = hn | full ^ (d0 >> 1 | hp)
        vn = d0 >> 1 & hp
        start += 1
    return min(now, limit + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length reaches `least`, for arrays of word hashes."""
    longest = max(len(a), len(b))
    limit = int(longest * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    a, b = a.tolist(), b.tolist()
    if max(len(a), len(b)) <= limit:
        return True
    common = sum((Counter(a) & Counter(b)).values())
    return max(len(a), len(b)) - common <= limit and distance(a, b, limit) <= limit


def words_held(nodes: DataFrame, sketch: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """digest and words (hashes of 32 bits) of the digests in nodes. Texts come from the documents again,
    one per digest."""
    least = F.min(F.struct("check", F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    chosen = materialise(sketch.groupBy("digest").agg(least.alias("t")).join(nodes, "digest", "left_semi").select("digest", "t.check", "t.doc_id"), "to-verify")
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def words(batches):
        keep_only("word hashes")
        for b in slices(batches):
            digests, own = [], []
            for digest, check, text in zip(b.column("digest").to_pylist(), b.column("check").to_pylist(), b.column("text").to_pylist()):
                split = words_of(text)
                if digests_of(text, split) == (digest, check):  # an id may come with other texts too
                    digests.append(digest)
                    own.append((np.fromiter(map(_HASHES.__getitem__, split), np.uint64, len(split)) >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.int64()), "words": pa.array(own, pa.binary())})

    held = src.join(F.broadcast(chosen) if few else chosen, "doc_id").select("digest", "check", "text").mapInArrow(words, "digest long, words binary").dropDuplicates(["digest"])
    return materialise(held, "words-to-verify")


def verified(pairs: DataFrame, sketch: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose texts are similar."""
    nodes = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    held = words_held(nodes, sketch, docs, id_col, text_col)
    side = lambda name: held.select(F.col("digest").alias(name), F.col("words").alias(f"{name}_words"))

    def check(batches):
        keep_only()
        for b in slices(batches, rows=256):
            ok = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(b.column("a_words").to_pylist(), b.column("b_words").to_pylist())]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_words", "b_words")
    return both.mapInArrow(check, "a long, b long")


def links_between(words: list[np.ndarray], own: np.ndarray, block: np.ndarray, met: np.ndarray) -> list[tuple[int, int]]:
    """Links after which no two similar texts are of different classes (`own`): of all pairs of one
    block, or where there are two blocks, of all pairs across. Texts with an equal column of `met` are
    left out: they are compared where these are the sketches.

    Texts of length n are similar only if they share n - limit words (repeats counted). A product of
    matrices bounds the shared words of all pairs from above: frequent words have a column each, the
    others share TAIL columns. Pairs within the largest class are not looked at."""
    size, n = len(words), np.array([len(w) for w in words])
    must = n - (n * (1 - SIMILARITY) + 1e-9).astype(int)
    own = np.unique(own, return_inverse=True)[1]
    if not own.any():
        return []
    text, word = np.repeat(np.arange(size), n), np.concatenate(words).astype(np.uint64)
    word = word[np.lexsort((word, text))]
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])]))
    nth = np.arange(len(word)) - np.repeat(new, np.diff(np.append(new, len(word))))
    _, token, count = np.unique(word << np.uint64(32) | nth.astype(np.uint64), return_inverse=True, return_counts=True)
    column = np.arange(len(count)) % TAIL
    often = np.argsort(-count, kind="stable")[: COLUMNS - TAIL]
    column[often] = np.arange(TAIL, TAIL + len(often))
    several = count[token] > 1
    counts = np.zeros((size, COLUMNS), np.float32)
    np.add.at(counts, (text[several], column[token[several]]), 1)
    tokens = np.split(token, np.cumsum(n)[:-1])
    minor = own != np.bincount(own).argmax()
    one, two = (block == block.min(), block == block.max())
    if block.min() == block.max():
        parts = [(minor, one)]
    else:
        parts = [(one & minor, two), (one & ~minor, two & minor)]
    now, out = own.copy(), []
    for xs, ys in ((np.flatnonzero(x), np.flatnonzero(y)) for x, y in parts):
        for at in range(0, len(xs), 256):
            x = xs[at : at + 256]
            fit = counts[x] @ counts[ys].T >= np.maximum(must[x][:, None], must[ys][None, :])
            fit &= own[x][:, None] != own[ys][None, :]
            i, j = np.nonzero(fit)
            i, j = x[i], ys[j]
            keep = ~((one[i] & one[j] & two[i] & two[j]) & minor[j] & (i > j))
            i, j = i[keep], j[keep]
            if met.shape[1]:
                keep = ~(met[i] == met[j]).any(1)
                i, j = i[keep], j[keep]
            for a, b in zip(i.tolist(), j.tolist()):
                if now[a] != now[b] and len(np.intersect1d(tokens[a], tokens[b], assume_unique=True)) >= max(must[a], must[b]) and similar(words[a], words[b]):
                    out.append((a, b))
                    now[now == now[b]] = now[a]
    return out


def links_in_large_groups(keyed: DataFrame, classes: DataFrame, sketch: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of (digest, n, keys) and the classes (digest, class) of texts in large groups: links (a, b) after
    which no two similar texts of a large group are of different classes.

    A group is dealt by length (similar texts are of the same or a neighbouring length class) and in
    blocks; each pair of blocks is a group of rows by itself."""
    few = classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = keyed.select("digest", "n", "keys").join(F.broadcast(classes) if few else classes, "digest").dropDuplicates(["digest"])
    texts = materialise(texts, "texts-of-large-groups")
    flat = texts.select("digest", "n", "class", "keys").mapInArrow(_exploded, "key long, sub long, digest long, n int, class long")
    flat = flat.withColumn("long", F.floor(F.log("n") / LENGTHS).cast("int"))
    flat = materialise(flat.drop("sub"), "large-group-texts")
    sizes = flat.groupBy("key", "long").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"), F.min("class").alias("c"), F.max("class").alias("d"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    sizes = sizes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("long", blocks))).alias("blocks"), F.sum("size").alias("size"), F.min("c").alias("c"), F.max("d").alias("d"))
    mixed = materialise(sizes.filter((F.col("size") > NEAR + 1) & (F.col("c") != F.col("d"))).select("key", "blocks"), "mixed-groups")
    few = mixed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = flat.join(F.broadcast(mixed) if few else mixed, "key")
    own = own.withColumn("mine", F.struct("long", F.pmod(F.xxhash64("digest"), F.col("blocks")[F.col("long")]).cast("int").alias("block")))
    beside = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("long") + d)
    every = F.flatten(F.transform(beside, lambda x: F.when(F.col("blocks")[x].isNotNull(), F.transform(F.sequence(F.lit(0), F.col("blocks")[x] - 1), lambda y: F.struct(x.alias("long"), y.alias("block")))).otherwise(F.array().cast("array<struct<long:int,block:int>>"))))
    own = own.select("key", "digest", "class", "mine", F.explode(every).alias("other"))
    own = own.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("block"), "digest", "class")
    own = materialise(own, "mixed-group-texts")
    held = words_held(own.select("digest").distinct(), sketch, docs, id_col, text_col).join(texts.select("digest", "keys"), "digest")

    def links(table: pa.Table) -> pa.Table:
        keep_only()
        table = table.sort_by("digest")
        digest = table.column("digest").to_numpy()
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, 2, TREES)[:, 0]
        tree = int(np.flatnonzero(keys[0] == table.column("key")[0].as_py())[0])
        # a group of two blocks may hold rows of one of them alone
        block = table.column("block").to_numpy()
        if table.column("i")[0].as_py() != table.column("j")[0].as_py() and block.min() == block.max():
            got = []
        else:
            got = links_between([np.frombuffer(x, "<u4") for x in table.column("words").to_pylist()], table.column("class").to_numpy(), block, keys[:, :tree])
        x = np.array(got, np.int64).reshape(-1, 2)
        return pa.table({"a": digest[x[:, 0]], "b": digest[x[:, 1]]})

    return own.join(held, "digest").groupBy("key", "i", "j").applyInArrow(links, "a long, b long").distinct()


def _verdicts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: doc_id, digest, check, class_id, class_size, kept."""
    sketch = materialise(sketched(docs, id_col, text_col), "sketches")
    keyed = sketch.filter("keys IS NOT NULL")
    pairs, large = candidates(keyed)
    pairs = materialise(pairs, "pairs")
    root = components(verified(pairs, sketch, docs, id_col, text_col))
    classes = materialise(large.join(root.withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.coalesce("root", "digest").alias("class")), "large-groups")
    links = materialise(links_in_large_groups(keyed, classes, sketch, docs, id_col, text_col), "links-in-large-groups")
    if not links.isEmpty():
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    texts = sketch.filter("digest IS NOT NULL").groupBy("digest", "check").agg(first, F.count(F.lit(1)).alias("copies"))
    texts = texts.groupBy("digest").agg(F.min(F.struct("check", "first", "copies")).alias("t")).select("digest", "t.*")
    linked = texts.join(root.withColumnRenamed("node", "digest"), "digest")
    classes = materialise(linked.groupBy("root").agg(F.min("first").alias("class"), F.sum("copies").alias("class_size")), "classes")
    few = classes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = linked.join(F.broadcast(classes) if few else classes, "root").select("digest", "class", "class_size")
    named = texts.join(joined, "digest", "left").select("digest", F.col("check").alias("own_check"), F.coalesce("class", "first").alias("class"), F.coalesce("class_size", "copies").alias("class_size"), "copies")
    named = materialise(named, "classes-of-texts")
    # texts with many copies are sent to their copies, wherever they are; they are few. Null texts meet none
    rows, often = sketch.select("doc_id", "row", "digest", "check"), named.filter(F.col("copies") >= MANY_COPIES)
    known = rows.filter("digest IS NOT NULL")
    if often.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = F.broadcast(often)
        out = known.join(hot, "digest").unionByName(known.join(hot, "digest", "left_anti").join(named.filter(F.col("copies") < MANY_COPIES), "digest"))
    else:
        out = known.join(named, "digest")
    # another text that has the same digest by chance is a class of its own
    own = F.col("check") == F.col("own_check")
    out = out.select("doc_id", "digest", "check", F.when(own, F.col("class.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.col("class_size")).otherwise(1).cast("long").alias("class_size"), (~own | (F.col("class.row") == F.col("row"))).alias("kept"))
    none = rows.filter("digest IS NULL").select("doc_id", "digest", "check", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (the least doc_id of the class), class_size (rows), kept (one row of the class)."""
    return _verdicts(docs, id_col, text_col).select("doc_id", "class_id", "class_size", "kept")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that stay: one row of each class.

    The ids that go are sent to all tasks if they are few, else joined by a shuffle. Ids of which some
    rows stay and some go (repeated ids, rows without id) are decided by their rows' texts; which of
    rows equal in id and text stays is not defined.
    """
    verdict = materialise(_verdicts(docs, id_col, text_col).select("doc_id", "digest", "check", "kept"), "verdicts")
    ids = verdict.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"))
    ids = materialise(ids.filter("kept < rows").select(F.col("doc_id").alias("_gone"), (F.col("kept") > 0).alias("_some")), "dropped-ids")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if few else (lambda df: df)
    same_id = F.col(id_col).cast("long").eqNullSafe(F.col("_gone"))
    out = docs.join(sent(ids.select("_gone")), same_id, "left_anti")
    some = ids.filter("_some").select("_gone")
    if some.isEmpty():
        return out

    def named(batches):
        keep_only("word hashes")
        for b in slices(batches):
            own = [digests_of(x, words_of(x)) for x in b.column(text_col).to_pylist()]
            yield b.append_column("_digest", pa.array([x for x, _ in own], pa.int64())).append_column("_check", pa.array([x for _, x in own], pa.int64()))

    kept = verdict.filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept_digest"), F.col("check").alias("_kept_check"))
    kept = kept.join(some, F.col("_id").eqNullSafe(F.col("_gone")), "left_semi")
    parts = docs.join(sent(some), same_id, "left_semi")
    parts = parts.mapInArrow(named, StructType([*docs.schema.fields, StructField("_digest", LongType()), StructField("_check", LongType())]))
    parts = parts.withColumn("_own_id", F.col(id_col).cast("long"))
    # null texts stay, every one of them
    once = parts.filter("_digest IS NOT NULL").dropDuplicates(["_own_id", "_digest", "_check"])
    once = once.join(kept, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_kept_digest")) & (F.col("_check") == F.col("_kept_check")), "left_semi")
    return out.union(once.select(docs.columns)).union(parts.filter("_digest IS NULL").select(docs.columns))
