import base64
import hashlib
import itertools
import random

import public_tokenizers as P
import pytest
import tiktoken

from folioscope.llm import byte_bpe as module
from folioscope.llm.byte_bpe import ByteBpe, decode_ids, encode_ids, round_trip
from folioscope.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "it's  we'll\n\n x", "<|endoftext|> is text", "日本語 ÃÂÃÂ é", "\x00\x1c\x85", "same", "same", "a" * 5000, "=-" * 3000, "x9 " * 20_000]


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
@pytest.mark.parametrize("leaf", [2, 16, 64])
def test_tree_equals_the_library(monkeypatch, name, leaf):
    monkeypatch.setattr(module, "LEAF", leaf)
    bpe = ByteBpe(P.path(name), P.PATTERN)
    with open(P.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    want = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(leaf)
    for k in range(400):
        letters = ("ab", "aeinrst", "a", "éàñж日本", "-=_*#", "the and ing", "0123", " \n\t")[k % 8]
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 700)))
        assert bpe.encode(text) == want(text), repr(text)
        assert bpe.joined(bpe.encode(text)) == text.encode()


def test_tree_equals_the_merges_with_any_vocabulary(monkeypatch, tmp_path):
    """Random small vocabularies over two and three letters: every cut of every short string joins right."""
    monkeypatch.setattr(module, "LEAF", 1)
    rng = random.Random(5)
    for trial in range(25):
        letters = "abc"[: 2 + trial % 2]
        entries = list(letters)
        while len(entries) < 14:
            made = rng.choice(entries) + rng.choice(entries)
            if made not in entries:
                entries.append(made)
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(x.encode()) + f" {i}\n".encode() for i, x in enumerate(entries)))
        bpe = ByteBpe(str(path), r"\w+")

        def plain(text):
            parts = list(text)
            while True:
                best = min((entries.index(a + b), i) for i, (a, b) in enumerate([*itertools.pairwise(parts), ("?", "?")]) if a + b in entries) if any(a + b in entries for a, b in itertools.pairwise(parts)) else None
                if best is None:
                    return [entries.index(x) for x in parts]
                parts[best[1] : best[1] + 2] = [entries[best[0]]]

        for _ in range(80):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
            want = plain(text)
            assert bpe.merged(text.encode()) == want == bpe.tree(text.encode())
            at = rng.randrange(len(text) + 1)
            assert bpe.join(plain(text[:at]) if at else [], plain(text[at:]) if at < len(text) else []) == want


def test_runs_of_one_letter_do_not_cost_the_square(whole):
    import time

    bpe = ByteBpe(PATH, P.PATTERN)
    for text in ("a" * 300_000, "ab" * 150_000, "=" * 300_001):
        start = time.process_time()
        ids = bpe.encode(text)
        assert time.process_time() - start < 20 and bpe.joined(ids) == text.encode()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, [1], "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, n_tokens string")


def test_rows_through_spark(spark, whole):
    docs = frame(spark, TEXTS)
    ids = encode_ids(docs.repartition(3), PATH, P.PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: whole(t or "") for i, t in enumerate(TEXTS)}
    back = {r.doc_id: bytes(r.bytes).decode() for r in decode_ids(ids, PATH, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    lone = spark.createDataFrame([(1, None), (2, []), (3, [whole("日")[0]])], "doc_id long, ids array<int>")
    assert [len(r.bytes) for r in decode_ids(lone, PATH, P.PATTERN).orderBy("doc_id").collect()][:2] == [0, 0]
    assert round_trip(frame(spark, []), PATH, P.PATTERN).count() == 0


def test_whole_query_equals_the_library(spark, whole):
    sf = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, sf).collect()}
    assert got == {i: (len(whole(t)), sha(" ".join(map(str, whole(t)))), sha(t)) for i, t in texts.items()}
