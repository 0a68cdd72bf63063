import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from folioscope.llm.packing import best_fit, pack
from folioscope.llm.token_files import read_token_files, token_files, write_token_files
from folioscope.llm.tokens import Encoder

TEXTS = ["", "a b", "  two  spaces ", "line\none\n\n two\t\ttabs \n x", "it's we'll 12,345 naïve ÉCOLE", "a b  c", "x" * 3000, "Σίσυφος ΟΔΟΣ. é", "<|endoftext|> in text", "\x1c \x1d z", "a ́b", "end "]
SPACED = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}


@pytest.mark.parametrize("name", SPACED)
def test_piecewise_ids_equal_whole_text_ids(name):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice(" \n\tabcDE.,'s19é") for _ in range(rng.randrange(60))) for _ in range(500)]
    whole = Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)
    got = Encoder(P.path(name), SPACED[name]).encode(texts)
    for text, a, b in zip(texts, whole, got):
        assert a.ids == np.frombuffer(b, "<u4").tolist(), repr(text)


def test_best_fit_is_whole_and_tight():
    rng = np.random.default_rng(3)
    for size in (5, 64, 1024):
        lengths = rng.integers(1, size + 1, 700)
        bins, at, fills = best_fit(lengths, size)
        assert max(fills) <= size and sum(fills) == lengths.sum()
        for b in range(len(fills)):
            own = sorted(zip(at[bins == b], lengths[bins == b]))
            assert [x for x, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]
        assert sum(f * 2 <= size for f in fills) <= 1


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, bin string, start long")


def test_pack_small(spark):
    texts = [*TEXTS, None, "the same", "the same", "word " * 5000]
    rows = pack(_frame(spark, texts).repartition(3), P.path("byte_bpe_50k.json"), 2, spaced=True, size=64, with_ids=True).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    seen, places = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert r.start == len(seen.setdefault(r.doc_id, [])) and len(ids) == r.length <= 64
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
        seen[r.doc_id] += ids.tolist()
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == 64 or r.piece == 0
    assert seen == want
    total = 0
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
        total += end
    assert len(places) <= -(-total // 64) + 3


@pytest.mark.parametrize("chunk", [200_000, 7])
def test_pack_many_tasks_merges_up_the_tree(spark, monkeypatch, chunk):
    from folioscope.llm import packing as module

    monkeypatch.setattr(module, "FAN_IN", 4)
    monkeypatch.setattr(module, "CHUNK", chunk)
    docs = spark.range(1600).selectExpr("id AS doc_id", "repeat('word ', cast(1 + id * 7919 % 97 as int)) AS text").repartition(80)
    rows = pack(docs, P.path("byte_bpe_50k.json"), 2, spaced=True, size=256).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 1600 and len({r.sequence_id for r in rows}) <= 1.01 * (total / 256) + 1
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in map(sorted, places.values()):
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(own[-1]) <= 256


def test_counts_are_packed_as_single_items_are():
    from folioscope.llm.packing import best_fit_counts

    rng = np.random.default_rng(3)
    for trial in range(300):
        size = int(rng.choice([7, 64, 1024]))
        lengths = rng.choice(rng.integers(1, size + 1, int(rng.integers(1, 9))), int(rng.integers(0, 200)))
        names, n = np.unique(lengths, return_counts=True)
        got = best_fit_counts(dict(zip(names.tolist(), n.tolist())), size)
        bins, at, fills = best_fit(lengths, size)
        # equal rooms are filled in another order, so only the fills are the same
        assert sorted(sum(c) for c, times in got for _ in range(times)) == sorted(fills)
        assert sorted(x for c, times in got for x in c * times) == sorted(lengths.tolist())
    # a thousand million items cost no more than a few
    assert sum(n for _, n in best_fit_counts({600: 10**9, 400: 10**9 + 1, 24: 10**9}, 1024)) == 10**9 + 1


def _lay_out(spark, kind, tasks):
    """Documents of known lengths (one id a word and the end id) dealt unevenly to tasks; the ids they have in all."""
    one = {"sorted": "int(id * 1000 / 4000)", "two clusters": "if(id < 2000, 599, 399)", "chunked": "if(id % 500 < 250, 599, 399)", "mixed": "int(pow(pmod(id * 7919, 4000) / 4000.0, 3) * 1500)"}[kind]
    return spark.range(0, 4000, 1, tasks).selectExpr("id AS doc_id", f"repeat('a ', {one}) AS text", "'clash' AS bin", "1 AS length")


@pytest.mark.parametrize("kind,tasks", [*[(kind, tasks) for kind in ("sorted", "two clusters", "chunked") for tasks in (2, 64, 200)], ("mixed", 64)])
def test_uneven_tasks_pack_as_well_as_the_whole(spark, monkeypatch, kind, tasks):
    from folioscope.llm import packing as module

    monkeypatch.setattr(module, "FAN_IN", 8)
    monkeypatch.setattr(module, "CHUNK", 300)
    rows = pack(_lay_out(spark, kind, tasks), P.path("byte_bpe_50k.json"), 2, spaced=True).select("doc_id", "length", "sequence_id", "offset").collect()
    lengths = np.array([r.length for r in rows])
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in map(sorted, places.values()):
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(own[-1]) <= 1024
    whole = len(best_fit(lengths, 1024)[2])
    assert len(places) <= 1.01 * whole + 1, (len(places), whole)


def test_groups_of_the_tree_stay_bounded(spark, monkeypatch):
    """Rows into a group: children times lengths, however many pieces are handed on."""
    import pandas as pd

    from folioscope.llm import packing as module

    rows = pd.DataFrame([(7, child, length, 10**6) for child in range(32) for length in range(1, 1025)], columns=["node", "child", "length", "n"])
    out = module._merge(1024, 2, False)(rows)
    base, plan, left = (out[out["kind"] == k] for k in ("base", "plan", "left"))
    assert len(base) == len(rows) and len(left) <= 1024 and len(plan) < 20_000
    assert plan.groupby("length")["n"].sum().add(left.set_index("length")["n"], fill_value=0).eq(32 * 10**6).all()


def test_pack_empty(spark):
    assert pack(_frame(spark, []), P.path("byte_bpe_50k.json"), 2, spaced=True).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    texts = [*TEXTS, None, "the same", "the same"]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = f"file://{tmp_path}/files"
    write_token_files(_frame(spark, texts).repartition(5), out, P.path("word_bpe_49k.json"), 2, spaced=False)
    rows = sorted(read_token_files(spark, out, with_ids=True).collect())
    start = 0
    for i, (t, r) in enumerate(zip(texts, rows)):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert len(rows) == len(texts)


def test_shards_follow_the_bytes(spark, tmp_path, monkeypatch):
    from folioscope.llm import token_files as module

    path = P.path("word_bpe_49k.json")
    docs = spark.range(300).selectExpr("id % 40 - 3 AS doc_id", "concat('text ', id, repeat(' of some words', cast(id as int))) AS text").repartition(4)
    monkeypatch.setattr(module, "SHARD_BYTES", 20_000)
    out = f"file://{tmp_path}/many"
    stale = tmp_path / "many" / "shard-00000-0.bin"
    stale.parent.mkdir()
    stale.write_bytes(b"of a lost attempt")
    manifest = module.write_token_files(docs, out, path, 2, spaced=False)
    sizes = [r.n_ids * 2 for r in manifest.collect()]
    assert len(sizes) > 10 and max(sizes) < 60_000 and not stale.exists()
    # a repeated id may lie in several shards; ids ascend over all of them
    rows = module.read_token_files(spark, out, with_ids=True).orderBy("start").collect()
    assert len(rows) == 300 and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    monkeypatch.setattr(module, "SHARD_BYTES", 64 << 20)
    one = module.write_token_files(docs, f"file://{tmp_path}/few", path, 2, spaced=False)
    assert one.count() == 1
    assert module.read_token_files(spark, f"file://{tmp_path}/few", with_ids=True).orderBy("start").collect() == rows


def test_files_of_a_remote_store_are_read_by_ranges(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    from folioscope.llm import token_files as module

    (tmp_path / "x.bin").write_bytes(np.arange(100, dtype="<u2").tobytes())
    assert module._ranges(f"file://{tmp_path}", "x.bin", "<u2")(3, 6).tolist() == [3, 4, 5]
    monkeypatch.setattr(module, "_filesystem", lambda uri: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), ""))
    assert module._ranges("store://x", "x.bin", "<u2")(97, 100).tolist() == [97, 98, 99]


def test_token_files_empty_and_repeated(spark):
    assert token_files(_frame(spark, []), P.path("word_bpe_49k.json"), 2, spaced=False).count() == 0
    twice = _frame(spark, ["a b"]).union(_frame(spark, ["a b"]))
    assert [r.start for r in sorted(token_files(twice, P.path("word_bpe_49k.json"), 2, spaced=False).collect())] == [0, 3]
