import random

import pytest

from folioscope.operators import bm25, segments
from folioscope.operators.segments import SegmentedIndex, followed
from folioscope.sources.places import work_path

WORDS = [f"w{i}" for i in range(300)]


def texts(rng, n):
    """A common word everywhere, others by a steep law."""
    return [" ".join(["the"] * rng.randrange(1, 4) + [WORDS[min(int(rng.paretovariate(0.6)), 299)] for _ in range(rng.randrange(0, 30))]) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content string")


def asked(spark):
    return spark.createDataFrame([(1, "the w1 w250"), (2, "w7 w7 w2"), (3, "the"), (4, "no-such-word"), (5, "w1 w2 w3 w4 w5 the")], "query_id int, query string")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.raw_score, round(r.score, 9)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(segments, "STRIPE", 16)
    monkeypatch.setattr(segments, "BASE", 40)


def test_equal_to_a_full_build_after_inserts_replacements_and_removals(spark, small):
    rng = random.Random(4)
    index, now = SegmentedIndex(spark, work_path(spark, "seg")), {}
    for step in range(5):
        ids = [f"c{rng.randrange(400):03d}" for _ in range(60)]
        batch = dict(zip(ids, texts(rng, 60)))
        index.add(frame(spark, list(batch.items())))
        now |= batch
        gone = rng.sample(sorted(now), 15)
        index.remove(spark.createDataFrame([(g,) for g in [*gone, "not there"]], "chunk_id string"))
        for g in gone:
            del now[g]
        if step in (1, 4):
            whole = bm25.build(frame(spark, list(now.items())))
            assert index.sizes() == tuple(whole.lengths.selectExpr("count(1)", "sum(dl)").first())
            assert sorted(tuple(r) for r in index.term_counts().collect()) == sorted((r.term, r.df) for r in whole.terms.collect())
            for n in (3, 500) if step == 4 else (20,):
                assert rows_of(index.search(asked(spark), n)) == rows_of(bm25.search(whole, asked(spark), n)), n
    names = index._names(index.log.state(), "segment")
    assert 1 < len(names) < 5
    among = spark.createDataFrame([(c,) for c in sorted(now)[::3]], "chunk_id string")
    assert rows_of(index.search(asked(spark), 10, among=among)) == rows_of(bm25.search(whole, asked(spark), 10, among=among))
    assert index.merge(everything=True) == 1
    state = index.log.state()
    assert len(state.entries) == 1 and index.sizes()[0] == len(now)
    assert rows_of(index.search(asked(spark), 20)) == rows_of(bm25.search(whole, asked(spark), 20))


def test_a_batch_writes_in_proportion_to_itself(spark, small):
    rng = random.Random(7)
    index = SegmentedIndex(spark, work_path(spark, "seg"))
    index.add(frame(spark, [(f"a{i:04d}", t) for i, t in enumerate(texts(rng, 700))]))
    before = set(index.log.state().entries)
    index.add(frame(spark, [(f"b{i}", t) for i, t in enumerate(texts(rng, 5))] + [("a0001", "other")]))
    state = index.log.state()
    (segment,) = [n for n in set(state.entries) - before if state.entries[n]["kind"] == "segment"]
    (dead,) = index._names(state, "dead")
    assert before <= set(state.entries) and state.entries[segment]["chunks"] == 6
    assert state.entries[dead]["of"] == {min(before): [1, state.entries[dead]["of"][min(before)][1]]}
    assert spark.read.parquet(f"{index.path}/{segment}/postings").selectExpr("sum(n)").first()[0] < 6 * 40
    assert index.sizes()[0] == 705


def test_common_words_are_not_read_whole(spark, small):
    """One rare word beside one that is everywhere: stripes that hold the common word alone cannot reach the best."""
    rows = [(f"c{i:04d}", "the " * (1 + i % 3) + ("rare " * 3 if i % 97 == 5 else "plain") + f" x{i % 50}") for i in range(1500)]
    index = SegmentedIndex(spark, work_path(spark, "seg"))
    index.add(frame(spark, rows))
    ask = spark.createDataFrame([(1, "rare the"), (2, "the")], "query_id int, query string")
    _, reads = index.found(ask, 5)
    reads = {r.query_id: r for r in reads.collect()}
    assert reads[1].postings > 1500 and reads[1].read < 0.3 * reads[1].postings
    assert reads[1].stripes_read <= 1500 // 97 + 1 < reads[1].stripes
    whole = bm25.build(frame(spark, rows))
    assert rows_of(index.search(ask, 5)) == rows_of(bm25.search(whole, ask, 5))


def test_empty_indexes_and_batches(spark, small):
    index = SegmentedIndex(spark, work_path(spark, "seg"), "long")
    assert index.search(asked(spark), 5).count() == 0 and index.sizes() == (0, 0)
    nothing = spark.createDataFrame([], "chunk_id long, content string")
    assert index.add(nothing) == -1 and index.remove(nothing) == -1 and index.merge() == 0
    index.add(spark.createDataFrame([(2, None), (1, ""), (1, "w1")], "chunk_id long, content string"))
    got = index.search(asked(spark), 5).filter("query_id = 1").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 2]
    index.add(spark.createDataFrame([(1, "w2"), (3, "w2")], "chunk_id long, content string"), new=True)
    assert index.sizes() == (3, 2)


def test_streams_and_writers_meet(spark, small, tmp_path):
    rows = [(f"c{i}", f"word{i} shared") for i in range(6)]
    src = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
    path = work_path(spark, "seg")
    run = lambda: followed(spark.readStream.schema("chunk_id string, content string").option("maxFilesPerTrigger", 1).parquet(src), path, str(tmp_path / "c")).awaitTermination()
    run()
    run()
    index = SegmentedIndex(spark, path)
    assert index.log.state().version == 1 and index.sizes() == (6, 12)
    # a batch that is repeated after its commit changes nothing
    index.add(frame(spark, [("x", "late")]), app=("stream", 1))
    assert index.sizes() == (6, 12)
    # another writer removes between reading and committing: the removal is made anew
    other, commit, tries = SegmentedIndex(spark, path), index.log.commit, []

    def slow(*args, **more):
        if not tries:
            tries.append(1)
            other.remove(spark.createDataFrame([("c0",)], "chunk_id string"))
        return commit(*args, **more)

    index.log.commit = slow
    index.remove(spark.createDataFrame([("c0",), ("c1",)], "chunk_id string"))
    assert index.sizes() == (4, 8)


def test_lists_are_made_in_runs_of_whole_stripes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(segments, "RUN", 5)
    rows = [(t, s, f"c{s}{i}", i, i + 1, 9 - i) for s in range(4) for i in range(3) for t in ("b", "a")]
    schema = pa.schema([("term", pa.string()), ("stripe", pa.int64()), ("chunk_id", pa.string()), ("seq", pa.int64()), ("tf", pa.int32()), ("dl", pa.int32())])
    batches = lambda: [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4]), schema.types)], schema=schema) for i in range(0, len(rows), 4)]
    got = [r for b in segments._packed(batches()) for r in b.to_pylist()]
    assert sorted((r["term"], r["stripe"]) for r in got) == [(t, s) for t in "ab" for s in range(4)]
    assert all((r["n"], r["max_tf"], r["min_dl"]) == (3, 3, 7) and [h["chunk_id"] for h in r["hits"]] == [f"c{r['stripe']}{i}" for i in range(3)] for r in got)
    # a stripe with too many postings is handed on in parts
    monkeypatch.setattr(segments, "MOST", 5)
    assert sum(r["n"] for b in segments._packed(batches()) for r in b.to_pylist()) == len(rows)


def test_an_id_that_comes_twice_in_a_batch(spark, small):
    index = SegmentedIndex(spark, work_path(spark, "seg"))
    rows = [("a", 1, "old words"), ("a", 3, "new new words"), ("a", 2, "older"), ("b", 1, None), ("c", 1, "words")]
    index.add(spark.createDataFrame(rows, "chunk_id string, seq string, content string").repartition(3), seq_col="seq")
    assert {(r.chunk_id, r.seq, r.dl, tuple(map(tuple, r.words))) for r in index.docs().collect()} == {("a", "3", 3, (("new", 2), ("words", 1))), ("b", "1", 0, ()), ("c", "1", 1, (("words", 1),))}
    assert sorted(tuple(r) for r in index.term_counts().collect()) == [("new", 1), ("words", 2)]
