import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions.vectors import similarity
from folioscope.operators import bm25, ranking, vector_search

HITS = [("chunk_1_1", "doc_1", 0.9), ("chunk_1_2", "doc_1", 0.6), ("chunk_1_3", "doc_1", 0.3), ("chunk_2_1", "doc_2", 0.85), ("chunk_2_2", "doc_2", 0.8), ("chunk_3_1", "doc_3", 0.7), ("x", None, 0.99), ("y", "", 0.98)]


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame([(1, c, d, s, i) for i, (c, d, s) in enumerate(sorted(HITS, key=lambda h: -h[2]))], "query_id int, chunk_id string, doc_id string, similarity double, rank int")


def test_pooling(spark, hits):
    assert [(r.doc_id, r.score, r.matching_chunks) for r in ranking.by_similarity(hits).orderBy("rank").collect()] == [("doc_1", 0.9, 3), ("doc_2", 0.85, 2), ("doc_3", 0.7, 1)]
    assert [(r.doc_id, r.score) for r in ranking.by_relevance(hits, 0.5).orderBy("rank").collect()] == [("doc_1", 2.0), ("doc_2", 2.0), ("doc_3", 1.0)]
    assert {r.score for r in ranking.by_relevance(hits, 0.95).collect()} == {0.0}
    assert ranking.by_similarity(hits.limit(0)).count() == 0
    assert {(r.doc_id, r.chunk_id) for r in ranking.best_chunk(hits).collect()} == {("doc_1", "chunk_1_1"), ("doc_2", "chunk_2_1"), ("doc_3", "chunk_3_1")}


def test_distance_to_similarity(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.2, 0.833), (1.0, 0.5), (1.066, 0.484), (2.0, 0.333), (5.0, 0.167), (None, 0.0)], "d double, s double").select(similarity(F.col("d")), "s").collect()
    assert all(abs(a - b) < 1e-3 for a, b in rows)


def test_fetch_statistics(spark):
    ds = [("doc_1", 0.1), ("doc_1", 2.0), ("doc_2", 3.0), ("doc_3", 0.2), ("doc_3", 4.0), ("doc_3", 0.15)]
    hits = spark.createDataFrame([(1, f"c{i}", d, 1 / (1 + x), i) for i, (d, x) in enumerate(ds)], "query_id int, chunk_id string, doc_id string, similarity double, rank int")
    assert tuple(ranking.fetch_statistics(hits, 0.3).first())[1:] == (6, 4, 2, 1)


def test_fusion(spark):
    sem = spark.createDataFrame([(1, "a_c0", "doc_a", 0.9, 0), (1, "a_c1", "doc_a", 0.8, 1), (1, "b_c0", "doc_b", 0.7, 2)], "query_id int, chunk_id string, doc_id string, similarity double, rank int")
    key = spark.createDataFrame([(1, "a_c0", 0), (1, "b_c0", 1), (1, "lost", 2)], "query_id int, chunk_id string, rank int")
    fused = ranking.fuse(sem, key)
    got = {r.chunk_id: r.rrf_score for r in fused.collect()}
    assert got == pytest.approx({"a_c0": 2 / 60, "a_c1": 1 / 61 + 1 / 261, "b_c0": 1 / 62 + 1 / 61})
    docs = ranking.fused_documents(fused).orderBy("rank").collect()
    assert [(d.doc_id, d.matching_chunks, d.chunk_id) for d in docs] == [("doc_a", 2, "a_c0"), ("doc_b", 1, "b_c0")]
    assert ranking.fuse(sem, key, bm25_only="keep").count() == 4
    alone = ranking.fuse(sem, key.limit(0))
    assert [r.chunk_id for r in alone.orderBy(F.desc("rrf_score")).collect()] == ["a_c0", "a_c1", "b_c0"]


def _ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_bm25_fixtures(spark):
    tiny = spark.createDataFrame([("c1", "stochastic simulation stability convergence"), ("c2", "eigenvalue bounds random matrices"), ("c3", "Markov chain Monte Carlo methods")], "chunk_id string, content string")
    index = bm25.build(tiny)
    assert {round(r.idf, 7) for r in index.terms.collect()} == {0.5108256}
    top = bm25.search(index, _ask(spark, "stochastic simulation"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in top] == ["c1", "c2", "c3"] and [r.score for r in top] == [1.0, 0.0, 0.0]
    two = spark.createDataFrame([("doc1_chunk0", "alpha beta", 0), ("doc0_chunk0", "gamma delta", 1)], "chunk_id string, content string, seq int")
    rows = bm25.search(bm25.build(two, seq_col="seq"), _ask(spark, "gamma"), 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [("doc1_chunk0", 0.0), ("doc0_chunk0", 0.0)]


def test_bm25_numbers_against_plain_python(spark):
    rng = random.Random(2)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    query = list("aabz")
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    want = [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query) for d in docs]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "chunk_id int, content string")
    got = {r.chunk_id: r.raw_score for r in bm25.search(bm25.build(frame), _ask(spark, " ".join(query)), 40).collect()}
    assert got == pytest.approx(dict(enumerate(want)), abs=1e-6)


def test_vector_search(spark):
    rng = random.Random(1)
    vs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    chunks = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(vs)], "chunk_id int, doc_id int, embedding array<float>")
    asked = spark.createDataFrame([(q, vs[q]) for q in range(3)], "query_id int, vector array<double>")
    got = vector_search.search(chunks, asked, 5, metric="l2").collect()
    assert len(got) == 15
    for q in range(3):
        d = sorted((sum((a - b) ** 2 for a, b in zip(vs[q], v)), i) for i, v in enumerate(vs))[:5]
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in d]
    only = vector_search.chunk_search(chunks, asked, 200, document_ids=[1]).collect()
    assert {r.doc_id for r in only} == {1} and len(only) == 30
    near = vector_search.similar_chunks(chunks, 4, 5).collect()
    assert all(r.doc_id != 1 and r.chunk_id != 4 for r in near) and len(near) == 5
    assert vector_search.similar_chunks(chunks, 999, 5).count() == 0
    vector_search.QUERY_BLOCK, old = 2, vector_search.QUERY_BLOCK
    try:
        blocks = vector_search.search(chunks, asked, 5, metric="l2").collect()
    finally:
        vector_search.QUERY_BLOCK = old
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))


@pytest.mark.parametrize("k", [3, 40])
def test_tasks_hand_on_only_their_best(spark, monkeypatch, k):
    monkeypatch.setattr(ranking, "GROUP_LIMIT", 10)
    monkeypatch.setattr(ranking, "HELD_ROWS", 200)
    rng = random.Random(4)
    rows = [(q, i, float(rng.randrange(50))) for q in range(3) for i in range(700)]
    frame = spark.createDataFrame(rows, "query_id int, chunk_id int, s double").repartition(6)
    top = ranking.top_k(frame, k, ("s", True), ("chunk_id", False))
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString() if k <= 10 else True
    for q in range(3):
        want = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:k]
        assert [(r.chunk_id, r.rank) for r in top.filter(F.col("query_id") == q).orderBy("rank").collect()] == [(r[1], i) for i, r in enumerate(want)]
    if k > 10:
        best = frame.mapInArrow(ranking._best_of_task(k, "query_id", (("s", True), ("chunk_id", False))), frame.schema)
        assert best.groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0] <= k


def test_searches_prune_before_they_shuffle(spark):
    from folioscope.plans.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all("WindowGroupLimit" in plan(n) for n in ("vector_topk_cosine", "bm25_topk", "hybrid_filtered"))
    assert "MapInArrow" in plan("fetch_stats")


def test_filters_come_before_the_keyword_ranking(spark, tmp_path):
    """Many documents hold the word often; the only one with an equation holds it once."""
    from folioscope.plans.indexing import index_documents
    from folioscope.plans.knowledge_base import KnowledgeBase

    docs = [(f"d{i:03}", "# Heading\n\n" + ("needle " * 12 if i % 3 else "other ") + "words to fill up a chunk of some length " * 4) for i in range(330)]
    docs.append(("eq", "# Heading\n\nneedle once, and $x^2$ beside " + "words to fill up a chunk of some length " * 4))
    index_documents(spark, spark.createDataFrame(docs, "doc_id string, content string"), str(tmp_path / "kb"))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    for mode in ("bm25", "hybrid", "semantic"):
        assert [r.doc_id for r in kb.search_documents(["needle"], 5, mode=mode, equations=True).collect()] == ["eq"]


def test_index_state(spark, tmp_path):
    path = str(tmp_path / "index")
    assert bm25.Bm25Index.load(spark, path) is None and not bm25.wipe(spark, path)
    chunks = spark.createDataFrame([("c1", "alpha beta"), ("c2", ""), ("c3", None)], "chunk_id string, content string")
    bm25.build(chunks, path=path)
    index = bm25.Bm25Index.load(spark, path)
    assert index.corpus.first().n == 3 and index.postings.count() == 2
    assert bm25.wipe(spark, path) and bm25.Bm25Index.load(spark, path) is None
    empty = bm25.build(chunks.limit(0))
    assert bm25.search(empty, _ask(spark, "alpha"), 3).count() == 0


def test_postings_are_built_where_their_texts_lie(spark, monkeypatch, tmp_path):
    """No word is shuffled: a chunk's postings are in one file, sorted by term in runs; counts are right."""
    monkeypatch.setattr(bm25, "RUN", 40)
    rng = random.Random(5)
    docs = {i: [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))] for i in range(60)}
    rows = spark.createDataFrame([(i, " ".join(w) if w else None) for i, w in docs.items()], "chunk_id long, content string").repartition(3)
    index = bm25.build(rows, path=str(tmp_path / "i"))
    got = index.postings.withColumn("file", F.input_file_name()).collect()
    assert {(r.chunk_id, r.term): r.tf for r in got} == {(i, t): w.count(t) for i, w in docs.items() for t in w}
    assert len(got) == sum(len(set(w)) for w in docs.values()) and all(r.dl == len(docs[r.chunk_id]) for r in got)
    assert all(len({r.file for r in got if r.chunk_id == i}) <= 1 for i in docs)
    assert {(r.term, r.df) for r in index.terms.collect()} == {(t, sum(t in w for w in docs.values())) for t in "abcdefgh"}


def test_runs_are_sorted(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bm25, "RUN", 4)
    batches = [pa.RecordBatch.from_pydict({"term": pa.array(list(t), pa.string()), "n": pa.array(range(len(t)), pa.int64())}) for t in ("db", "ca", "", "fe")]
    assert ["".join(b.column("term").to_pylist()) for b in bm25.by_term(batches)] == ["abcd", "ef"]
