"""Properties that hold for all inputs, on generated ones (few, as each is a Spark job)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions.vectors import similarity
from folioscope.operators import bm25, dml, ranking
from folioscope.operators.chunking import chunk_rows, section_chunks_of

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
WORDS = st.lists(st.sampled_from("alpha beta gamma delta x_1".split()), max_size=12).map(" ".join)


@few
@given(ds=st.lists(st.one_of(st.none(), st.floats(-5, 1e6)), min_size=1, max_size=40))
def test_similarity_is_within_bounds(spark, ds):
    rows = spark.createDataFrame([(d,) for d in ds], "d double").select(similarity(F.col("d")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in rows)


@few
@given(docs=st.lists(WORDS, min_size=1, max_size=12), query=WORDS)
def test_best_keyword_score_is_one_or_all_are_zero(spark, docs, query):
    index = bm25.build(spark.createDataFrame(list(enumerate(docs)), "chunk_id int, content string"))
    rows = bm25.search(index, spark.createDataFrame([(0, query)], "query_id int, query string"), 50).collect()
    assert len(rows) == len(docs) and sorted(r.rank for r in rows) == list(range(len(docs)))
    top = max(r.raw_score for r in rows)
    assert max(r.score for r in rows) == (1.0 if top > 0 else 0.0)


@few
@given(order=st.permutations(list(range(6))))
def test_fusion_does_not_depend_on_the_rows_order(spark, order):
    sem = [(1, f"c{i}", f"d{i % 2}", 1 - i / 10, i) for i in range(6)]
    key = [(1, f"c{i}", 5 - i) for i in range(6)]
    frame = lambda rows, s: spark.createDataFrame([rows[i] for i in order], s)
    fused = ranking.fuse(frame(sem, "query_id int, chunk_id string, doc_id string, similarity double, rank int"), frame(key, "query_id int, chunk_id string, rank int"))
    got = [(r.doc_id, r.rank, r.chunk_id, r.score) for r in ranking.fused_documents(fused).orderBy("rank").collect()]
    # c0 and c5 have the same two ranks, so their documents tie and the lesser id comes first
    assert [g[:3] for g in got] == [("d0", 0, "c0"), ("d1", 1, "c5")] and got[0][3] == got[1][3]


@few
@given(parts=st.lists(st.text("ab \n#", max_size=12), max_size=10))
def test_chunks_lose_no_letter(spark, parts):
    content = "\n\n".join(parts)
    letters = lambda t: [c for c in t if c in "ab"]
    rows = chunk_rows(spark.createDataFrame([(1, content)], "doc_id int, content string"), most=15).orderBy("chunk_index").collect()
    assert letters("".join(r.content for r in rows)) == letters(content)
    assert letters("".join(t for t, _ in section_chunks_of(content, 10**6, 5))) == letters(content)


@few
@given(old=st.dictionaries(st.integers(0, 9), st.text("xy", max_size=3), max_size=6), new=st.dictionaries(st.integers(0, 9), st.text("xy", max_size=3), max_size=6))
def test_upsert_twice_is_upsert_once(spark, old, new):
    frame = lambda d: spark.createDataFrame([(k, v, 0) for k, v in d.items()], "k int, v string, at int")
    once = dml.upsert(frame(old), frame(new), ["k"], "at")
    read = lambda df: {r.k: r.v for r in df.collect()}
    assert read(once) == old | new == read(dml.upsert(once, frame(new), ["k"], "at"))
