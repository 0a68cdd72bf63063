import numpy as np
import pytest

from folioscope.operators import vector_index, vector_search
from folioscope.operators.vector_index import VectorIndex, build, recall
from folioscope.sources.places import work_path


def vectors(spark, n=1200, width=12, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (25, width))
    x = centers[rng.integers(0, 25, n)] + rng.normal(0, 0.35, (n, width))
    if copies:
        x[:copies] = x[0]
    return spark.createDataFrame([(f"c{i:05d}", i % 40, row.tolist()) for i, row in enumerate(x)], "chunk_id string, doc_id int, embedding array<double>")


def asked(chunks, part=80):
    return chunks.filter(f"pmod(xxhash64(chunk_id), {part}) = 0").selectExpr("chunk_id AS query_id", "embedding AS vector")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.doc_id, r.distance) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_and_exact_search(spark, metric):
    chunks = vectors(spark)
    path = work_path(spark, "vec")
    build(chunks, path, metric=metric)
    index, ask = VectorIndex(spark, path), asked(chunks)
    want = vector_search.search(chunks, ask, 10, metric=metric)
    got = recall(index.search(ask, 10, probes=12), want).agg({"wanted": "sum", "found": "sum"}).first()
    assert got["sum(wanted)"] == 10 * ask.count() and got["sum(found)"] >= 0.95 * got["sum(wanted)"]
    assert rows_of(index.search(ask, 10, probes=2, exact=True)) == rows_of(want)
    # more than the nearest cells hold
    few = ask.limit(2)
    assert rows_of(index.search(few, 1100, probes=1, exact=True)) == rows_of(vector_search.search(chunks, few, 1100, metric=metric))


def test_cells_that_are_not_asked_for_are_not_read(spark):
    chunks = vectors(spark)
    index = build(chunks, work_path(spark, "vec"))
    plan = index.rows([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "cell#" in plan and index.rows([1, 2]).count() == index.sizes[1] + index.sizes[2]
    assert index.sizes.sum() == 1200 and len(index.sizes) == 35
    read = []
    whole = VectorIndex.rows
    index.rows = lambda cells: read.append(len(cells)) or whole(index, cells)
    one = asked(chunks).limit(1)
    index.search(one, 5, probes=3, exact=True).collect()
    assert read[0] == 3 and sum(read) < 30


def test_copies_small_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 5)
    # a third of all rows are one vector; more queries than a block
    chunks = vectors(spark, 450, 6, 3, copies=150)
    index, ask = build(chunks, work_path(spark, "vec"), subspaces=50), asked(chunks, 40)
    assert ask.count() > 5
    assert rows_of(index.search(ask, 20, probes=2, exact=True)) == rows_of(vector_search.search(chunks, ask, 20))
    odd = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, None), ("z", 1, [0.0, 0.0])], "chunk_id string, doc_id int, embedding array<double>")
    small = build(odd, work_path(spark, "vec"))
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, vector array<double>")
    for exact in (True, False):
        assert [(r.chunk_id, r.distance) for r in small.search(q, 5, exact=exact).collect()] == [("a", 1.0)]
        assert small.search(q.limit(0), 5, exact=exact).count() == 0
    with pytest.raises(ValueError):
        build(odd.limit(0), work_path(spark, "vec"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_many_queries_are_compared_by_products(spark, monkeypatch, metric):
    """The rows of a search by built-ins alone, also with copies, rows and queries without a vector or of another width; few
    pairs are left to the built-ins."""
    monkeypatch.setattr(vector_search, "PRODUCT_ROWS", 100)
    chunks = vectors(spark, 900, 6, 5, copies=300).repartition(3)
    odd = spark.createDataFrame([(f"a{i}", 0, v) for i, v in enumerate([None, [1.0], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [1e-105] * 6] + [None] * 20)], chunks.schema)
    both, ask = chunks.unionByName(odd), asked(chunks, 12).unionByName(spark.createDataFrame([("x", None), ("y", [2.0] * 7)], "query_id string, vector array<double>"))
    n = ask.count()
    assert n > vector_search.FEW
    alone = lambda rows, k: rows_of(vector_search._search_block(rows, ask, k, False, metric=metric))
    for rows, k in ((both, 10), (both, 400), (odd, 8)):
        got, want = rows_of(vector_search.search(rows, ask, k, metric=metric)), alone(rows, k)
        assert repr(got) == repr(want) and len(got) == n * min(k, rows.count())
    pool, q = chunks.selectExpr("chunk_id", "doc_id", "embedding AS v"), asked(chunks, 12).selectExpr("query_id", "vector AS q")
    near = vector_search._pairs(pool, q, 5, metric, 9)
    assert "MapInArrow" in near._jdf.queryExecution().executedPlan().toString() and near.count() < 0.1 * 900 * q.count()


def test_recall_of_vectors_without_clusters(spark):
    """Neighbours lie in many cells then; how many are probed is measured by the build."""
    x = np.random.default_rng(8).normal(0, 1, (3000, 24))
    chunks = spark.createDataFrame([(f"c{i:05d}", 0, row.tolist()) for i, row in enumerate(x)], "chunk_id string, doc_id int, embedding array<double>")
    index, ask = build(chunks, work_path(spark, "vec")), asked(chunks, 60)
    got = recall(index.search(ask, 10), vector_search.search(chunks, ask, 10)).agg({"wanted": "sum", "found": "sum"}).first()
    assert got["sum(found)"] >= 0.93 * got["sum(wanted)"] and index.probes > 16
    close = build(vectors(spark), work_path(spark, "vec"))
    assert 1 <= close.probes < 16
