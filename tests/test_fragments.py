import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import fragments
from folioscope.operators.fragments import FragmentIndex, pieces
from folioscope.sources.places import work_path


def test_pieces():
    assert pieces("%ab_c%%def") == ["ab", "c", "def"] and pieces(r"a\%b\_c\\d") == ["a%b_c\\d"] and pieces("%_%") == []


@pytest.mark.parametrize("named", [1000, 2])
def test_rows_are_those_of_ilike(spark, monkeypatch, named):
    monkeypatch.setattr(fragments, "NAMED", named)
    rng = random.Random(4)
    names = ["".join(rng.choice(["ab", "Abc", "x_", "50%", "é", "İ", " ", "pdf", "Whale", "\\"]) for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "", "same name.pdf", "same name.pdf"]
    rows = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(names)], "doc int, title string, row string")
    index = FragmentIndex.build(rows.repartition(3), work_path(spark, "names"), id_col="doc", name_col="title")
    for pattern in ["%whale%", "%PDF", "ab%", "%c_x%", "", "%", "__", r"%50\%%", r"%x\_%", "%éab%", "%not there%", "same name.pdf", "%abc%whale%pdf%", "%i̇%"]:
        want = sorted((r.doc, r.title) for r in rows.filter(F.ilike("title", F.lit(pattern))).collect())
        assert sorted(tuple(r) for r in index.search(pattern).collect()) == want, pattern
    empty = FragmentIndex.build(rows.limit(0), work_path(spark, "names"), id_col="doc", name_col="title")
    assert empty.search("%whale%").count() == 0 and empty.search("%").count() == 0


def test_common_grams_are_not_read(spark):
    rows = spark.range(5000).selectExpr("id", "concat('common words of ', id, if(id % 1000 = 7, ' zebra', ''), '.pdf') AS name")
    index = FragmentIndex.build(rows, work_path(spark, "names"), id_col="id", name_col="name")
    assert index.candidates("%common%zebra%.pdf").count() == 5
    found = index.search("%common%zebra%.pdf")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(row" in plan and found.count() == 5
    assert index.candidates("%qqq%").count() == 0 and index.candidates("%z%") is None


def test_grams_of_long_and_odd_names(spark, tmp_path):
    """A name of 300,000 characters takes seconds, not a walk over it for every place; characters are code points."""
    import time

    names = [(0, "ab" * 150_000 + "xyz"), (1, "é🙂日本"), (2, "ab"), (3, ""), (4, "ABCabc")]
    began = time.time()
    index = FragmentIndex.build(spark.createDataFrame(names, "id long, name string"), str(tmp_path / "long"), id_col="id", name_col="name")
    grams = {r.gram for r in spark.read.parquet(f"{index.path}/grams").collect()}
    assert grams == {"aba", "bab", "abx", "bxy", "xyz", "é🙂日", "🙂日本", "abc", "bca", "cab"}
    assert time.time() - began < 30
    assert [r.id for r in index.search("%bxyz").collect()] == [0] and [r.id for r in index.search("%🙂日%").collect()] == [1]
