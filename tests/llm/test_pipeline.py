import numpy as np

import corpus_pipeline
from folioscope.llm.contamination import contamination
from folioscope.llm.near_duplicates import near_duplicates
from folioscope.llm.secrets import secrets
from folioscope.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_what_they_decide(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = read("documents")
    columns = docs.columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}

    one = corpus_pipeline.toxicity(spark, docs, SF).cache()
    assert one.columns == columns
    assert ids(one) == ids(toxicity(docs, read("labels")).filter("predicted = 0"))
    two = corpus_pipeline.near_dedup(spark, one, SF).cache()
    assert two.columns == columns and ids(two) == ids(near_duplicates(one).filter("kept"))
    three = corpus_pipeline.decontamination(spark, two, SF).cache()
    assert three.columns == columns and ids(three) == ids(contamination(two, read("benchmark")).filter("NOT contaminated"))
    four = corpus_pipeline.secret_scan(spark, three, SF).cache()
    assert four.columns == columns and ids(four) == ids(three)
    clean = {r.doc_id: r.redacted_text for r in secrets(three, with_text=True).collect()}
    assert {r.doc_id: r.text for r in four.collect()} == clean
    assert all(r.n_chars == len(r.text) for r in four.collect())
    five = corpus_pipeline.packing(spark, four, SF).collect()
    assert {r.doc_id for r in five} == ids(four)
    for s in {r.sequence_id for r in five}:
        own = sorted((r.offset, r.length) for r in five if r.sequence_id == s)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 1024
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in five)


def test_odd_rows_pass(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", "en", None, 0), (3, "x", None, "s", 1), (3, "x", None, "s", 1), (None, "y", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 4  # one of the two equal rows of id 3 goes as a duplicate


def test_empty_tables_and_clashing_columns_pass(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, class string, kept boolean, spans string, row long, score double"
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15, "c", True, "p", 1, 0.5), (2, "other words there", "en", "s", 17, "c", True, "p", 1, 0.5)], odd)
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        assert now.count() == rows.count() == corpus_pipeline.packing(spark, now, SF).count()
