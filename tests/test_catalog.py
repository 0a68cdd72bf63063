import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import catalog, dml, experiments, reconcile, topics
from folioscope.plans.ingest import enrich, ingest

H = {i: str(i) * 64 for i in range(1, 10)}
T = [dt.datetime(2024, 1, i) for i in range(1, 10)]


def files(spark, *rows):
    return spark.createDataFrame([(H[i], None, None, None, None, size, T[0]) for i, size in rows], schemas.CANONICAL_FILES)


def links(spark, *rows):
    return spark.createDataFrame([(H[i], status) for i, status in rows], "content_sha256 string, status string")


def test_links_and_statistics(spark):
    f, z = files(spark, (1, 100), (2, 200), (3, 300)), links(spark, (1, "imported"), (2, "pending"))
    assert [r.content_sha256 for r in catalog.unlinked(f, z).collect()] == [H[2], H[3]]
    assert catalog.linked_count(f, z).first()[0] == 1 and catalog.stored_bytes(f).first()[0] == 600
    assert catalog.stored_bytes(f.limit(0)).first()[0] == 0
    log = spark.createDataFrame([(1, H[1], "new", None, None, T[0]), (2, H[2], "failed", None, None, T[1])], schemas.INGEST_LOG)
    assert tuple(catalog.recent_log(log, 1).first())[1:3] == (H[2], "failed")
    assert tuple(catalog.statistics(f, z, z, log).first()) == (3, 2, 2, 2, 2)
    assert catalog.unresolved(f, z).count() == 1


def test_target_filter(spark):
    df = spark.createDataFrame([("ab" * 32, "Deep Nets"), ("ac" * 32, "Shallow")], "content_sha256 string, display_name string")
    for target, n in (("ab" * 32, 1), ("ABABAB", 1), ("deep", 1), ("a", 1), ("%e%s", 1), ("zzzz", 0)):
        assert df.filter(catalog.target_filter(target)).count() == n


def test_subset(spark):
    df = spark.createDataFrame([(1, T[0], "done", "A.pdf", 10), (2, T[1], "done", "b.pdf", 20), (3, T[2], "open", "ab.pdf", 30)], "doc_id int, added_date timestamp, status string, filename string, file_size_bytes long")
    ids = lambda **k: [r.doc_id for r in catalog.subset(df, **k).collect()]
    assert ids() == [3, 2, 1] and ids(status="done", limit=1) == [2] and ids(name_contains="A") == [3, 1]
    assert ids(size_range=(15, None)) == [3, 2, 1] and ids(size_range=(15, 25)) == [2] and ids(date_from="2024-01-02", date_to="2024-01-02") == [2]
    assert ids(sort_by="filename", descending=False) == [1, 3, 2]
    with pytest.raises(ValueError):
        catalog.subset(df, sort_by="size")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", T[0]), (2, "b", T[0])], "k int, v string, at timestamp")
    new = spark.createDataFrame([(2, "c", T[0]), (3, "d", T[1])], "k int, v string, at timestamp")
    up = lambda a, b: sorted(tuple(r)[:2] for r in dml.upsert(a, b, ["k"], "at").collect())
    assert up(old, new) == [(1, "a"), (2, "c"), (3, "d")] == up(dml.upsert(old, new, ["k"], "at"), new)
    assert sorted(r.v for r in dml.insert_new(old, new, ["k"]).collect()) == ["a", "b", "d"]
    assert {r.k: r.inserted for r in dml.inserted_flags(old, new, ["k"]).collect()} == {2: False, 3: True}
    with pytest.raises(ValueError):
        dml.insert_strict(old, new, ["k"])
    assert dml.insert_strict(old, new.filter("k = 3"), ["k"]).count() == 3
    assert sorted(r.v for r in dml.update_where(old, F.col("k") == 1, {"v": F.lit("z")}).collect()) == ["b", "z"]
    assert sorted(r.v for r in dml.update_from(old, new.select("k", "v"), ["k"], ["v"]).collect()) == ["a", "c"]
    assert dml.delete_where(old, F.col("k") == 1).count() == 1 and tuple(dml.delete_counts(old, F.col("k") == 1).first()) == (1, 1)


def test_sightings(spark):
    row = lambda a, b: (H[1], "/p", "m", a, b)
    s = spark.createDataFrame([row(T[1], T[1])], schemas.SOURCE_SIGHTINGS)
    again = dml.upsert_sightings(s, spark.createDataFrame([row(T[3], T[3]), row(T[2], T[2])], schemas.SOURCE_SIGHTINGS))
    assert tuple(again.first())[3:] == (T[1], T[3])


def test_chunks(spark):
    c = spark.createDataFrame([("d1", i, f"t{i}") for i in range(5)] + [("d2", 0, "x"), ("d2", 2, "y")], "doc_id string, chunk_index int, content string")
    assert [r.chunk_index for r in catalog.chunk_range(c, "d1", 1, 3).collect()] == [1, 2, 3]
    assert {r.doc_id: r.has_gap for r in dml.index_gaps(c).collect()} == {"d1": False, "d2": True}
    new = spark.createDataFrame([("d1", 0, "n")], "doc_id string, chunk_index int, content string")
    assert sorted(r.content for r in dml.replace_chunks(c, new).collect()) == ["n", "x", "y"]
    assert {r.doc_id: r.chunk_count for r in catalog.chunk_counts(c).collect()} == {"d1": 5, "d2": 2}


def test_cascades(spark):
    d = spark.createDataFrame([("d1", H[1]), ("d2", H[2])], "doc_id string, content_hash string")
    e = spark.createDataFrame([("e1", "d1"), ("e2", "d2")], "extraction_id string, doc_id string")
    left = dml.cascade_delete(d, e, e, spark.createDataFrame([(H[1],)], "content_hash string"))
    assert [t.count() for t in left] == [1, 1, 1]
    tables = dml.remove_from_catalog({"f": files(spark, (1, 1), (2, 2))}, links(spark, (1, "x")))
    assert tables["f"].count() == 1
    chunks = spark.createDataFrame([(H[1], "old"), (H[2], "same"), ("x", "keep")], "doc_id string, pdf_name string")
    names = spark.createDataFrame([(H[1], "new"), (H[2], "same")], "content_sha256 string, display_name string")
    assert {r.doc_id: (r.pdf_name, r.changed) for r in dml.renamed(chunks, names).collect()} == {H[1]: ("new", True), H[2]: ("same", False), "x": ("keep", False)}


def test_decisions(spark):
    row = lambda i, d, t: (H[i], d, "/p", "p.pdf", 1, 1, t, None)
    empty, none = spark.createDataFrame([], schemas.TRIAGE_DECISIONS), spark.createDataFrame([], schemas.DECISION_HISTORY)
    one, hist = dml.set_decisions(empty, none, spark.createDataFrame([row(1, "approved", T[0])], schemas.TRIAGE_DECISIONS), schemas.DECISIONS)
    two, hist = dml.set_decisions(one, hist, spark.createDataFrame([row(1, "approved", T[1])], schemas.TRIAGE_DECISIONS), schemas.DECISIONS)
    three, hist = dml.set_decisions(two, hist, spark.createDataFrame([row(1, "rejected", T[2])], schemas.TRIAGE_DECISIONS), schemas.DECISIONS)
    assert [(r.old_decision, r.new_decision) for r in hist.orderBy("changed_at").collect()] == [(None, "approved"), ("approved", "rejected")]
    assert three.first().decision == "rejected" and tuple(catalog.conditional_counts(three).first()) == (0, 1, 1)
    with pytest.raises(ValueError):
        dml.set_decisions(one, hist, spark.createDataFrame([row(1, "maybe", T[1])], schemas.TRIAGE_DECISIONS), schemas.DECISIONS)


def sources(spark, *rows):
    return spark.createDataFrame([(H[1], n, t, a, y, j, ab, None) for n, t, a, y, j, ab in rows], "content_sha256 string, extractor_name string, title string, authors array<string>, year int, journal string, abstract string, doc_type string")


def test_metadata_merge(spark):
    m = reconcile.merge_metadata(sources(spark, ("xmp", "XMP Title", ["A", "B"], 2020, "J", None), ("grobid", "GROBID Title", ["S"], 2023, None, None), ("arxiv", "", ["a", "b", "c"], 1, "no", "no"), ("semantic_scholar", "S2", ["C", "D"], None, None, "Abs"))).first()
    assert (m.title, m.year, m.journal, m.abstract, m.authors) == ("GROBID Title", 2023, "J", "Abs", ["C", "D"])
    assert m.source_extractors == ["grobid", "semantic_scholar", "xmp"]
    assert reconcile.all_filled(sources(spark, ("xmp", "t", ["a"], 1, None, "x"))).first().all_filled
    assert not reconcile.all_filled(sources(spark, ("xmp", "t", [], 1, None, "x"))).first().all_filled


def test_register_and_reconcile(spark):
    f = spark.createDataFrame([("d1", "h1", 0), ("d2", "h1", 1), ("d3", "h2", 2)], "doc_id string, content_hash string, seq int")
    got = {r.doc_id: (r.linked_to, r.is_new) for r in reconcile.register(f).collect()}
    assert got == {"d1": ("d1", True), "d2": ("d1", False), "d3": ("d3", True)}
    assert {r.doc_id for r in reconcile.register(f, f.filter("doc_id = 'd1'").select("content_hash")).filter("is_new").collect()} == {"d3"}
    scan = spark.createDataFrame([("alpha", "/a"), ("alpha", "/b"), ("beta", "/c")], "content_sha256 string, path string")
    lib = spark.createDataFrame([("gamma",)], "content_sha256 string")
    r = reconcile.reconcile(scan, lib.limit(0), lib).first()
    assert (r.found, r.unique_files, r.duplicates, r.new_files, r.only_in_library, r.not_linked) == (3, 2, 1, 2, 1, 2)
    after = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "content_sha256 string")
    r = reconcile.reconcile(scan, after, lib).first()
    assert (r.new_files, r.already_stored, r.only_in_library) == (0, 2, 0)
    plan = reconcile.copy_plan(scan, spark.createDataFrame([("alpha", "/0"), ("gamma", "/g")], "content_sha256 string, path string"))
    assert {x.content_sha256: x.path for x in plan.collect()} == {"alpha": "/a", "beta": "/c", "gamma": "/g"}
    s = spark.createDataFrame([("a.pdf", "1" * 64, 0), ("a.pdf", "2" * 64, 1), ("x/a.pdf", "2" * 64, 2), ("", "3" * 64, 3), ("noext", "4" * 64, 4)], "original_filename string, content_sha256 string, seq int")
    assert [x.staged_name for x in reconcile.staged_names(s).orderBy("seq").collect()] == ["a.pdf", "a_22222222.pdf", "a_22222222_2.pdf", "33333333.pdf", "noext"]


def test_ingest_twice_and_enrich(spark):
    scan = spark.createDataFrame([("/a/x.pdf", 5, H[1]), ("/b/y.pdf", 5, H[1]), ("/c/z.pdf", 7, H[2]), ("/d/empty.pdf", 0, H[3])], "path string, length long, content_sha256 string")
    tables = [spark.createDataFrame([], s) for s in (schemas.CANONICAL_FILES, schemas.SOURCE_SIGHTINGS, schemas.INGEST_LOG)]
    f, s, g, one = ingest(scan, *tables, "m", "2024-01-01")
    assert tuple(one.first()) == (4, 2, 1, 1, 2) and (f.count(), s.count(), g.count()) == (2, 3, 4)
    f2, s2, g2, two = ingest(scan, f, s, g, "m", "2024-01-02")
    assert tuple(two.first()) == (4, 0, 3, 1, 2) and f2.count() == 2 and [r.log_id for r in g2.orderBy("log_id").collect()] == list(range(1, 9))
    assert {(r.first_seen, r.last_seen) for r in s2.collect()} == {(T[0], T[1])}
    resolved, bib = enrich(f, sources(spark, ("xmp", "Deep Nets", ["Ann Lee"], 2020, None, None)), spark.createDataFrame([], schemas.METADATA_RESOLVED), "2024-01-01")
    assert [r.title for r in resolved.collect()] == ["Deep Nets"] and bib.first().citation_key == f"lee-2020-deep-{H[1][:12]}"


def test_experiments(spark):
    res = spark.createDataFrame([("a", "q1", 1, 0.5), ("a", "q1", 1, 0.7), ("a", "q1", 2, 0.9), ("a", "q2", 3, 0.2), ("b", "q1", 2, 0.4)], "experiment_id string, query string, doc_id int, similarity double")
    asked = spark.createDataFrame([(e, q) for e in "ab" for q in ("q1", "q2")], "experiment_id string, query string")
    got = {(r.metric, r.experiment_id): r.value for r in experiments.compare(asked, res, "a", ["avg_similarity", "result_overlap", "query_coverage", "unknown"]).collect()}
    assert got == {("avg_similarity", "a"): 0.45, ("avg_similarity", "b"): 0.4, ("result_overlap", "a"): 1.0, ("result_overlap", "b"): 0.25, ("query_coverage", "a"): 1.0, ("query_coverage", "b"): 0.5}


def test_topics(spark):
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "doc_id int, chunk_index int, content string")
    assert {r.doc_id: r.text for r in topics.document_texts(chunks).collect()} == {1: "a b", 2: "c"}
    docs = spark.createDataFrame([(0, 1, "red red apple the"), (0, 2, "red pear"), (1, 3, "blue sky red"), (1, 4, "blue sea")], "topic_id int, doc_id int, text string")
    words = topics.topic_words(topics.class_tfidf(docs), 1)
    assert {r.topic_id: r.term for r in words.collect()} == {0: "red", 1: "blue"}
    vs = spark.createDataFrame([(i, [float(i > 4), float(i <= 4), 0.1 * i, 0.0, 1.0, 0.0]) for i in range(10)], "doc_id int, embedding array<double>")
    got = topics.assign_topics(vs, 2)
    assert len({r.topic_id for r in got.filter("doc_id <= 4").collect()}) == 1 and got.select("topic_id").distinct().count() == 2
    assert topics.topic_summary(got, words).count() == 2
    rows = topics.topic_rows(got, words, vs.select("doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).alias("year")))
    assert {r.title for r in rows.collect()} == {str(i) for i in range(10)}


def test_lookups(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "k int, v int")
    assert catalog.lookup(df, "k", []).count() == 0 and [r.k for r in catalog.lookup(df, "k", [3, 9, 99], "k").collect()] == [9, 3]
    assert catalog.lookup(df, "k", list(range(5, 3000))).count() == 15
    assert catalog.exists(df, F.col("k") == 3) and not catalog.exists(df, F.col("k") == 33)
    log = spark.createDataFrame([(1, "a", None, "approved", T[0]), (2, "a", "approved", "rejected", T[1]), (3, "b", None, "approved", T[1])], schemas.DECISION_HISTORY)
    assert [r.id for r in catalog.decision_log(log).collect()] == [3, 2, 1] and [r.id for r in catalog.decision_log(log, "approved", 1).collect()] == [3]
