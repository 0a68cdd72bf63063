from pyspark.sql import functions as F

from folioscope.plans import upkeep
from folioscope.settings import load_settings, parse_env_file


def test_settings_come_from_defaults_file_and_environment():
    defaults = {"library_root": "/a", "most": 5, "dry": False, "share": 0.5}
    text = "# comment\nlibrary_root: '/b c'  # here\nmost: 7\nunknown: 1\ndry: yes\nshare:\n"
    assert load_settings(defaults) == defaults
    assert load_settings(defaults, text) == {"library_root": "/b c", "most": 7, "dry": True, "share": 0.5}
    assert load_settings(defaults, text, {"KB_MOST": "9", "KB_UNKNOWN": "1", "KB_SHARE": "0.25"}, "kb_") == {"library_root": "/b c", "most": 9, "dry": True, "share": 0.25}
    env = "# no\n\nA=1\nexport B='two words'\n C = \"3\" \nA=4\nbroken\nD=x"
    assert parse_env_file(env, {"D": "kept"}) == {"A": "1", "B": "two words", "C": "3"}


def test_removal_stops_where_the_target_is_not_one_file(spark):
    files = spark.createDataFrame([("a" * 64, "Lee 2020.pdf"), ("b" * 64, "Lee 2021.pdf"), ("b" * 64, "Lee 2021.pdf")], "content_sha256 string, display_name string")
    vectors = spark.createDataFrame([("a" * 64, 1), ("b" * 64, 2), ("b" * 64, 3), (None, 4)], "doc_id string, v int")
    stores = {"files": (files, "content_sha256"), "vectors": (vectors, "doc_id")}
    several = upkeep.remove_document(files, "lee", stores)
    assert several.status == "ambiguous" and several.matches.count() == 2 and not several.tables
    assert upkeep.remove_document(files, "nobody", stores).status == "not found"
    one = upkeep.remove_document(files, "bbbbbb", stores)
    assert one.status == "removed" and {r.store: r.removed for r in one.counts.collect()} == {"files": 2, "vectors": 2}
    assert one.tables["files"].count() == 1 and sorted(r.v for r in one.tables["vectors"].collect()) == [1, 4]


def test_reconciling_twice_does_nothing_more(spark):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "content_sha256 string")
    found = spark.createDataFrame([("n", "/b"), ("n", "/a"), ("s", "/s")], "content_sha256 string, path string")
    stored, linked, missing = rows("s", "t"), rows("t", "z", "gone"), rows("gone")
    actions = upkeep.reconcile_actions(found, stored, linked, missing)
    assert sorted(map(tuple, actions.collect()), key=str) == sorted([("n", "/a", "store"), ("z", None, "fetch"), ("n", None, "link"), ("s", None, "link")], key=str)
    failed = spark.createDataFrame([("z", "fetch")], "content_sha256 string, action string")
    stored, linked = upkeep.apply_actions(actions, stored, linked, failed)
    again = upkeep.reconcile_actions(found, stored, linked, missing)
    assert [tuple(r) for r in again.collect()] == [("z", None, "fetch")]
    stored, linked = upkeep.apply_actions(again, stored, linked)
    assert upkeep.reconcile_actions(found, stored, linked, missing).count() == 0


def test_lists_and_backfill(spark):
    made = spark.createDataFrame([("e1", "p", 1), ("e2", "p", 3), ("e3", "q", 2)], "experiment_id string, project_id string, created_date int")
    assert [r.experiment_id for r in upkeep.listed_experiments(made).collect()] == ["e2", "e3", "e1"]
    assert [r.experiment_id for r in upkeep.listed_experiments(made, "p").collect()] == ["e2", "e1"]
    values = spark.createDataFrame([("m", "e1", 0.5), ("m", "e2", None), ("m", "e3", 0.7), ("x", "e1", 9.0)], "metric string, experiment_id string, value double")
    assert [r.experiment_id for r in upkeep.comparison_summary(values, "m").collect()] == ["e3", "e1", "e2"]
    sources = spark.createDataFrame([("h", "xmp"), ("h", "grobid"), ("i", "a")], "content_sha256 string, extractor_name string")
    assert [r.extractor_name for r in upkeep.metadata_sources(sources, "h").collect()] == ["grobid", "xmp"]
    vectors = spark.createDataFrame([("d", 0, "v"), ("d", 1, "v"), ("e", 2, "v")], "doc_id string, chunk_index int, content string")
    whole, gaps = upkeep.backfilled_chunks(vectors, vectors.filter("chunk_index = 0").withColumn("content", F.lit("own")))
    assert sorted((r.doc_id, r.chunk_index, r.content) for r in whole.collect()) == [("d", 0, "own"), ("d", 1, "v"), ("e", 2, "v")]
    assert [r.doc_id for r in gaps.collect()] == ["e"]
