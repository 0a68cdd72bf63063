import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from folioscope.operators.hooks import embed, embedder, extract
from folioscope.plans.indexing import index_documents
from folioscope.plans.knowledge_base import KnowledgeBase
from folioscope.sources import files, sinks
from folioscope.streaming import incremental


def test_scans(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.pdf", b"one"), ("sub/b.PDF", b"two"), ("sub/c.pdf", b"one"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    os.utime(tmp_path / "a.pdf", (time.time() + 50,) * 2)
    scan = files.scan_files(spark, [str(tmp_path), str(tmp_path / "sub")], content=True)
    assert scan.count() == 3 and "content" not in files.scan_files(spark, [str(tmp_path)]).columns
    hashed = files.with_hashes(scan)
    first = files.first_path_per_hash(hashed)
    assert {r.content_sha256: os.path.basename(r.path) for r in first.collect()} == {hashlib.sha256(b"one").hexdigest(): "a.pdf", hashlib.sha256(b"two").hexdigest(): "b.PDF"}
    assert files.recent_files(scan, 1).first().path.endswith("a.pdf")
    decided = spark.createDataFrame([(hashlib.sha256(b"two").hexdigest(), "approved")], "content_sha256 string, decision string")
    assert sorted(r.decision for r in files.with_decisions(hashed, decided).collect()) == ["approved", "undecided", "undecided"]
    assert files.not_yet_translated(hashed, decided).count() == 2
    outs = spark.createDataFrame([("h", "nougat", "z"), ("h", "marker", "a"), ("h", "marker", "b")], "content_sha256 string, tool string, path string")
    assert tuple(files.newest_extraction(outs, ["marker", "nougat"]).first()) == ("h", "marker", "b")
    with pytest.raises(Exception):
        files.scan_files(spark, [str(tmp_path / "none")]).count()


def test_inputs(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"path": "x"}, "y"]))
    assert [r.path for r in files.batch_input(spark, str(tmp_path / "l.json")).collect()] == ["x", "y"]
    assert [r.path for r in files.batch_input(spark, [{"path": "p"}, "q", "r"], 2).collect()] == ["p", "q"]
    (tmp_path / "c.json").write_text('{"h": {"title": "T"}}')
    assert files.json_cache(spark, str(tmp_path / "c.json"), "struct<title:string>").first().value.title == "T"
    (tmp_path / "bad.json").write_text("not json")
    assert files.json_cache(spark, str(tmp_path / "bad.json"), "string").count() == 0 == files.json_cache(spark, str(tmp_path / "gone.json"), "string").count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("h", "T", ["A B"], 2020, "J", None, "book")], "content_sha256 string, title string, authors array<string>, year int, journal string, abstract string, doc_type string")
    sinks.write_bib(df, str(tmp_path / "bib"))
    assert "@book{b-2020-t-h," in spark.read.text(str(tmp_path / "bib")).agg(F.concat_ws("\n", F.collect_list("value"))).first()[0]
    sinks.write_csv(df.select("title", "year"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().title == "T"
    (tmp_path / "x.pdf").write_bytes(b"data")
    sha = hashlib.sha256(b"data").hexdigest()
    plan = spark.createDataFrame([(sha, str(tmp_path / "x.pdf"), "n.pdf"), ("0" * 64, str(tmp_path / "x.pdf"), "m.pdf")], "content_sha256 string, path string, name string")
    for _ in range(2):
        rows = {r.content_sha256: r for r in sinks.store_files(plan, str(tmp_path / "lib")).collect()}
        assert rows[sha].stored_path.endswith(f"sha256/{sha[:2]}/{sha[2:4]}/{sha}/n.pdf") and "differs" in rows["0" * 64].error


def test_streams_fold_batches(spark, tmp_path):
    src, t = str(tmp_path / "in"), "content_sha256 string, path string"
    spark.createDataFrame([("h1", "/b"), ("h2", "/c")], t).coalesce(1).write.parquet(src)
    run = lambda: incremental.ingest_stream(spark.readStream.schema(t).parquet(src), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    spark.createDataFrame([("h1", "/a"), ("h3", "/d")], t).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(tuple(r) for r in incremental.current(spark, str(tmp_path / "t"), t).collect()) == [("h1", "/b"), ("h2", "/c"), ("h3", "/d")]
    s = "doc_id string, status string, at timestamp"
    at = [F.to_timestamp(F.lit(x)) for x in ("2024-01-01", "2024-01-02")]
    spark.createDataFrame([("d1",), ("d2",)], "doc_id string").select("doc_id", F.lit("pending").alias("status"), at[0].alias("at")).union(spark.createDataFrame([("d1",)], "doc_id string").select("doc_id", F.lit("failed"), at[1])).write.parquet(str(tmp_path / "s"))
    incremental.state_stream(spark.readStream.schema(s).parquet(str(tmp_path / "s")), str(tmp_path / "st"), str(tmp_path / "sc")).awaitTermination()
    states = incremental.current(spark, str(tmp_path / "st"), s)
    assert {r.doc_id: r.status for r in states.collect()} == {"d1": "failed", "d2": "pending"} and incremental.to_retry(states).count() == 1
    ch = "chunk_id string, content string"
    spark.createDataFrame([("c1", "alpha beta"), ("c2", "beta")], ch).write.parquet(str(tmp_path / "ch"))
    incremental.index_stream(spark.readStream.schema(ch).parquet(str(tmp_path / "ch")), str(tmp_path / "cht"), str(tmp_path / "bm"), str(tmp_path / "chc")).awaitTermination()
    assert incremental.current_index(spark, str(tmp_path / "bm")).terms.count() == 2
    more = tmp_path / "ch2"
    spark.createDataFrame([("c3", "gamma")], ch).write.parquet(str(more))
    for f in more.glob("*.parquet"):
        f.rename(tmp_path / "ch" / f.name)
    incremental.index_stream(spark.readStream.schema(ch).parquet(str(tmp_path / "ch")), str(tmp_path / "cht"), str(tmp_path / "bm"), str(tmp_path / "chc")).awaitTermination()
    assert incremental.current_index(spark, str(tmp_path / "bm")).terms.count() == 3
    assert incremental.drop_versions(spark, str(tmp_path / "bm"), 1, "corpus/_SUCCESS") == [0]
    assert incremental.current_index(spark, str(tmp_path / "bm")).terms.count() == 3
    assert incremental.current_index(spark, str(tmp_path / "nothing")) is None


def test_late_rows_are_left_out(spark, tmp_path):
    s = "ts timestamp, k string"
    row = lambda x: spark.createDataFrame([(x, "k")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").coalesce(1)
    row("2024-01-01 00:00:01").write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w"))
    counted = incremental.windowed_counts(stream, "ts", "1 minute", "1 minute", "k")
    q = counted.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "wc")).start()
    for x in ("2024-01-01 00:10:00", "2024-01-01 00:00:02", "2024-01-01 00:30:00", "2024-01-01 00:31:00"):
        q.processAllAvailable()
        row(x).write.mode("append").parquet(str(tmp_path / "w"))
    q.processAllAvailable()
    q.stop()
    got = {str(r.window_start): r.events for r in spark.table("windows").collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-01 00:10:00"] == 1


def test_hooks(spark):
    files_ = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"\xff"))], "path string, content binary")
    assert {r.path: (r.text, (r.error or "")[:12]) for r in extract(files_, "text").collect()} == {"a": ("ok", ""), "b": (None, "UnicodeDecod")}
    with pytest.raises(ValueError, match="hashing"):
        embedder("none")
    v = embed(spark.createDataFrame([("x y",), (None,)], "content string"), "hashing").collect()
    assert all(len(r.embedding) == 64 for r in v)


def test_store_and_knowledge_base(spark, tmp_path):
    topics = {"d1": "whales swim in the deep ocean with their young whales", "d2": "engines burn fuel and turn wheels of the train", "d3": "$E = mc^2$ relates mass and energy in physics of matter"}
    docs = spark.createDataFrame([(k, f"# Title of {k}\n\n{t}. {t}.\n\n# More\n\n{t}") for k, t in topics.items()], "doc_id string, content string")
    rows = index_documents(spark, docs, str(tmp_path / "s1"), least=0, shortest=10)
    assert {r.doc_id: r.chunk_count for r in rows.collect()} == {"d1": 2, "d2": 2, "d3": 2}
    meta = spark.createDataFrame([("d1", "Whales")], "doc_id string, title string")
    kb = KnowledgeBase(spark, str(tmp_path / "s1"), metadata=meta)
    for mode in ("hybrid", "semantic", "bm25"):
        top = kb.search_documents(["whales in the ocean", "train engines"], 1, mode=mode).collect()
        assert [(r.query_id, r.doc_id) for r in top] == [(0, "d1"), (1, "d2")], mode
    assert top[0].title == "Whales" and top[0].section in ("Title of d1", "More") and top[0].chunk_count == 2
    only = kb.search_documents(["whales in the ocean"], 5, equations=True).collect()
    assert {r.doc_id for r in only} == {"d3"}
    assert {r.doc_id for r in kb.search_within("whales", "d2").collect()} == {"d2"}
    assert kb.read("d1", 1, 5).count() == 1 and kb.document("d1").first().title == "Whales"
    ref = kb.chunks.filter("doc_id = 'd1'").first().chunk_id
    assert {r.doc_id for r in kb.similar_chunks(ref).collect()} == {"d2", "d3"}
    assert tuple(kb.status().first()) == (6, 33.3, 3)
    for bad in ({"mode": "x"}, {"ranked_by": "x"}):
        with pytest.raises(ValueError):
            kb.search_documents(["q"], **bad)
    more = docs.union(spark.createDataFrame([("d4", "# New\n\nsome new words that are there")], "doc_id string, content string"))
    again = index_documents(spark, more, str(tmp_path / "s2"), previous=str(tmp_path / "s1"), least=0, shortest=10)
    assert again.count() == 4


def test_lookups_wait_and_isolate_errors(spark):
    from folioscope.operators.hooks import look_up, register_lookup

    def service():
        from folioscope.operators.hooks import Retry

        asked = {}

        def ask(key):
            asked[key] = asked.get(key, 0) + 1
            if key == "slow" and asked[key] < 3:
                raise Retry("slow down")
            if key == "never":
                raise Retry("slow down")
            if key == "bad":
                raise KeyError("gone")
            return f'{{"title": "{key}"}}'

        return ask

    register_lookup("service", service)
    keys = spark.createDataFrame([(k,) for k in ("ok", "slow", "never", "bad", "ok")], "key string")
    got = {r.key: (r.response, r.error, r.attempts) for r in look_up(keys, "service", tries=3, base_seconds=0.01).collect()}
    assert got == {"ok": ('{"title": "ok"}', None, 1), "slow": ('{"title": "slow"}', None, 3), "never": (None, "slow down", 3), "bad": (None, "KeyError: 'gone'", 1)}


def test_lookups_hand_on_small_batches(spark, monkeypatch):
    """A batch of many or long keys is answered in parts, so that a worker's memory does not grow with it."""
    import pyarrow as pa

    from folioscope.operators import hooks

    keys, caught = spark.createDataFrame([("a",)], "key string"), []
    monkeypatch.setattr(type(keys), "mapInArrow", lambda self, f, schema: caught.append(f) or self)
    monkeypatch.setitem(hooks.LOOKUPS, "echo", lambda: lambda key: None if key == "none" else key * 2)
    hooks.look_up(keys, "echo")
    for n, width in ((3000, 3), (300, 50_000)):
        own = ["none", None, *[f"{i:0{width}d}" for i in range(n)]]
        parts = list(caught[0]([pa.RecordBatch.from_pydict({"key": pa.array(x, pa.string())}) for x in (own, [])]))
        assert max(p.num_rows for p in parts) <= hooks.HELD_ROWS and max(p.nbytes for p in parts) < 1.5 * hooks.HELD_CHARS
        rows = pa.Table.from_batches(parts).to_pylist()
        assert [r["key"] for r in rows] == own and [r["response"] for r in rows] == [None, None, *[k * 2 for k in own[2:]]]
        assert [r["error"] for r in rows if r["error"]] == ["TypeError: unsupported operand type(s) for *: 'NoneType' and 'int'"]


def test_batches_of_the_keyword_stream_are_of_many_files(spark, tmp_path, monkeypatch):
    """No task reads or writes a whole batch."""
    from folioscope.plans import more_queries

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(more_queries, "work_path", lambda spark, name: f"{tmp_path}/{name}")
    assert more_queries.stream_keyword_index(spark, str(tmp_path)).count() > 0
    assert len(list((tmp_path / "chunks" / "in").glob("*.parquet"))) == 6
    assert sorted(p.name for p in (tmp_path / "chunks" / "index").glob("v=*")) == ["v=000000000000", "v=000000000001"]
