from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioscope.streaming import states

START = datetime(2024, 1, 1)


def send(spark, folder, rows):
    frame = spark.createDataFrame([(d, s, START + timedelta(minutes=m), i) for i, (d, s, m) in enumerate(rows)], "doc_id string, status string, at timestamp, seq long")
    frame.coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema("doc_id string, status string, at timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states.follow_states(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options).awaitTermination()
    return states.happened(spark, str(tmp_path / "out"))


def test_moves_illegal_ones_timers_and_a_restart(spark, tmp_path):
    folder = str(tmp_path / "in")
    send(spark, folder, [("a", "pending", 0), ("a", "extracting", 1), ("a", "extracted", 2), ("b", "indexed", 0), ("b", "pending", 3), ("b", "extracting", 4), ("c", "extracting", 5), ("c", "nonsense", 6), ("d", "pending", 0), (None, "pending", 0), ("x", None, 0)])
    run(spark, tmp_path)
    # the query is started again in the middle: states and timers are there; b and c hear nothing for an hour, d only waits
    send(spark, folder, [("a", "indexing", 30), ("a", "indexed", 31), ("a", "indexed", 32), ("c", "extracted", 40)])
    run(spark, tmp_path)
    send(spark, folder, [("e", "pending", 200)])
    events = run(spark, tmp_path)
    got = {r.doc_id: (r.status, r.moves, r.illegal, r.stuck) for r in states.state_summary(events).collect()}
    assert got == {"a": ("indexed", 5, 1, 0), "b": ("failed", 2, 1, 1), "c": ("extracted", 2, 1, 0), "d": ("pending", 1, 0, 0), "e": ("pending", 1, 0, 0)}
    stuck = events.filter("kind = 'stuck'").collect()
    assert [(r.doc_id, r.from_status, r.to_status, r.at) for r in stuck] == [("b", "extracting", "failed", START + timedelta(minutes=4))]
    illegal = {(r.doc_id, r.from_status, r.to_status) for r in events.filter("kind = 'illegal'").collect()}
    assert illegal == {("a", "indexed", "indexed"), ("b", "new", "indexed"), ("c", "extracting", "nonsense")}
    # a stuck document may try again
    send(spark, folder, [("b", "extracting", 210), ("b", "indexed", 211)])
    again = states.state_summary(run(spark, tmp_path)).filter("doc_id = 'b'").first()
    assert (again.status, again.moves, again.stuck) == ("indexed", 4, 1)


def test_rows_of_a_batch_go_by_time(spark, tmp_path):
    send(spark, str(tmp_path / "in"), [("a", "extracted", 3), ("a", "extracting", 2), ("a", "pending", 1), ("a", "indexed", 3)])
    events = run(spark, tmp_path, patience="1 day")
    assert [r.to_status for r in events.orderBy("at", "seq").collect()] == ["pending", "extracting", "extracted", "indexed"]
    assert events.filter(F.col("kind") != "move").count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
