import pytest

from folioscope.operators import tables
from folioscope.operators.tables import Table, work_table
from folioscope.sources import commits
from folioscope.sources.commits import CommitLog, Conflict

SCHEMA = "key long, value string, at int"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(df):
    return sorted((r.key, r.value, r.at) for r in df.collect())


def bucket_of(spark, table, key):
    return frame(spark, (key, "", 0)).select(table._bucket()).first()[0]


def test_changes_and_versions(spark):
    t = work_table(spark, "t", SCHEMA, ["key"], 4)
    assert t.version() == -1 and t.read().count() == 0
    t.insert_new(frame(spark, (1, "a", 1), (2, "b", 1), (3, "c", 1)))
    t.insert_new(frame(spark, (3, "other", 2), (4, "d", 2)))
    t.upsert(frame(spark, (1, "a2", 3), (2, "old", 0), (5, "e", 1), (5, "e2", 2)), "at")
    assert t.delete(frame(spark, (4, None, None)).select("key")) == 3
    assert t.merge(frame(spark), lambda a, b: a) == 3
    want = [(1, "a2", 3), (2, "b", 1), (3, "c", 1), (5, "e2", 2)]
    assert content(t.read()) == want == content(Table(spark, t.path, SCHEMA, ["key"], 99).read())
    assert content(t.read(0)) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)]
    assert content(t.lookup(frame(spark, (5, "", 0), (9, "", 0)))) == [(5, "e2", 2)]
    assert sorted((r.key, r.change) for r in t.changes(1, 2).collect()) == [(1, "gone"), (1, "new"), (5, "new")]
    with pytest.raises(ValueError):
        t.read(9)
    gone = t.vacuum(keep=2)
    assert gone and content(t.read()) == want and content(t.read(2)) == [(1, "a2", 3), (2, "b", 1), (3, "c", 1), (4, "d", 2), (5, "e2", 2)]


def test_a_batch_writes_its_buckets_only(spark):
    t = work_table(spark, "t", SCHEMA, ["key"], 8)
    t.insert_new(spark.range(200).selectExpr("id AS key", "'x' AS value", "0 AS at"))
    before = t.log.state().entries
    t.upsert(frame(spark, (7, "new", 1)), "at")
    after = t.log.state().entries
    changed = {(before | after)[n]["bucket"] for n in set(before) ^ set(after)}
    assert changed == {bucket_of(spark, t, 7)} and len(after) == 8
    assert t.read().count() == 200 and t.read().filter("value = 'new'").count() == 1


@pytest.mark.parametrize("same_bucket", [True, False])
def test_two_writers_one_tries_again(spark, monkeypatch, same_bucket):
    t = work_table(spark, "t", SCHEMA, ["key"], 8)
    t.insert_new(spark.range(50).selectExpr("id AS key", "'x' AS value", "0 AS at"))
    mine = bucket_of(spark, t, 1)
    other = next(k for k in range(2, 50) if (bucket_of(spark, t, k) == mine) == same_bucket)
    second, tries, writes = Table(spark, t.path, SCHEMA, ["key"]), [], []
    write = Table._write
    monkeypatch.setattr(Table, "_write", lambda self, state, rows, touched, merge: writes.append(sorted(touched)) or write(self, state, rows, touched, merge))

    def meanwhile(number):
        tries.append(number)
        if number == 0:
            second.upsert(frame(spark, (other, "second", 5)), "at")

    assert t.upsert(frame(spark, (1, "first", 5)), "at", before_commit=meanwhile) == 2
    assert tries == [0, 1]
    # the loser merges again only what the winner changed
    assert writes == [[mine], [bucket_of(spark, t, other)], *([[mine]] if same_bucket else [])]
    got = {r.key: r.value for r in t.read().collect()}
    assert len(got) == 50 and got[1] == "first" and got[other] == "second"
    monkeypatch.setattr(tables, "TRIES", 0)
    with pytest.raises(Conflict):
        t.upsert(frame(spark, (1, "third", 9)), "at")


def test_a_stream_batch_is_applied_once(spark):
    t = work_table(spark, "t", "key long, n int", ["key"], 2)
    add = lambda old, new: old.unionByName(new).groupBy("key").sum("n").toDF("key", "n").selectExpr("key", "CAST(n AS int) AS n")
    rows = spark.createDataFrame([(1, 1)], "key long, n int")
    for number in (0, 1, 1, 0, 2):
        t.merge(rows, add, app=("stream", number))
    assert [tuple(r) for r in t.read().collect()] == [(1, 3)]


def test_log_conflicts_and_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 3)
    log = CommitLog(spark, f"file://{tmp_path}/log")
    state = log.state()
    for i in range(7):
        state = log.commit(state, {f"f{i}": {"n": i}}, [f"f{i - 2}"] if i > 1 else [])
    assert sorted(log.state().entries) == ["f5", "f6"] == sorted(CommitLog(spark, log.path).state().entries)
    assert sorted(log.state(3).entries) == ["f2", "f3"] and len(log.since(4)) == 2
    assert len(list((tmp_path / "log").glob("*.state"))) == 2
    with pytest.raises(Conflict):
        log.commit(log.state(5), {"late": {}}, [])
    assert "late" not in log.state().entries and not [p for p in (tmp_path / "log").glob(".*") if not p.name.endswith(".crc")]
