import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.llm import warc
from folioscope.llm.warc import audit, audit_files, fixity_report, height, merkle_tree, parse_warc, read_warc, record_table, replica_table


def _pages(spark, n=500):
    return spark.createDataFrame([(i, f"http://x/{i}", ("é" if i % 5 == 0 else "a") * (50 + 97 * i % 3000), "clash") for i in range(n)], "page_id long, url string, html string, digest string").repartition(3)


def _root(rows):
    """The tree of one archive in plain Python: rows are (offset, sha256)."""
    level = {}
    for o, h in sorted(rows):
        level.setdefault(o // warc.RANGE_BYTES, []).append(f"{o}:{h}")
    level = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in level.items()}
    for _ in range(warc.LEVELS):
        up = {}
        for k in sorted(level):
            up.setdefault(k // warc.FAN_OUT, []).append(level[k])
        level = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in up.items()}
    return level[0]


def _found(index, replica):
    report, damaged = fixity_report(index, replica)
    listed = {}
    for r in damaged.orderBy("offset").collect():
        listed.setdefault(r.archive, []).append((r.state, r.record_id))
    return {r.archive: r for r in report.collect()}, listed


def test_damage_is_found_and_only_there(spark):
    pages = _pages(spark)
    archive = F.floor(F.col("page_id") / 200)
    index = record_table(pages, archive)
    bad = pages.filter("page_id NOT IN (77, 333)").withColumn("html", F.when(F.col("page_id").isin(5, 250), F.lit("zz")).otherwise(F.col("html")))
    rows, listed = _found(index, replica_table(bad, index, archive))
    assert listed == {"0": [("corrupt", 5), ("missing", 77)], "1": [("corrupt", 250), ("missing", 333)]}
    assert [(rows[a].intact, rows[a].n_damaged) for a in "012"] == [(False, 2), (False, 2), (True, 0)]
    held = {}
    for r in index.collect():
        held.setdefault(r.archive, []).append(r)
    for a, r in rows.items():
        assert r.root_a == _root([(x.offset, x.sha256) for x in held[a]])
        assert (r.n_records, r.n_bytes) == (len(held[a]), sum(x.length for x in held[a]))
        at = 0
        for x in sorted(held[a], key=lambda x: x.offset):
            assert x.offset == at
            at += x.length


def test_descends_only_where_nodes_differ(spark):
    pages = _pages(spark)
    index = record_table(pages, F.lit("w"))
    other = replica_table(pages.withColumn("html", F.when(F.col("page_id") == 123, F.lit("q")).otherwise(F.col("html"))), index, F.lit("w"))
    levels = height(index, other)
    nodes, damaged = audit(index, other, merkle_tree(index, levels), merkle_tree(other, levels), levels)
    assert sorted(r.level for r in nodes.collect()) == list(range(levels + 1))
    assert [(r.record_id, r.state) for r in damaged.collect()] == [(123, "corrupt")]


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "x"), (9, "v", "y" * 200_000)], "page_id long, url string, html string")
    index = record_table(odd, F.lit("w"))
    rows, listed = _found(index, index)
    assert rows["w"].intact and rows["w"].n_records == 5 and not listed
    assert fixity_report(index.limit(0), index.limit(0))[0].count() == 0
    rows, listed = _found(index, index.limit(0))
    assert not rows["w"].intact and rows["w"].root_b is None and [s for s, _ in listed["w"]] == ["missing"] * 5


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_repeats_extras_and_null_keys(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        make = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
        rows = [(1, "u", "a"), (2, "u", "b"), (2, "u", "b"), (2, "u", "c"), (3, "u", "d"), (None, "u", "x"), (None, None, "x")]
        index = record_table(make(rows), F.lit(None))
        whole, listed = _found(index, replica_table(make(rows[::-1]), index, F.lit(None)))
        assert whole[""].intact and not listed  # a repeated id, null ids, a null archive
        other = [*rows[:2], (2, "u", "changed"), rows[3], *rows[4:], (9, "u", "new"), (9, "u", "new"), (1, "u", "a")]
        whole, listed = _found(index, replica_table(make(other), index, F.lit(None)))
        assert not whole[""].intact and whole[""].n_damaged == 4
        assert sorted(listed[""]) == [("corrupt", 2), ("extra", 1), ("extra", 9), ("extra", 9)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_archives_have_one_root(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    monkeypatch.setattr(warc, "FAN_OUT", 2)
    pages = _pages(spark, 60)
    index = record_table(pages, F.lit("w"))
    assert height(index) > warc.LEVELS
    rows, _ = _found(index, replica_table(pages.filter("page_id <> 7"), index, F.lit("w")))
    assert len(rows) == 1 and rows["w"].n_records == 60 and rows["w"].n_damaged == 1


def test_running_sums_of_groups_of_any_size(spark):
    rows = [(g, i, i % 7 + 1) for g, n in (("a", 300), ("b", 3), (None, 2)) for i in range(n) if g]
    got = warc.running(spark.createDataFrame(rows, "g string, i long, x long").repartition(6), ["g"], ["i"], F.col("x"), "before")
    for r in got.collect():
        assert r.before == sum(i % 7 + 1 for i in range(r.i))


def _record(i, block):
    return f"WARC/1.0\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: http://x/{i}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_reads_warc_files(spark, tmp_path, packed):
    blocks = [b"one", b"", b"two\r\n\r\nthree", bytes(range(256))]
    raw = [_record(i, b) for i, b in enumerate(blocks)]
    raw = [gzip.compress(r) for r in raw] if packed else raw
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(b"".join(raw))
    rows = sorted(read_warc(spark, str(tmp_path)).collect(), key=lambda r: r.offset)
    assert [bytes(r.payload) for r in rows] == blocks
    assert [r.offset for r in rows] == [sum(map(len, raw[:i])) for i in range(4)]
    assert [r.sha256 for r in rows] == [hashlib.sha256(b).hexdigest() for b in blocks]
    assert list(parse_warc(b"")) == []


def test_damaged_files_give_errors_and_go_on(spark, tmp_path):
    good = [_record(i, b"block %d" % i * 20) for i in range(3)]
    errors = lambda data: [(h.get("warc-record-id"), e) for _, h, _, e in parse_warc(data)]
    fine = [(f"<urn:{i}>", None) for i in range(3)]
    assert errors(b"".join(good)) == fine
    assert errors(b"WARC/1.0\r\ncut") == [(None, "cut")]
    for size in (b"five", b"-50", b""):
        broken = good[1].replace(b"Content-Length: 140", b"Content-Length: " + size)
        assert errors(good[0] + broken + good[2]) == [fine[0], ("<urn:1>", "bad length"), fine[2]]
    assert errors(good[0] + b"junk\r\n\r\n" + good[2]) == [fine[0], (None, "no record"), fine[2]]
    assert errors(good[0] + good[1][:-30]) == [fine[0], ("<urn:1>", "cut")]
    packed = [gzip.compress(x) for x in good]
    assert errors(b"".join(packed)) == fine and errors(gzip.compress(b"".join(good))) == fine
    flipped = bytearray(packed[1])
    flipped[len(flipped) // 2] ^= 0xFF
    got = errors(packed[0] + bytes(flipped) + packed[2])
    assert got[0] == fine[0] and got[-1] == fine[2] and any(e == "bad gzip" for _, e in got)
    assert errors(packed[0] + packed[1][:-12])[-1][1] == "cut"
    (tmp_path / "x.warc.gz").write_bytes(packed[0] + bytes(flipped) + packed[2])
    assert read_warc(spark, str(tmp_path)).filter("error IS NULL").count() == 2
    big = b"".join(gzip.compress(_record(i, b"x" * 1000)) for i in range(20_000))
    assert sum(1 for _ in parse_warc(big)) == 20_000


def _write(folder, name, records, packed):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(b"".join(gzip.compress(r) if packed else r for r in records))


@pytest.mark.parametrize("packed", [False, True])
def test_files_are_audited_from_end_to_end(spark, tmp_path, packed):
    name = "x.warc.gz" if packed else "x.warc"
    good = [_record(f"uuid:{i:04d}", b"block %d " % i * (i % 40)) for i in range(2000)]
    _write(tmp_path / "a", name, good, packed)
    _write(tmp_path / "a" / "sub", name, good[:50], packed)
    _write(tmp_path / "b" / "sub", name, good[:50][::-1], packed)
    if not packed:
        # one lost record of two thousand is one damaged record
        _write(tmp_path / "b", name, good[:700] + good[701:], packed)
        report, damaged = audit_files(spark, str(tmp_path / "a"), str(tmp_path / "b"))
        assert [tuple(r)[:3] for r in damaged.collect()] == [(name, "<urn:uuid:0700>", "missing")]
        rows = {r.archive: r for r in report.collect()}
        assert not rows[name].intact and rows[name].n_records == 2000 and rows[name].n_damaged == 1
        # in another order is intact
        assert rows[f"sub/{name}"].intact
        return
    # changed, cut, repeated and new records
    changed = [*good[:10], good[10].replace(b"block", b"BLOCK"), *good[11:20], good[15], _record("uuid:new", b"new"), *good[20:]]
    _write(tmp_path / "c", name, [*changed[:-1], changed[-1]], packed)
    last = (tmp_path / "c" / name).read_bytes()
    (tmp_path / "c" / name).write_bytes(last[:-30])
    _, damaged = audit_files(spark, str(tmp_path / "a"), str(tmp_path / "c"))
    got = {(r.record_id, r.state): r for r in damaged.filter("archive = '%s'" % name).collect()}
    ends = {("<urn:uuid:1999>", "corrupt")} if ("<urn:uuid:1999>", "corrupt") in got else {("<urn:uuid:1999>", "missing"), ("", "extra")}
    assert set(got) == {("<urn:uuid:0010>", "corrupt"), ("<urn:uuid:0015>", "extra"), ("<urn:uuid:new>", "extra")} | ends
    assert got["<urn:uuid:0010>", "corrupt"].offset == sum(len(gzip.compress(r) if packed else r) for r in good[:10])
    assert any(r.error for r in got.values())
