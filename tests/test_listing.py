import os
import time

import pytest
from pyspark.sql import functions as F

from folioscope.sources import listing


@pytest.fixture
def folder(tmp_path):
    for name in ("a.pdf", "b.PDF", "note.txt", ".hidden.pdf", "sub/c.pdf", "sub/deep/d.pdf", "other/e.pdf", "_temporary/f.pdf"):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(name * 3)
    return tmp_path / "in"


def load(spark, path, **options):
    listing.register(spark)
    reader = spark.read.format("file_listing")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(path))


def names(df, folder):
    return sorted(os.path.relpath(r.path, folder) for r in df.filter("error IS NULL").collect())


def test_files_of_folders(spark, folder, monkeypatch):
    assert names(load(spark, folder), folder) == ["a.pdf", "b.PDF", "note.txt", "other/e.pdf", "sub/c.pdf", "sub/deep/d.pdf"]
    assert names(load(spark, folder, pattern="*.pdf"), folder) == ["a.pdf", "b.PDF", "other/e.pdf", "sub/c.pdf", "sub/deep/d.pdf"]
    assert names(load(spark, folder, recursive="false"), folder) == ["a.pdf", "b.PDF", "note.txt"]
    assert load(spark, folder).rdd.getNumPartitions() == 3
    row = load(spark, f"file://{folder}").filter(F.col("path").endswith("sub/c.pdf")).first()
    assert (row.size, row.root) == (27, f"file://{folder}") and abs(row.modified.timestamp() - time.time()) < 600


def test_links_are_followed_once(spark, folder):
    (folder / "sub" / "loop").symlink_to(folder / "sub")
    (folder / "link.pdf").symlink_to(folder / "a.pdf")
    got = names(load(spark, folder, pattern="*.pdf"), folder)
    assert [x for x in got if "loop" in x] == [] and set(got) == {"a.pdf", "b.PDF", "other/e.pdf", "sub/c.pdf", "sub/deep/d.pdf"}


def test_unreadable_roots_are_rows(spark, folder):
    rows = load(spark, "", roots=f"{folder}/other,{folder}/nothing,{folder}/a.pdf,strange://x/y").collect()
    assert len([r for r in rows if r.path]) == 1
    assert sorted(r.root for r in rows if r.error) == sorted([f"{folder}/nothing", f"{folder}/a.pdf", "strange://x/y"])
    with pytest.raises(Exception, match="needs a path"):
        load(spark, "", roots=" ").collect()


def test_filters_are_taken_over(spark, folder):
    for where, want in (("size > 20", ["note.txt", "other/e.pdf", "sub/c.pdf", "sub/deep/d.pdf"]), (f"path LIKE '{folder}/sub/%'", ["sub/c.pdf", "sub/deep/d.pdf"]), ("modified < '2001-01-01'", []), (f"root = '{folder}' AND size <= 15", ["a.pdf", "b.PDF"])):
        assert names(load(spark, folder).filter(where), folder) == want, where
    own = listing.Listing({"path": str(folder)})
    own.tests = [("path", listing.StringStartsWith, f"{folder}/sub/")]
    walked = [r[0] for p in own.deal() for r in own.rows(p)]
    assert sorted(os.path.relpath(x, folder) for x in walked) == ["sub/c.pdf", "sub/deep/d.pdf"]


def test_a_stream_goes_on_where_it_was(spark, folder, tmp_path):
    listing.register(spark)

    def run():
        stream = spark.readStream.format("file_listing").option("settle", "0").option("pattern", "*.pdf").load(str(folder))
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema("path string").parquet(str(tmp_path / "out")).collect()
        return sorted(os.path.relpath(r.path, folder) for r in rows)

    first = ["a.pdf", "b.PDF", "other/e.pdf", "sub/c.pdf", "sub/deep/d.pdf"]
    assert run() == first == run()
    (folder / "sub" / "new.pdf").write_text("new")
    assert run() == sorted([*first, "sub/new.pdf"])
