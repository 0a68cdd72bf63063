"""A keyed table with transactions: hash buckets, copy on write, a commit log, versions.

A row's bucket is a hash of its key. A change reads and writes the buckets that its rows fall into, and no others;
what it wrote becomes visible by one commit. A writer whose commit comes second looks at what the other changed: if that
were other buckets, its own files hold and are committed again; if it shares one, only the shared buckets
are merged anew. Files that a version names are never changed, so old versions can be read until `vacuum`.

Defined results: an empty batch commits nothing; keys that come twice in a batch are what the merge makes of them;
null keys are a key of their own; a batch number of a stream that was committed is not applied again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.dml import insert_new
from folioscope.sources.commits import CommitLog, Conflict, State
from folioscope.sources.places import remove, work_path, written

#: Tries of a commit before it gives up.
TRIES = 20
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def latest_of(key: list[str], order: str) -> Merge:
    """Of rows with the same key the last by `order`; of equals the batch's. Pre-aggregated, so a hot key does no harm."""

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        rest = [c for c in old.columns if c not in key]
        best = F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_new"), *[c for c in rest if c != order]))
        return both.groupBy(*key).agg(best.alias("b")).select(*key, "b.*").select(*old.columns)

    return merge


class Table:
    """Rows of a schema under a path, one row per key if the merges say so."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.log = CommitLog(spark, f"{path}/_log")
        self.columns = spark.createDataFrame([], schema).columns
        state = self.log.state()
        # the number of buckets is the table's, not the caller's
        self.buckets = state.facts.get("buckets", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _files(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])

    def version(self) -> int:
        return self.log.state().version

    def read(self, version: int | None = None) -> DataFrame:
        return self._files(sorted(self.log.state(version).entries))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys, from their buckets only."""
        wanted = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        names = [n for n, e in sorted(self.log.state().entries.items()) if e["bucket"] in wanted]
        return self._files(names).join(keys.select(*self.key), self.key, "left_semi")

    def changes(self, version: int, until: int | None = None) -> DataFrame:
        """Rows of a later version that an earlier one has not (`change` 'new') and the reverse ('gone'): of the
        buckets only that were written between."""
        old, new = self.log.state(version), self.log.state(until)
        only = lambda a, b: self._files(sorted(set(a.entries) - set(b.entries)))
        before, after = only(old, new), only(new, old)
        return after.exceptAll(before).withColumn("change", F.lit("new")).unionByName(before.exceptAll(after).withColumn("change", F.lit("gone")))

    def _write(self, state: State, rows: DataFrame, touched: set[int], merge: Merge) -> tuple[dict, list[str]]:
        """Files of the touched buckets after the merge, and the names of those they stand for."""
        gone = [n for n, e in state.entries.items() if e["bucket"] in touched]
        mine = rows.filter(self._bucket().isin(sorted(touched)))
        merged = merge(self._files(sorted(gone)), mine).select(*self.columns)
        name = f"w-{uuid.uuid4().hex}"
        merged.withColumn("_b", self._bucket()).repartition(len(touched), "_b").write.partitionBy("_b").parquet(f"{self.path}/{name}")
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        names = [s.getPath().getName() for s in self.log.fs.listStatus(made)]
        return {f"{name}/{n}": {"bucket": int(n.split("=")[1])} for n in names if n.startswith("_b=")}, gone

    def merge(self, rows: DataFrame, merge: Merge, *, app: tuple[str, int] | None = None, before_commit: Callable[[int], None] = lambda _: None) -> int:
        """Apply merge(old rows, batch) bucket by bucket in one transaction; the version. before_commit is called with
        the number of each try (for tests and for logging)."""
        rows = written(rows.select(*self.columns), "table-batch")
        touched = {r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()}
        need, state, add, gone = set(touched), self.log.state(), {}, []
        if not need:
            return state.version
        for number in range(TRIES):
            if app and state.done.get(app[0], -1) >= app[1]:
                return state.version
            if need:
                more, stand_for = self._write(state, rows, need, merge)
                add |= more
                gone += stand_for
                need = set()
            before_commit(number)
            try:
                return self.log.commit(state, add, gone, app=app, facts={"buckets": self.buckets}).version
            except Conflict:
                time.sleep(0.01 * number)
                now = self.log.state()
                # of the batch's buckets those that another writer changed are merged again
                changed = set(state.entries) ^ set(now.entries)
                need = touched & {(state.entries | now.entries)[n]["bucket"] for n in changed}
                add = {n: e for n, e in add.items() if e["bucket"] not in need}
                gone = [n for n in gone if n in now.entries and now.entries[n]["bucket"] not in need]
                state = now
        raise Conflict(f"gave up after {TRIES} tries")

    def insert_new(self, rows: DataFrame, **options) -> int:
        """Rows whose key is not there yet."""
        return self.merge(rows, lambda old, new: insert_new(old, new, self.key), **options)

    def upsert(self, rows: DataFrame, order: str, **options) -> int:
        return self.merge(rows, latest_of(self.key, order), **options)

    def delete(self, keys: DataFrame, **options) -> int:
        """Remove the rows of the given keys (other columns may be missing)."""
        whole = keys.select(*[F.col(c) if c in keys.columns else F.lit(None).alias(c) for c in self.columns])
        typed = whole.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self.schema).schema])
        return self.merge(typed, lambda old, gone: old.join(gone.select(*self.key), self.key, "left_anti"), **options)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove the files that none of the newest `keep` versions names; their names."""
        newest = self.log.state()
        kept = set().union(*(self.log.state(v).entries for v in range(max(newest.version - keep + 1, 0), newest.version + 1)))
        gone = []
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        for s in self.log.fs.listStatus(root):
            write = s.getPath().getName()
            if write.startswith("w-"):
                for part in self.log.fs.listStatus(s.getPath()):
                    name = f"{write}/{part.getPath().getName()}"
                    if part.getPath().getName().startswith("_b=") and name not in kept:
                        remove(self.spark, f"{self.path}/{name}")
                        gone.append(name)
        return sorted(gone)


def work_table(spark: SparkSession, name: str, schema: str, key: list[str], buckets: int = 16) -> Table:
    return Table(spark, work_path(spark, name), schema, key, buckets)
