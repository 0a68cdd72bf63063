"""A keyword index that grows by segments: a batch writes its own rows, a search reads the blocks it needs.

Layout. A segment is immutable: `docs` (a chunk's words with their counts, as the batch brings them), `postings` (one row
per word and stripe of STRIPE neighbouring chunks, sorted by word and stripe in runs; a stripe that two tasks read has a row
of each) and `terms` (in how many chunks a word is). Words are counted and lists made where the texts lie: no posting is
shuffled, and texts only where an id comes twice in a batch. A
removal writes `dead` rows (segment, chunk) and what they take from the word counts. A commit log says which segments
and removals count; word statistics are sums over them, so nothing old is rewritten. Where FAN segments of like size have
come together they are merged into one without their dead chunks (each row is written about log_FAN(chunks) times).

Search. A postings row carries its largest count and its shortest chunk, so its best possible score is known without
its lists. Summed over the words of a query that bounds every chunk of the stripe. The best stripes that hold n
chunks are scored first; the n-th score is a threshold, and only stripes whose bound reaches it are read besides. The
result is exactly that of scoring everything: `bm25.search` over the same chunks.

Defined results: chunks without words are kept (they fill up lists); a chunk id that is added again replaces the old
one; ids that are not there are removed without effect; an empty batch commits nothing; ids are unique in a batch
(the last by insertion order counts).
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import tokens, word_counts
from folioscope.operators import bm25
from folioscope.operators.ranking import top_k
from folioscope.sources.commits import CommitLog, Conflict, State
from folioscope.sources.places import remove, written

#: Chunks of a stripe (a power of two), segments of a size that are merged, chunks of the smallest size.
STRIPE, FAN, BASE = 1024, 4, 1000
#: Words and stripes that are named in a scan's filter; more are joined.
NAMED = 500
TRIES = 10
#: Postings whose lists a task makes at once: of whole stripes, unless one has MOST of them.
RUN, MOST = 500_000, 2_000_000
#: Rounded scores may be this much over the bound of what they are made of.
SLACK = 1e-6


def _part(tf: Column, dl: Column, mean_length: float) -> Column:
    """A word's share of a chunk's score over its weight: grows with tf, falls with dl."""
    return tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / F.lit(mean_length)))


def _lists(rows: pa.Table) -> pa.Table:
    """Rows of postings (term, stripe, chunk_id, seq, tf, dl), grouped by word and stripe and in their order."""
    rows = rows.sort_by([("term", "ascending"), ("stripe", "ascending")]).combine_chunks()
    term, stripe = (rows.column(c).combine_chunks() for c in ("term", "stripe"))
    code = term.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    at = stripe.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (at[1:] != at[:-1])]))
    ends = np.append(first, len(rows))
    own = {c: rows.column(c).combine_chunks() for c in ("chunk_id", "seq", "tf", "dl")}
    hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(own.values()), names=list(own)))
    tf, dl = (own[c].to_numpy(zero_copy_only=False) for c in ("tf", "dl"))
    columns = [term.take(pa.array(first)), stripe.take(pa.array(first)), *[pa.array(x, pa.int32()) for x in (np.diff(ends), np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first))], hits]
    return pa.Table.from_arrays(columns, names=["term", "stripe", "n", "max_tf", "min_dl", "hits"])


def _packed(batches):
    """The postings rows of rows (term, stripe, chunk_id, seq, tf, dl) that come stripe by stripe."""
    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= RUN:
            now = pa.Table.from_batches(held)
            at = now.column("stripe").to_numpy()
            # the last stripe may go on in the next batch
            cut = rows if rows >= MOST else int(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))[-1])
            if cut:
                yield from _lists(now.slice(0, cut)).to_batches(max_chunksize=5_000)
                held, rows = now.slice(cut).to_batches(), rows - cut
    if rows:
        yield from _lists(pa.Table.from_batches(held)).to_batches(max_chunksize=5_000)


class SegmentedIndex:
    """The index under a path. id_type and seq_type: Spark types of chunk ids and of the insertion order."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string", seq_type: str | None = None):
        self.spark, self.path, self.id_type, self.seq_type = spark, path, id_type, seq_type or id_type
        self.log = CommitLog(spark, f"{path}/_log")
        self.schemas = {
            "docs": f"chunk_id {id_type}, seq {self.seq_type}, dl int, stripe long, words array<struct<term:string,tf:int>>",
            "postings": f"term string, stripe long, n int, max_tf int, min_dl int, hits array<struct<chunk_id:{id_type},seq:{self.seq_type},tf:int,dl:int>>",
            "terms": "term string, df long",
            "dead": f"segment string, chunk_id {id_type}",
            "taken": "segment string, term string, df long",
        }

    # ---- reading

    def _table(self, kind: str, names: list[str]) -> DataFrame:
        """A table of several segments or removals, with the name of each row's folder as `segment`."""
        if not names:
            own = self.schemas[kind] if kind in ("dead", "taken") else f"{self.schemas[kind]}, segment string"
            return self.spark.createDataFrame([], own)
        whole = self.spark.read.schema(self.schemas[kind]).parquet(*[f"{self.path}/{n}/{kind}" for n in names])
        if kind in ("dead", "taken"):
            return whole
        return whole.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{kind}/[^/]+$", 1))

    @staticmethod
    def _names(state: State, kind: str) -> list[str]:
        return sorted(n for n, e in state.entries.items() if e["kind"] == kind)

    def _dead(self, state: State) -> DataFrame | None:
        names = self._names(state, "dead")
        return self._table("dead", names) if names else None

    def _live(self, rows: DataFrame, state: State) -> DataFrame:
        dead = self._dead(state)
        return rows if dead is None else rows.join(dead, ["segment", "chunk_id"], "left_anti")

    def docs(self, state: State | None = None) -> DataFrame:
        """segment, chunk_id, seq, dl, words of the chunks that count."""
        state = state or self.log.state()
        return self._live(self._table("docs", self._names(state, "segment")), state)

    def sizes(self, state: State | None = None) -> tuple[int, int]:
        """Chunks and words."""
        state = state or self.log.state()
        live, chunks, words = set(self._names(state, "segment")), 0, 0
        for entry in state.entries.values():
            sign, parts = (1, {None: (entry["chunks"], entry["words"])}) if entry["kind"] == "segment" else (-1, entry["of"])
            for segment, (c, w) in parts.items():
                if segment is None or segment in live:
                    chunks, words = chunks + sign * c, words + sign * w
        return chunks, words

    def term_counts(self, state: State | None = None, only: list[str] | None = None) -> DataFrame:
        """term, df over the chunks that count."""
        state = state or self.log.state()
        names = self._names(state, "segment")
        given, taken = self._table("terms", names).select("term", "df"), self._table("taken", self._names(state, "dead")).filter(F.col("segment").isin(names)).select("term", (-F.col("df")).alias("df"))
        both = given.unionByName(taken)
        if only is not None:
            both = both.filter(F.col("term").isin(only))
        return both.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    # ---- writing

    def _write_segment(self, chunks: DataFrame) -> tuple[str, dict]:
        """A new segment of (chunk_id, seq, dl, words) rows: its name and entry."""
        name = f"s-{uuid.uuid4().hex}"
        place = F.monotonically_increasing_id()
        dealt = chunks.select("chunk_id", "seq", "dl", F.floor(place / STRIPE).cast("long").alias("stripe"), "words")
        dealt.write.parquet(f"{self.path}/{name}/docs")
        docs = self.spark.read.schema(self.schemas["docs"]).parquet(f"{self.path}/{name}/docs")
        each = docs.select("chunk_id", "seq", "dl", "stripe", F.explode("words").alias("w")).select("w.term", "stripe", "chunk_id", "seq", "w.tf", "dl")
        each.mapInArrow(_packed, self.schemas["postings"]).write.parquet(f"{self.path}/{name}/postings")
        postings = self.spark.read.schema(self.schemas["postings"]).parquet(f"{self.path}/{name}/postings")
        postings.groupBy("term").agg(F.sum("n").alias("df")).sortWithinPartitions("term").write.parquet(f"{self.path}/{name}/terms")
        chunks_, words = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return name, {"kind": "segment", "chunks": chunks_, "words": words}

    def _write_dead(self, gone: DataFrame) -> tuple[str, dict] | None:
        """The removal of live (segment, chunk_id, dl) rows."""
        name = f"d-{uuid.uuid4().hex}"
        gone = written(gone.select("segment", "chunk_id", "dl"), "segment-gone")
        of = {r.segment: (r.n, r.w) for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("w")).collect()}
        if not of:
            return None
        gone.select("segment", "chunk_id").write.parquet(f"{self.path}/{name}/dead")
        # the words of those that go are looked up beside their ids, so that ids alone are matched above
        lost = self._table("docs", sorted(of)).join(gone.select("segment", "chunk_id"), ["segment", "chunk_id"], "left_semi")
        lost.select("segment", F.explode("words.term").alias("term")).groupBy("segment", "term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{self.path}/{name}/taken")
        return name, {"kind": "dead", "of": of}

    def _committed(self, change, app: tuple[str, int] | None = None) -> State:
        """Commit what change(state) gives as (add, remove); read and changed anew where another writer was faster."""
        for _ in range(TRIES):
            state = self.log.state()
            if app and state.done.get(app[0], -1) >= app[1]:
                return state
            add, remove = change(state)
            if not add and not remove:
                return state
            try:
                return self.log.commit(state, add, remove, app=app)
            except Conflict:
                continue
        raise Conflict(f"gave up after {TRIES} tries")

    def _counted(self, chunks: DataFrame, text_col: str, id_col: str, seq_col: str | None) -> DataFrame:
        own = chunks.select(F.col(id_col).cast(self.id_type).alias("chunk_id"), F.col(seq_col or id_col).cast(self.seq_type).alias("seq"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        twice = written(own.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_id"), "segment-twice")
        if twice.limit(1).count():
            # of an id that comes more than once the last row counts; the others' texts stay where they are
            same = own.join(twice, own["chunk_id"].eqNullSafe(twice["chunk_id"]), "left_semi").groupBy("chunk_id").agg(F.max(F.struct("seq", "text")).alias("b")).select("chunk_id", "b.*")
            own = own.join(twice, own["chunk_id"].eqNullSafe(twice["chunk_id"]), "left_anti").unionByName(same)
        counted = own.select("chunk_id", "seq", tokens(F.col("text")).alias("t"))
        return counted.select("chunk_id", "seq", F.size("t").alias("dl"), word_counts(F.col("t")).alias("words"))

    def add(self, chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "content", seq_col: str | None = None, app: tuple[str, int] | None = None, new: bool | None = None) -> int:
        """Chunks are added; those whose id is there already are replaced, or with new=True left as they are. The version."""
        rows = self._counted(chunks, text_col, id_col, seq_col)
        if new:
            rows, made = written(rows, "segment-batch"), None
        else:
            made = self._write_segment(rows)
            rows = self._table("docs", [made[0]])
            if not made[1]["chunks"]:
                remove(self.spark, f"{self.path}/{made[0]}")
                made = None

        def change(state):
            live = self.docs(state)
            if new:
                fresh = rows.join(live.select("chunk_id"), "chunk_id", "left_anti")
                if not fresh.limit(1).count():
                    return {}, []
                name, entry = self._write_segment(fresh)
                return {name: entry}, []
            if made is None:
                return {}, []
            dead = self._write_dead(live.select("segment", "chunk_id", "dl").join(rows.select("chunk_id"), "chunk_id", "left_semi"))
            return dict([made, *([dead] if dead else [])]), []

        version = self._committed(change, app).version
        self.merge()
        return version

    def remove(self, ids: DataFrame, id_col: str = "chunk_id", app: tuple[str, int] | None = None) -> int:
        """Take chunks out of the index; their rows stay until a merge."""
        ids = ids.select(F.col(id_col).cast(self.id_type).alias("chunk_id")).distinct()

        def change(state):
            dead = self._write_dead(self.docs(state).select("segment", "chunk_id", "dl").join(ids, "chunk_id", "left_semi"))
            return dict([dead]) if dead else {}, []

        return self._committed(change, app).version

    def merge(self, everything: bool = False) -> int:
        """Merge segments of like size as long as FAN of them are there (or all); how many merges were done."""
        done = 0
        while True:
            state, levels = self.log.state(), {}
            for n in self._names(state, "segment"):
                size = max(state.entries[n]["chunks"] / BASE, 1)
                levels.setdefault(0 if everything else int(math.log(size, FAN)), []).append(n)
            full = [sorted(names) for names in levels.values() if len(names) >= (2 if everything else FAN)]
            if not full and not (everything and self._names(state, "dead")):
                return done
            names = min(full, key=len) if full else self._names(state, "segment")

            def change(now, names=names):
                if not set(names) <= set(now.entries):
                    return {}, []
                rows = self._live(self._table("docs", names), now)
                name, entry = self._write_segment(rows)
                # removals that speak of merged segments only are not needed any more
                rest = set(self._names(now, "segment")) - set(names)
                spent = [n for n in self._names(now, "dead") if not set(now.entries[n]["of"]) & rest]
                return ({name: entry} if entry["chunks"] else {}), [*names, *spent]

            self._committed(change)
            done += 1
            if everything:
                return done

    # ---- search

    def _weights(self, state: State, queries: DataFrame) -> tuple[DataFrame, list[str], float]:
        """(query_id, term, weight) of the words asked for, these words, and the mean length. Queries are stated and few;
        their words come to the driver."""
        asked = bm25.query_terms(queries)
        kind = asked.schema["query_id"].dataType.simpleString()
        asked = asked.collect()
        words = sorted({r.term for r in asked})
        n, length = self.sizes(state)
        raw = {r.term: math.log(n - r.df + 0.5) - math.log(r.df + 0.5) for r in self.term_counts(state, words).collect()}
        floor = 0.0
        if any(x < 0 for x in raw.values()):
            # only then the mean over all words is needed
            mean = F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
            floor = bm25.EPSILON * (self.term_counts(state).select(mean).first()[0] or 0.0)
        rows = [(r.query_id, r.term, r.qtf * (raw[r.term] if raw[r.term] >= 0 else floor)) for r in asked if r.term in raw]
        return self.spark.createDataFrame(rows, f"query_id {kind}, term string, weight double"), words, length / n if n else 0.0

    def _bounds(self, state: State, weights: DataFrame, words: list[str], mean_length: float) -> DataFrame:
        """(query_id, segment, stripe, bound, n): the most that a chunk of the stripe can score, and its postings. Reads
        the postings' heads, not their lists."""
        heads = self._postings(state, words).select("segment", "term", "stripe", "n", "max_tf", "min_dl")
        best = F.greatest(F.lit(0.0), F.col("weight") * _part(F.col("max_tf"), F.col("min_dl"), mean_length))
        joined = heads.join(F.broadcast(weights), "term").withColumn("best", best)
        # `chunks` have the word that weighs most there, so about so many come near the bound
        return written(joined.groupBy("query_id", "segment", "stripe").agg(F.sum("best").alias("bound"), F.max_by("n", "best").alias("chunks"), F.sum("n").alias("n")), "segment-bounds")

    def _postings(self, state: State, words: list[str]) -> DataFrame:
        rows = self._table("postings", self._names(state, "segment"))
        if len(words) <= NAMED:
            return rows.filter(F.col("term").isin(words))
        return rows.join(F.broadcast(self.spark.createDataFrame([(w,) for w in words], "term string")), "term", "left_semi")

    def _scored(self, state: State, weights: DataFrame, words: list[str], mean_length: float, stripes: DataFrame, among: DataFrame | None, digits: int) -> DataFrame:
        """(query_id, chunk_id, seq, s) of the chunks of the given (query_id, segment, stripe) rows."""
        rows = self._postings(state, words)
        named = [r[0] for r in stripes.select("stripe").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            rows = rows.filter(F.col("stripe").isin(named))
        wanted = stripes.select("query_id", "segment", "stripe").join(F.broadcast(weights), "query_id")
        hits = rows.join(wanted, ["segment", "stripe", "term"]).select("query_id", "segment", "weight", F.explode("hits").alias("h")).select("query_id", "segment", "weight", "h.*")
        hits = self._live(hits, state)
        if among is not None:
            hits = hits.join(among.select(F.col("chunk_id").cast(self.id_type)), "chunk_id", "left_semi")
        score = F.sum(F.col("weight") * _part(F.col("tf"), F.col("dl"), mean_length))
        return hits.groupBy("query_id", "chunk_id", "seq").agg(F.round(score, digits).alias("s"))

    def found(self, queries: DataFrame, n: int, *, digits: int = 6, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Scored chunks among which the n best are, and (query_id, postings, read, stripes, stripes_read): what a
        full reading would have read, and what was."""
        state = self.log.state()
        weights, words, mean_length = self._weights(state, queries)
        bounds = self._bounds(state, weights, words, mean_length)
        # every stripe has a hit, so n stripes are enough to look at
        best = top_k(bounds, n, ("bound", True), ("segment", False), ("stripe", False))
        before = F.sum("chunks").over(Window.partitionBy("query_id").orderBy("rank")) - F.col("chunks")
        first = best.withColumn("before", before).filter(F.col("before") < n).select("query_id", "segment", "stripe")
        first = self.spark.createDataFrame(first.collect(), first.schema)
        score = lambda stripes: self._scored(state, weights, words, mean_length, stripes, among, digits)
        early = written(score(first), "segment-early")
        last = top_k(early, n, ("s", True), ("seq", False)).filter(F.col("rank") == n - 1).select("query_id", F.col("s").alias("least"))
        rest = bounds.join(first, ["query_id", "segment", "stripe"], "left_anti").join(F.broadcast(last), "query_id", "left")
        rest = written(rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "segment", "stripe"), "segment-rest")
        scored = early.unionByName(score(rest)) if rest.limit(1).count() else early
        taken = first.unionByName(rest).withColumn("taken", F.lit(1))
        is_taken = F.col("taken").isNotNull()
        reads = bounds.join(taken, ["query_id", "segment", "stripe"], "left").groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum(F.when(is_taken, F.col("n")).otherwise(0)).alias("read"), F.count(F.lit(1)).alias("stripes"), F.count_if(is_taken).alias("stripes_read"))
        return scored, reads

    def search(self, queries: DataFrame, n: int = 200, digits: int = 6, among: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, rank from 0, raw_score, score), as bm25.search gives them."""
        scored, _ = self.found(queries, n, digits=digits, among=among)
        pool = self.docs().select("chunk_id", "seq")
        if among is not None:
            pool = pool.join(among.select(F.col("chunk_id").cast(self.id_type)), "chunk_id", "left_semi")
        return bm25.with_fill(scored, pool, queries, n)


def followed(stream: DataFrame, index_path: str, checkpoint: str, *, name: str = "stream", **columns):
    """Follow a stream of chunks: each batch becomes a segment, once, whatever is repeated; takes what is there and ends."""

    def fold(batch: DataFrame, number: int) -> None:
        SegmentedIndex(batch.sparkSession, index_path).add(batch, app=(name, number), **columns)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
