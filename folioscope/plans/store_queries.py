"""Registered queries of the stores that change: segments, vector cells, keyed tables, states, density topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import pdf, responses
from folioscope.operators import density, topics, vector_index, vector_search
from folioscope.operators.fragments import FragmentIndex
from folioscope.operators.hooks import register_lookup
from folioscope.operators.segments import SegmentedIndex, followed
from folioscope.operators.tables import work_table
from folioscope.plans.enriching import Library, Step, enrich
from folioscope.plans.queries import _FOUND_SQL, _TOKENS_SQL, _asked, _chunks, _query, _rounded, _t, _vec_sql
from folioscope.schemas import CANONICAL_FILES
from folioscope.sources import listing
from folioscope.sources.places import work_path, written
from folioscope.streaming import states

EXTRA_IDS = 1_000_000_000


# ---- keyword index by segments

@_query(_FOUND_SQL + " SELECT query_id, chunk_id, rank, raw_score, round(score, 9) AS score FROM kw")
def segmented_topk(spark, sf_dir):
    """Three batches, of which one replaces texts of the one before, and a removal: the search is that of a full build."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    third = F.pmod(F.col("chunk_id"), F.lit(3))
    extra = docs.filter(third == 2).withColumn("chunk_id", F.col("chunk_id") + EXTRA_IDS)
    index = SegmentedIndex(spark, work_path(spark, "segments"), "long")
    index.add(docs.filter(third == 0).unionByName(docs.filter(third == 1).withColumn("content", F.concat(F.lit("first draft "), "content"))))
    index.add(docs.filter(third == 1).unionByName(extra))
    index.add(docs.filter(third == 2))
    index.remove(extra)
    return _rounded(index.search(_asked(spark).select("query_id", "query"), 200), "score")


@_query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS_SQL}) AS term FROM documents) GROUP BY term")
def stream_segments(spark, sf_dir):
    """Chunks arrive as a stream; each of two batches becomes a segment of its own."""
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    path = work_path(spark, "segment-stream")
    for part in (0, 1):
        rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == part).write.mode("append").parquet(f"{path}/in-{part}")
    for part in (0, 1):
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in-{part}")
        followed(stream, f"{path}/index", f"{path}/checkpoint-{part}", name=f"part {part}").awaitTermination()
    return SegmentedIndex(spark, f"{path}/index", "string").term_counts()


# ---- vector index

@_query(f"WITH {_vec_sql('cosine')} SELECT query_id, chunk_id, doc_id, rank, round(distance, 9) AS distance, round(similarity, 9) AS similarity FROM hits")
def vector_index_topk(spark, sf_dir):
    """The exact search by way of the index: cells are read until no other can hold a nearer vector."""
    chunks = _chunks(spark, sf_dir)
    index = vector_index.build(chunks, work_path(spark, "vectors"))
    asked = _asked(spark).join(chunks.select(F.col("chunk_id").alias("vec_id"), F.col("embedding").alias("vector")), "vec_id").select("query_id", "vector")
    found = index.search(asked, 200, probes=4, exact=True, digits=6)
    return _rounded(found, "distance", "similarity").select("query_id", "chunk_id", "doc_id", "rank", "distance", "similarity")


@_query()
def vector_index_recall(spark, sf_dir):
    """Every hundredth vector asks for its ten nearest: how many of the exact search's the codes find."""
    chunks = _chunks(spark, sf_dir)
    asked = chunks.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vector_index.build(chunks, work_path(spark, "vectors"))
    return vector_index.recall(index.search(asked, 10), vector_search.search(chunks, asked, 10))


# ---- keyed tables

_LATEST = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE {where} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"


def _order_table(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    table = work_table(spark, "orders", "o_custkey long, o_orderkey long, o_totalprice double", ["o_custkey"], 8)
    for part in range(3):
        table.upsert(orders.filter(F.pmod("o_orderkey", F.lit(3)) == part), "o_orderkey", app=("orders", part))
    table.delete(orders.filter("o_custkey % 10 = 0").select("o_custkey").distinct())
    return table


@_query(_LATEST.format(where="o_custkey % 10 <> 0"))
def table_upserts(spark, sf_dir):
    """Each customer's newest order, from three upserts and a removal in a table of hash buckets."""
    return _order_table(spark, sf_dir).read()


@_query(_LATEST.format(where="o_orderkey % 3 <> 2"))
def table_time_travel(spark, sf_dir):
    """The same table as it was before the last upsert and the removal."""
    return _order_table(spark, sf_dir).read(1)


# ---- states

#: What event types stand for.
_STATUS = {"signup": "pending", "view": "extracting", "click": "extracted", "purchase": "indexed", "error": "failed"}
_LEGAL = " OR ".join(f"(r.status = '{a}' AND e.status IN ({', '.join(repr(x) for x in to)}))" for a, to in states.MOVES.items())


@_query(f"""WITH RECURSIVE e AS (SELECT user_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 'new' AS status, 0::BIGINT AS i, 0::BIGINT AS moves, 0::BIGINT AS illegal FROM e
UNION ALL SELECT r.user_id, CASE WHEN {_LEGAL} THEN e.status ELSE r.status END, e.i, r.moves + CASE WHEN {_LEGAL} THEN 1 ELSE 0 END, r.illegal + CASE WHEN {_LEGAL} THEN 0 ELSE 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id AS doc_id, status, moves, illegal FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def stream_document_states(spark, sf_dir):
    """Users' events as requests of a document to move, in two batches; which of them were legal."""
    kinds = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), kinds[F.col("event_type")].alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    path = work_path(spark, "document-states")
    cut = rows.select(F.percentile_approx(F.unix_micros("at"), 0.5)).first()[0]
    early = F.unix_micros("at") <= (cut or 0)
    for part in (early, ~early):
        rows.filter(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        states.follow_states(stream, f"{path}/out", f"{path}/checkpoint", late="3650 days").awaitTermination()
    return states.state_summary(states.happened(spark, f"{path}/out", "long")).select("doc_id", "status", "moves", "illegal")


# ---- density topics

def _density(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return density.clusters(topics.reduced(vectors, 5), 10, 3)


@_query()
def density_topics(spark, sf_dir):
    """Each vector's density cluster, -1 for outliers."""
    return _density(spark, sf_dir)


@_query()
def density_topic_summary(spark, sf_dir):
    """Outliers and the ten largest topics with their five weightiest words."""
    assigned = written(_density(spark, sf_dir), "density-topics")
    texts = _t(spark, sf_dir, "documents").select("doc_id", "text").join(assigned, "doc_id")
    words = topics.topic_words(topics.class_tfidf(texts.filter("topic_id >= 0")), 5)
    best = topics.topic_summary(assigned.filter("topic_id >= 0"), words, 10)
    return assigned.filter("topic_id < 0").groupBy("topic_id").agg(F.count(F.lit(1)).alias("documents"), F.lit(None).cast("string").alias("label")).unionByName(best)


# ---- fragments of names

#: Patterns that are searched for.
_FRAGMENTS = ["%anthe%", "web/%der%die%", "%_uxle%ou%", "%no such name%", "%.", "%EAU%"]


@_query("SELECT p AS pattern, doc_id, name FROM (SELECT doc_id, source || '/' || split_part(text, chr(10), 1) AS name FROM documents), (VALUES " + ", ".join(f"('{p}')" for p in _FRAGMENTS) + ") AS v(p) WHERE name ILIKE p")
def fragment_search(spark, sf_dir):
    """Names by fragments, of which a trigram index leaves few to compare."""
    names = _t(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.substring_index("text", "\n", 1)).alias("name"))
    index = FragmentIndex.build(names, work_path(spark, "fragments"), id_col="doc_id", name_col="name")
    out = None
    for p in _FRAGMENTS:
        found = index.search(p).select(F.lit(p).alias("pattern"), F.col("id").alias("doc_id"), "name")
        out = found if out is None else out.unionByName(found)
    return out


# ---- metadata

def _registry():
    """Stands in for a service that knows two of three files by the hash of their content."""
    import json

    def ask(key: str) -> str | None:
        n = int(key, 16)
        return None if n % 3 == 0 else json.dumps({"message": {"title": [f"Study {n % 1000}"], "author": [{"given": "A", "family": f"Author{n % 7}"}], "published": {"date-parts": [[1980 + n % 40]]}}})

    return ask


def _reader():
    """Stands in for a service that reads a first page: its title and what it says, where there are five words."""
    import json

    return lambda front: json.dumps({"title": front[:40], "abstract": front}) if len(front.split(" ")) >= 5 else None


_WAVES = ((Step("doi_crossref", lambda: F.substring("content_sha256", 1, 8), responses.crossref),), (Step("semantic_scholar", lambda: F.col("front"), responses.scholar),))


@_query("""WITH f AS (SELECT DISTINCT sha256(text) AS content_sha256, split_part(text, chr(10), 1) AS front FROM documents WHERE text IS NOT NULL), n AS (SELECT *, ('0x' || substr(content_sha256, 1, 8))::BIGINT AS n, len(string_split(front, ' ')) >= 5 AND trim(front[1:40], ' ') <> '' AS has_text FROM f)
SELECT content_sha256, CASE WHEN has_text THEN trim(front[1:40], ' ') ELSE 'Study ' || n % 1000 END AS title, CASE WHEN n % 3 <> 0 THEN (1980 + n % 40)::INTEGER END AS year, CASE WHEN n % 3 <> 0 THEN 'A Author' || n % 7 END AS first_author, has_text AS has_abstract, 0 AS asked_again FROM n WHERE has_text OR n % 3 <> 0""")
def enriched_library(spark, sf_dir):
    """Files resolved from two sources, wave by wave; a second run has nothing left to ask."""
    register_lookup("doi_crossref", _registry)
    register_lookup("semantic_scholar", _reader)
    texts = _t(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("content_sha256"), F.substring_index("text", "\n", 1).alias("front")).distinct()
    library = Library(spark, work_path(spark, "library"), 8)
    name = F.concat(F.col("content_sha256"), F.lit(".pdf"))
    files = texts.select("content_sha256", F.concat(F.lit("/library/"), name).alias("canonical_path"), name.alias("display_name"), name.alias("original_filename"))
    empty = spark.createDataFrame([], CANONICAL_FILES)
    library.files.insert_new(empty.unionByName(files, allowMissingColumns=True))
    enrich(library, "2024-01-01", fronts=texts, waves=_WAVES)
    again, _ = enrich(library, "2024-01-02", fronts=texts, waves=_WAVES)
    out = library.resolved.read()
    return out.select("content_sha256", "title", "year", F.get("authors", 0).alias("first_author"), F.col("abstract").isNotNull().alias("has_abstract"), F.lit(again["asked"]).alias("asked_again"))


# ---- folders

@_query("SELECT coalesce(source, 'none') AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY ALL")
def listed_folders(spark, sf_dir):
    """Documents written as files of a folder per source, and what a listing of these folders says of their sizes."""
    docs = _t(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("folder"), F.coalesce("text", F.lit("")).alias("text"))
    path = work_path(spark, "listed")
    docs.write.partitionBy("folder").text(path)
    listing.register(spark)
    files = spark.read.format("file_listing").option("pattern", "*.txt").load(path)
    return files.select(F.regexp_extract("path", "/folder=([^/]+)/", 1).alias("folder"), "size").groupBy("folder").agg(F.sum("size").alias("bytes"))


# ---- PDF files

def _pdf_of(title: str, pages: int, year: int) -> bytes:
    """A small file with so many pages, in a tree of tens."""
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 3: f"<< /Title <FEFF{title.encode('utf-16-be').hex()}> /CreationDate (D:{year}0101) >>"}
    tens = [range(at, min(at + 10, pages)) for at in range(0, pages, 10)]
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(f'{4 + i} 0 R' for i in range(len(tens)))}] >>"
    for i, own in enumerate(tens):
        first = 4 + len(tens)
        objects[4 + i] = f"<< /Type /Pages /Kids [{' '.join(f'{first + p} 0 R' for p in own)}] >>"
        objects |= {first + p: "<< /Type /Page >>" for p in own}
    out, places = b"%PDF-1.4\n", {}
    for n in sorted(objects):
        places[n] = len(out)
        out += f"{n} 0 obj\n{objects[n]}\nendobj\n".encode()
    table = "".join(f"{places[n]:010d} 00000 n \n" for n in sorted(objects))
    return out + f"xref\n1 {len(objects)}\n{table}trailer\n<< /Root 1 0 R /Info 3 0 R >>\nstartxref\n{len(out)}\n%%EOF".encode()


@_query("SELECT doc_id, nullif(split_part(coalesce(text, ''), chr(10), 1)[1:60], '') AS title, len(string_split(coalesce(text, ''), chr(10)))::INTEGER AS page_count, (2000 + doc_id % 20)::INTEGER AS year FROM documents")
def pdf_facts(spark, sf_dir):
    """Each text as a PDF file, a page a line; what is read out of the files."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def files(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                key, lines = b.column("path")[i].as_py(), b.column("text")[i].as_py().split("\n")
                yield pa.RecordBatch.from_pydict({"path": [key], "content": pa.array([_pdf_of(lines[0][:60], len(lines), 2000 + int(key) % 20)], pa.binary())})

    made = docs.mapInArrow(files, "path string, content binary")
    return pdf.pdf_metadata(made).select(F.col("path").cast("long").alias("doc_id"), "title", "page_count", "year")
