"""More registered queries: fields, responses and table changes, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import names, responses, text
from folioscope.operators import bm25, catalog, dml, experiments, ranking
from folioscope.plans.queries import _BM25_SQL, _KEYWORD_SQL, _TOKENS_SQL, _FUSED_PART, _asked, _chunks, _hits, _index, _query, _t, _vec_sql
from folioscope.sources.places import work_path
from folioscope.streaming import incremental


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents")


# ---- filtered search

_ALLOWED = "SELECT vec_id FROM embeddings WHERE label <> 3"
_FILTERED_SQL = _BM25_SQL + _KEYWORD_SQL.replace("{where}", f"l.chunk_id IN ({_ALLOWED})")


def _allowed(spark, sf_dir):
    return _chunks(spark, sf_dir).filter("doc_id <> 3")


@_query(_FILTERED_SQL + " SELECT query_id, chunk_id, rank, raw_score, round(score, 9) AS score FROM kw")
def bm25_filtered(spark, sf_dir):
    """Keyword search among the chunks that a filter leaves: the n best of these, not what is left of the n best."""
    found = bm25.search(_index(spark, sf_dir), _asked(spark).select("query_id", "query"), 200, among=_allowed(spark, sf_dir))
    return found.withColumn("score", F.round("score", 9))


@_query(_FILTERED_SQL + f", {_vec_sql('cosine', 'label <> 3')}" + _FUSED_PART + " SELECT query_id, chunk_id, doc_id, rank_semantic, rank_bm25, round(rrf_score, 9) AS rrf_score FROM fused")
def hybrid_filtered(spark, sf_dir):
    """Both legs are filtered before they are ranked and fused."""
    keyword = bm25.search(_index(spark, sf_dir), _asked(spark).select("query_id", "query"), 200, among=_allowed(spark, sf_dir))
    fused = ranking.fuse(_hits(spark, sf_dir, where=F.col("doc_id") != 3), keyword)
    return fused.select("query_id", "chunk_id", "doc_id", "rank_semantic", "rank_bm25", F.round("rrf_score", 9).alias("rrf_score"))


@_query(_FILTERED_SQL.replace("rank < 200", "rank < 5") + " SELECT DISTINCT query_id, chunk_id FROM kw WHERE raw_score > 0")
def keyword_hits_with_a_word(spark, sf_dir):
    found = bm25.search(_index(spark, sf_dir), _asked(spark).select("query_id", "query"), 5, among=_allowed(spark, sf_dir))
    return found.filter("raw_score > 0").select("query_id", "chunk_id")


# ---- names and fields

@_query("SELECT conv_id, substr(md5(string_agg(role || text, '' ORDER BY turn)), 1, 16) AS batch_id FROM conversations GROUP BY conv_id")
def batch_ids(spark, sf_dir):
    own = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", "text").alias("p"))))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(own.alias("own")).select("conv_id", names.batch_id(F.transform("own", lambda x: x["p"])).alias("batch_id"))


@_query("WITH v AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  ' || upper(sha256(text)) || ' ' ELSE substr(text, 1, 64) END AS v FROM documents) SELECT doc_id, CASE WHEN regexp_matches(lower(trim(v)), '^[0-9a-f]{64}$') THEN lower(trim(v)) END AS sha FROM v")
def checked_hashes(spark, sf_dir):
    value = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), F.upper(F.sha2("text", 256)), F.lit(" "))).otherwise(F.substring("text", 1, 64))
    return _docs(spark, sf_dir).select("doc_id", names.valid_sha256(value).alias("sha"))


_PATH_SQL = "CASE doc_id % 4 WHEN 0 THEN '/home/u/Zotero/storage/' || source || doc_id || '/a.pdf' WHEN 1 THEN '/home/u/Dropbox/' || source || '/b.pdf' WHEN 2 THEN '/x/storage' ELSE '/data/' || lang || '/c.pdf' END"


def _paths(spark, sf_dir):
    i, s = F.col("doc_id"), F.col("source")
    path = F.when(i % 4 == 0, F.concat(F.lit("/home/u/Zotero/storage/"), s, i.cast("string"), F.lit("/a.pdf"))).when(i % 4 == 1, F.concat(F.lit("/home/u/Dropbox/"), s, F.lit("/b.pdf"))).when(i % 4 == 2, F.lit("/x/storage")).otherwise(F.concat(F.lit("/data/"), F.col("lang"), F.lit("/c.pdf")))
    return _docs(spark, sf_dir).select("doc_id", path.alias("path"))


@_query(f"WITH p AS (SELECT doc_id, {_PATH_SQL} AS path FROM documents), s AS (SELECT *, string_split(path, '/') AS parts FROM p) SELECT doc_id, CASE WHEN contains(path, 'Zotero/storage') THEN 'zotero' WHEN contains(path, 'Dropbox') THEN 'dropbox' ELSE 'local' END AS kind, CASE WHEN list_position(parts, 'storage') > 0 THEN parts[list_position(parts, 'storage') + 1] END AS storage_id, '/kb/extractions/' || doc_id AS at FROM s")
def path_fields(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("doc_id", names.source_type(p).alias("kind"), names.storage_id(p).alias("storage_id"), names.extraction_path(F.lit("/kb"), F.col("doc_id").cast("string")).alias("at"))


@_query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), a AS (SELECT doc_id, coalesce(w[1], '') || ' ' || coalesce(w[2], '') || CASE doc_id % 3 WHEN 0 THEN '; ' WHEN 1 THEN ' and ' ELSE ', ' END || 'Other, Someone' AS author FROM w),
f AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(author, '\s+', ' ', 'g')), '(?is)(\band\b|;|,).*$', '')) AS f FROM a) SELECT doc_id, nullif(string_split(f, ' ')[-1], '') AS last_name FROM f""")
def last_names(spark, sf_dir):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    sign = F.when(F.col("doc_id") % 3 == 0, "; ").when(F.col("doc_id") % 3 == 1, " and ").otherwise(", ")
    author = F.concat(F.coalesce(F.get(w, 0), F.lit("")), F.lit(" "), F.coalesce(F.get(w, 1), F.lit("")), sign, F.lit("Other, Someone"))
    return _docs(spark, sf_dir).select("doc_id", names.last_name(author).alias("last_name"))


@_query("SELECT doc_id, b AS size, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS shown FROM (SELECT doc_id, n_chars * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 70001 ELSE 9000001 END)::BIGINT AS b FROM documents)")
def shown_sizes(spark, sf_dir):
    by = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 100).when(F.col("doc_id") % 4 == 2, 70001).otherwise(9000001)
    return _docs(spark, sf_dir).select("doc_id", (F.col("n_chars") * by).cast("long").alias("size")).withColumn("shown", names.human_bytes(F.col("size")))


@_query("SELECT event_id, strftime(make_timestamp(event_id::BIGINT * 86399 * 1000000), '%Y-%m-%d %H:%M:%S') AS at, strftime(make_timestamp(event_id::BIGINT * 86399 * 1000000) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS there FROM events")
def shown_times(spark, sf_dir):
    seconds = F.col("event_id").cast("long") % 1_000_000_000_000 * 86399
    utc = F.timestamp_seconds(seconds)
    return _t(spark, sf_dir, "events").select("event_id", names.epoch_text(seconds).alias("at"), names.local_minute(utc, "+02:00").alias("there"))


@_query(r"""WITH w AS (SELECT doc_id, lang, source, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1:(doc_id % 6)] AS a FROM documents)
SELECT doc_id, array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ' et al.' ELSE '' END AS authors, coalesce(a[1], 'unknown') || ', ' || CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE '"' || source || '"' END AS line1, coalesce(nullif((doc_id % 3)::VARCHAR, '0'), 'unknown') || ', ' || lang || ', unknown, ' || coalesce(nullif((doc_id % 4)::VARCHAR, '0'), 'unknown') AS line2 FROM w""")
def author_lines(spark, sf_dir):
    i = F.col("doc_id")
    a = F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), F.lit(1), (i % 6).cast("int"))
    title = F.when(i % 5 == 0, "").otherwise(F.col("source"))
    none = F.lit(None).cast("string")
    rows = _docs(spark, sf_dir).select("doc_id", names.author_list(a).alias("authors"), names.metadata_lines(a, title, i % 3, F.col("lang"), none, i % 4).alias("l"))
    return rows.select("doc_id", "authors", "l.*")


@_query(r"WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'D:' || (1990 + doc_id % 30) || '0102' WHEN 1 THEN substr(text, 1, 20) END AS c, (2000 + doc_id % 9)::VARCHAR AS m FROM documents) SELECT doc_id, coalesce(nullif(regexp_extract(c, '^(?:D:)?(\d{4})', 1), ''), nullif(regexp_extract(m, '^(?:D:)?(\d{4})', 1), ''))::INTEGER AS year FROM c")
def pdf_years(spark, sf_dir):
    i = F.col("doc_id")
    created = F.when(i % 3 == 0, F.concat(F.lit("D:"), (i % 30 + 1990).cast("string"), F.lit("0102"))).when(i % 3 == 1, F.substring("text", 1, 20))
    return _docs(spark, sf_dir).select("doc_id", names.pdf_date_year(created, (i % 9 + 2000).cast("string")).alias("year"))


_ERRORS = ["Failed to load page 3", "list index out of range", "Image not found: x", "too many repetitions", "degrees of freedom <= 0", "other", ""]


@_query("SELECT doc_id, ['Corrupted page', 'Dataloader error', 'Missing images', 'Repetitive content', 'Statistical error', 'Unknown error', 'No error output'][doc_id % 7 + 1] || ' (pages ' || (doc_id % 9) || '-' || (doc_id % 9 + 6) || ')' AS label FROM documents")
def error_labels(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, _ERRORS)), (F.col("doc_id") % 7).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", text.error_label(said, F.col("doc_id") % 9, F.col("doc_id") % 9 + 6).alias("label"))


@_query(r"SELECT doc_id, md5(nullif(regexp_extract(t, '(?s)(\{.*\})', 1), '')) AS slice FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'x {' || text || '} y' END AS t FROM documents)")
def json_slices(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("x {"), F.col("text"), F.lit("} y")))
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.json_slice(t)).alias("slice"))


@_query("SELECT doc_id, md5('_page_' || (doc_id % 30 + doc_id % 5) || '_a.png ' || text || ' _page_' || (doc_id % 7 + doc_id % 5) || '_b') AS moved FROM documents")
def shifted_images(spark, sf_dir):
    i = F.col("doc_id")
    t = F.concat(F.lit("_page_"), (i % 30).cast("string"), F.lit("_a.png "), F.col("text"), F.lit(" _page_"), (i % 7).cast("string"), F.lit("_b"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.shifted_page_images(t, i % 5)).alias("moved"))


# ---- responses

@_query("SELECT doc_id, '[\"' || source || '\",\"' || lang || '\"]' AS written, lang AS second FROM documents")
def authors_round_trip(spark, sf_dir):
    written = responses.authors_to_json(F.array("source", "lang"))
    return _docs(spark, sf_dir).select("doc_id", written.alias("written"), F.get(responses.authors_from_json(written), 1).alias("second"))


@_query("SELECT doc_id, source AS title, lang || ',' || source AS authors, (1990 + doc_id % 30)::INTEGER AS year, CASE WHEN doc_id % 2 = 0 THEN 'V' || source END AS journal FROM documents")
def scholar_projection(spark, sf_dir):
    i = F.col("doc_id")
    named = lambda c: F.struct(c.alias("name"))
    answer = F.to_json(F.struct(F.col("source").alias("title"), F.array(named(F.col("lang")), named(F.lit("")), named(F.col("source"))).alias("authors"), (i % 30 + 1990).alias("year"), F.when(i % 2 == 0, F.concat(F.lit("V"), F.col("source"))).otherwise("").alias("venue")))
    return _docs(spark, sf_dir).select("doc_id", responses.scholar(answer).alias("s")).select("doc_id", "s.title", F.array_join("s.authors", ",").alias("authors"), "s.year", "s.journal")


@_query("SELECT doc_id, 'T ' || source AS title, CASE WHEN doc_id % 2 = 0 THEN 'Ann ' ELSE '' END || source || ',Bo ' || lang AS authors, (1990 + doc_id % 30)::INTEGER AS year, 'J' || lang AS journal, 'One ' || source || '. Two.' AS abstract FROM documents")
def grobid_projection(spark, sf_dir):
    """Authors with and without a forename, one without a surname."""
    i, s, g = F.col("doc_id"), F.col("source"), F.col("lang")
    person = lambda fore, sur: F.concat(F.lit("<author><persName>"), fore, F.lit("<surname>"), sur, F.lit("</surname></persName></author>"))
    xml = F.concat(
        F.lit("<TEI xmlns='http://www.tei-c.org/ns/1.0'><teiHeader><fileDesc><titleStmt><title>T "), s, F.lit("</title></titleStmt><publicationStmt><date when='"), (i % 30 + 1990).cast("string"), F.lit("-02'/></publicationStmt><sourceDesc><biblStruct><analytic>"),
        person(F.when(i % 2 == 0, "<forename>Ann</forename>").otherwise(""), s), F.lit("<author><affiliation/></author>"), person(F.lit("<forename>Bo</forename>"), g),
        F.lit("</analytic><monogr><title level='j'>J"), g, F.lit("</title></monogr></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>One "), s, F.lit(".</p><p>Two.</p></abstract></profileDesc></teiHeader></TEI>"),
    )
    return _docs(spark, sf_dir).select("doc_id", responses.grobid(xml).alias("g")).select("doc_id", "g.title", F.array_join("g.authors", ",").alias("authors"), "g.year", "g.journal", "g.abstract")


@_query("SELECT doc_id, 'T ' || source AS title, lang || ',' || source AS authors, '10.1234/x.' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN '2301.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') END AS arxiv_id FROM documents")
def xmp_projection(spark, sf_dir):
    i, s = F.col("doc_id"), F.col("source")
    linked = F.when(i % 2 == 0, F.concat(F.lit("<dc:identifier>https://arxiv.org/abs/2301."), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit("</dc:identifier>"))).otherwise("")
    xml = F.concat(
        F.lit("<rdf:RDF xmlns:rdf='r' xmlns:dc='d'><rdf:Description><dc:title><rdf:Alt><rdf:li>T "), s, F.lit("</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>"), F.col("lang"), F.lit("</rdf:li><rdf:li>"), s,
        F.lit("</rdf:li></rdf:Seq></dc:creator><dc:identifier>doi:10.1234/x."), i.cast("string"), F.lit("</dc:identifier>"), linked, F.lit("</rdf:Description></rdf:RDF>"),
    )
    return _docs(spark, sf_dir).select("doc_id", responses.xmp(xml).alias("x")).select("doc_id", "x.title", F.array_join("x.authors", ",").alias("authors"), "x.doi", "x.arxiv_id")


# ---- table changes

def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("c"))


@_query("SELECT o_orderkey AS k, o_orderstatus AS state FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def strict_inserts(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("k", "state")
    return dml.insert_strict(rows.filter("k % 3 <> 0"), rows.filter("k % 3 = 0"), ["k"])


@_query("SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS inserted FROM orders")
def insert_flags(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("k")
    return dml.inserted_flags(rows.filter("k % 3 <> 0"), rows, ["k"])


@_query("SELECT vec_id AS chunk_id, label AS doc_id, 'old' AS version FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT vec_id, label, 'new' FROM embeddings WHERE label % 2 = 1 AND vec_id % 2 = 0")
def replaced_chunks(spark, sf_dir):
    """Documents of odd label come again with half their chunks; none of the old ones is left."""
    chunks = _chunks(spark, sf_dir).select("chunk_id", "doc_id", F.lit("old").alias("version"))
    return dml.replace_chunks(chunks, chunks.filter("doc_id % 2 = 1 AND chunk_id % 2 = 0").withColumn("version", F.lit("new")))


@_query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'done' ELSE o_orderstatus END AS state, o_custkey AS c FROM orders")
def updates_from_a_delta(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return dml.update_from(rows, rows.filter("k % 5 = 0").select("k", F.lit("done").alias("state")), ["k"], ["state"])


@_query("SELECT event_id AS log_id, user_id AS content_sha256 FROM events WHERE event_id < 100 UNION ALL SELECT 99 + row_number() OVER (ORDER BY event_id), user_id FROM events WHERE event_id >= 100")
def appended_log(spark, sf_dir):
    """Rows from 100 on are appended to a log of the first hundred and get the next numbers."""
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("content_sha256"), F.timestamp_seconds("event_id").alias("timestamp"), F.col("event_type").alias("action"))
    return dml.append_log(rows.filter("log_id < 100"), rows.filter("log_id >= 100").drop("log_id")).select("log_id", "content_sha256")


@_query("SELECT 'files' AS name, count(*) AS rows FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'links', count(*) FROM labels WHERE doc_id % 7 <> 0")
def removed_from_tables(spark, sf_dir):
    key = F.col("doc_id").alias("content_sha256")
    tables = {"files": _docs(spark, sf_dir).select(key), "links": _t(spark, sf_dir, "labels").select(key)}
    left = dml.remove_from_catalog(tables, _docs(spark, sf_dir).select(key).filter("content_sha256 % 7 = 0"))
    return dml.union_all([t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")).select("name", "rows") for n, t in left.items()])


@_query("WITH d AS (SELECT doc_id, sha256(text) AS h, lang || '_' || source || '.pdf' AS name FROM documents) SELECT 'hash' AS target, doc_id FROM d WHERE h = (SELECT sha256(text) FROM documents WHERE doc_id = 5) UNION ALL SELECT 'start', doc_id FROM d WHERE starts_with(h, 'abcdef') UNION ALL SELECT 'name', doc_id FROM d WHERE name ILIKE '%EN_%'")
def removal_targets(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.concat("lang", F.lit("_"), "source", F.lit(".pdf")).alias("display_name"))
    own = rows.filter("doc_id = 5").first().content_sha256
    return dml.union_all([rows.filter(catalog.target_filter(t)).select(F.lit(n).alias("target"), "doc_id") for n, t in (("hash", own.upper()), ("start", "ABCDEF"), ("name", "EN_"))])


@_query("SELECT count(*) FILTER (event_type = 'click') AS approved, count(*) FILTER (event_type = 'view') AS rejected, count(*) AS total FROM events")
def decision_counts(spark, sf_dir):
    d = F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "view", "rejected").otherwise(F.col("event_type"))
    return catalog.conditional_counts(_t(spark, sf_dir, "events").select(d.alias("decision")))


@_query("SELECT o_orderpriority, count(*) AS experiments FROM orders GROUP BY o_orderpriority")
def experiments_by_column(spark, sf_dir):
    return experiments.counts_by(_t(spark, sf_dir, "orders"), "o_orderpriority")


@_query("SELECT event_id AS log_id FROM events ORDER BY event_id DESC LIMIT 20")
def newest_log_rows(spark, sf_dir):
    return catalog.recent_log(_t(spark, sf_dir, "events").select(F.col("event_id").alias("log_id")), 20)


@_query("SELECT event_id AS id, event_type AS new_decision FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 500")
def newest_decisions(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("new_decision"), F.timestamp_seconds("event_id").alias("changed_at"))
    return catalog.decision_log(rows, "click").select("id", "new_decision")


@_query("SELECT metric, experiment_id, value FROM (SELECT 'query_coverage' AS metric, experiment_id, round(avg(CASE WHEN n > 0 THEN 1 ELSE 0 END), 6) AS value FROM (SELECT a.label::VARCHAR AS experiment_id, a.vec_id % 10 AS query, count(*) FILTER (a.vec_id % 4 = 0) AS n FROM embeddings a GROUP BY ALL) GROUP BY experiment_id)")
def compared_experiments(spark, sf_dir):
    """Coverage by the comparison that takes metrics by name; names that it does not know give no rows."""
    rows = _chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("experiment_id"), (F.col("chunk_id") % 10).alias("query"), "chunk_id")
    asked, found = rows.select("experiment_id", "query").distinct(), rows.filter("chunk_id % 4 = 0").select("experiment_id", "query", F.col("chunk_id").alias("doc_id"), F.lit(1.0).alias("similarity"))
    return experiments.compare(asked, found, "0", ["query_coverage", "unheard_of"])


@_query("SELECT '{\"id\":' || doc_id || ',\"content\":\"' || lang || '_\"}' AS value FROM documents")
def exported_lines(spark, sf_dir):
    return experiments.exported_results(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat("lang", F.lit("_")).alias("content")))


# ---- streams

@_query("SELECT user_id::VARCHAR AS doc_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def stream_newest_state(spark, sf_dir):
    """States arrive as a stream, folded batch by batch over what is there: two files, two batches."""
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("status"), F.timestamp_seconds("event_id").alias("at"))
    path = work_path(spark, "states")
    for part in (0, 1):
        rows.filter(F.pmod(F.xxhash64("at"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    incremental.state_stream(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return incremental.current(spark, f"{path}/table", "doc_id string, status string, at timestamp").select("doc_id", "status")


@_query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS_SQL}) AS term FROM documents) GROUP BY term")
def stream_keyword_index(spark, sf_dir):
    """The keyword index that follows a stream of chunks in two batches, read as its newest version."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    path = work_path(spark, "chunks")
    for part in (0, 1):
        # what has come since the last run is a batch, of as many files as there are
        rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        incremental.index_stream(stream, f"{path}/table", f"{path}/index", f"{path}/checkpoint").awaitTermination()
    return incremental.current_index(spark, f"{path}/index").terms.select("term", "df")


# ---- upkeep

def _library(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    held = d.filter("doc_id % 3 <> 0").select("content_sha256")
    other = d.filter("doc_id % 4 = 0").select("content_sha256")
    return d, held, other, d.filter("doc_id % 40 = 0").select("content_sha256")


_LIBRARY_SQL = """d AS (SELECT doc_id, sha256(text) AS h, source || '/' || doc_id AS path FROM documents), held AS (SELECT DISTINCT h FROM d WHERE doc_id % 3 <> 0), other AS (SELECT DISTINCT h FROM d WHERE doc_id % 4 = 0),
store AS (SELECT h, min(path) AS path FROM d WHERE doc_id % 2 = 1 AND h NOT IN (SELECT h FROM held) GROUP BY h), fetched AS (SELECT h FROM other WHERE h NOT IN (SELECT h FROM held) AND h NOT IN (SELECT h FROM store) AND h NOT IN (SELECT h FROM d WHERE doc_id % 40 = 0)),
link AS (SELECT h FROM (SELECT h FROM held UNION ALL SELECT h FROM store) WHERE h NOT IN (SELECT h FROM other))"""


@_query(f"WITH {_LIBRARY_SQL} SELECT h AS content_sha256, path, 'store' AS action FROM store UNION ALL SELECT h, NULL, 'fetch' FROM fetched UNION ALL SELECT h, NULL, 'link' FROM link")
def reconcile_plan(spark, sf_dir):
    from folioscope.plans.upkeep import reconcile_actions

    d, held, other, missing = _library(spark, sf_dir)
    return reconcile_actions(d.filter("doc_id % 2 = 1"), held, other, missing)


@_query(f"WITH {_LIBRARY_SQL} SELECT 'stored' AS name, count(*) AS n FROM (SELECT h FROM held UNION SELECT h FROM store UNION SELECT h FROM fetched) UNION ALL SELECT 'linked', count(*) FROM (SELECT h FROM other UNION SELECT h FROM link) UNION ALL SELECT 'left to do', count(*) FROM fetched WHERE FALSE")
def reconcile_applied(spark, sf_dir):
    """After the plan is applied, another finds nothing to do but to link what was fetched (it is linked already)."""
    from folioscope.plans.upkeep import apply_actions, reconcile_actions

    d, held, other, missing = _library(spark, sf_dir)
    found = d.filter("doc_id % 2 = 1")
    stored, linked = apply_actions(reconcile_actions(found, held, other, missing), held, other)
    left = reconcile_actions(found, stored, linked, missing)
    return dml.union_all([t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in (("stored", stored), ("linked", linked), ("left to do", left))])


@_query("WITH o AS (SELECT sha256(text) AS h FROM documents WHERE doc_id = 7) SELECT 'files' AS store, count(*) AS removed FROM documents, o WHERE sha256(text) = h UNION ALL SELECT 'chunks', coalesce(sum(len(string_split(text, chr(10)))), 0)::BIGINT FROM documents, o WHERE sha256(text) = h UNION ALL SELECT 'vectors', count(*) FROM embeddings, o WHERE vec_id = 7")
def removed_everywhere(spark, sf_dir):
    """One file out of catalog, chunks and vectors; a name that means several files removes none (tests)."""
    from folioscope.plans.upkeep import remove_document

    hashed = lambda name, key: _t(spark, sf_dir, name).withColumn("content_sha256", key)
    files = hashed("documents", F.sha2("text", 256)).withColumn("display_name", F.col("source"))
    own = files.filter("doc_id = 7").first().content_sha256
    vectors = hashed("embeddings", F.when(F.col("vec_id") == 7, own))
    stores = {"files": (files, "content_sha256"), "chunks": (files.select("content_sha256", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")), "content_sha256"), "vectors": (vectors, "content_sha256")}
    return remove_document(files, own, stores).counts


@_query("SELECT sha256(text) AS content_sha256, max(source || '/' || d.doc_id) AS path FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND quality = 1 WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0) AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY ALL")
def migrated_extractions(spark, sf_dir):
    from folioscope.plans.upkeep import migrated_extractions as migrated

    d = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    kinds = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "one").otherwise("two").alias("extractor"))
    return migrated(d.select("doc_id", "path").join(kinds, "doc_id"), d, d.filter("doc_id % 2 = 0"), d.filter("doc_id % 5 = 0"), "one")


@_query("WITH c AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0 OR conv_id % 4 <> 0) SELECT conv_id AS doc_id, count(*) AS chunks FROM c GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) + 1 <> count(*)")
def backfilled_gaps(spark, sf_dir):
    from folioscope.plans.upkeep import backfilled_chunks

    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return backfilled_chunks(rows.filter("doc_id % 4 <> 0"), rows.filter("chunk_index % 3 = 0"))[1].select("doc_id", "chunks")


@_query("SELECT d.doc_id, 'T' || quality AS title, n AS chunk_count, CASE WHEN d.doc_id % 2 = 0 THEN 'b' WHEN d.doc_id % 3 = 0 THEN 'a' END AS extraction_path FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT label AS doc_id, count(*) AS n FROM embeddings GROUP BY label) USING (doc_id)")
def file_details(spark, sf_dir):
    from folioscope.plans.upkeep import document_details

    key = F.col("doc_id").alias("content_sha256")
    files = _docs(spark, sf_dir).select(key)
    resolved = _t(spark, sf_dir, "labels").select(key, F.concat(F.lit("T"), F.col("quality").cast("string")).alias("title"), F.lit(2000).alias("year"))
    texts = files.filter("content_sha256 % 3 = 0").withColumn("path", F.lit("a")).union(files.filter("content_sha256 % 2 = 0").withColumn("path", F.lit("b")))
    return document_details(files, resolved, _chunks(spark, sf_dir), texts).select(F.col("content_sha256").alias("doc_id"), "title", "chunk_count", "extraction_path")
