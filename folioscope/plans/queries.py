"""The registered queries over the driver's tables, each with SQL that says the same.

How tables stand in for the catalog's: documents are files keyed by the hash of their text, embeddings
are chunks whose document is their label, conversations give chunked documents, labels the state of a
file, orders and events the dated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import names, text, vectors
from folioscope.operators import bm25, catalog, chunking, dml, experiments, ranking, reconcile, topics, vector_search
from folioscope.sources.files import remaining
from folioscope.sources.places import work_path, written
from folioscope.sources.sinks import bib_entries
from folioscope.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Search texts and the vectors that go with them: (query_id, text, vec_id).
ASKED = [(1, "worthless idiot of the thanedble", 0), (2, "des la quevi pas eau", 7), (3, "nothing-of-this-kind", 11)]
_ASKED_SQL = "(VALUES " + ", ".join(f"({i}, '{t}', {v})" for i, t, v in ASKED) + ") AS asked(query_id, query, vec_id)"
_TOKENS_SQL = r"""list_filter(string_split_regex(lower(text), '[\s,;:()\[\]{}''"]+'), lambda x: x <> '')"""


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string, vec_id long")


# ---- keyword search

_BM25_SQL = f"""WITH tok AS (SELECT doc_id AS chunk_id, {_TOKENS_SQL} AS t FROM documents),
len AS (SELECT chunk_id, len(t) AS dl FROM tok), post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus), mean AS (SELECT avg(raw) AS m FROM raw),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw, mean)"""
_KEYWORD_SQL = f""",
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS_SQL.replace('text', 'query')}) AS term FROM {_ASKED_SQL}) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS s FROM q JOIN terms USING (term) JOIN post USING (term) JOIN len USING (chunk_id), corpus GROUP BY ALL),
al AS (SELECT a.query_id, l.chunk_id, coalesce(s, 0) AS s FROM {_ASKED_SQL.replace('asked(', 'a(')} CROSS JOIN len l LEFT JOIN sc ON sc.query_id = a.query_id AND sc.chunk_id = l.chunk_id WHERE {{where}}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) - 1 AS rank FROM al),
kw AS (SELECT query_id, chunk_id, rank, s AS raw_score, CASE WHEN max(s) OVER (PARTITION BY query_id) > 0 THEN s / max(s) OVER (PARTITION BY query_id) ELSE 0 END AS score FROM rk WHERE rank < 200)"""
_FOUND_SQL = _BM25_SQL + _KEYWORD_SQL.replace("{where}", "TRUE")


def _index(spark, sf_dir) -> bm25.Bm25Index:
    return bm25.build(_t(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


def _keyword(spark, sf_dir) -> DataFrame:
    return bm25.search(_index(spark, sf_dir), _asked(spark).select("query_id", "query"), 200)


@_query(_FOUND_SQL + " SELECT query_id, chunk_id, rank, raw_score, round(score, 9) AS score FROM kw")
def bm25_topk(spark, sf_dir):
    return _rounded(_keyword(spark, sf_dir), "score")


@_query(f"""WITH d AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS_SQL}) AS term FROM documents) GROUP BY term),
r AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, (SELECT count(*) AS n FROM documents)), m AS (SELECT avg(raw) AS m FROM r)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END, 6) AS idf FROM r, m""")
def bm25_term_stats(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@_query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS_SQL}) AS term FROM documents) GROUP BY term")
def tokenize_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_query(_FOUND_SQL + " SELECT query_id, term, df, qtf FROM q JOIN terms USING (term)")
def bm25_index_round_trip(spark, sf_dir):
    """The index written, read again, and asked for the queries' words."""
    path = work_path(spark, "bm25")
    bm25.build(_t(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", path=path)
    read = bm25.Bm25Index.load(spark, path)
    return bm25.query_terms(_asked(spark).select("query_id", "query")).join(read.terms, "term").select("query_id", "term", "df", "qtf")


# ---- vector search and ranking

def _vec_sql(metric: str, where: str = "TRUE", k: int = 200, name: str = "hits") -> str:
    d = "1 - list_cosine_similarity(q.v, e.v)" if metric == "cosine" else "list_sum(list_transform(range(1, len(e.v) + 1), lambda i: (q.v[i] - e.v[i]) * (q.v[i] - e.v[i])))"
    return f"""{name}_d AS (SELECT query_id, e.vec_id AS chunk_id, e.label AS doc_id, round({d}, 6) AS distance FROM (SELECT query_id, x.embedding::DOUBLE[] AS v FROM {_ASKED_SQL} JOIN embeddings x USING (vec_id)) q CROSS JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE {where}) e),
{name} AS (SELECT *, least(1, greatest(0, 1 / (1 + distance))) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS rank FROM {name}_d) WHERE rank < {k})"""


def _chunks(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), "embedding")


def _hits(spark, sf_dir, metric="cosine", k=200, where=None) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    asked = _asked(spark).join(chunks.select(F.col("chunk_id").alias("vec_id"), F.col("embedding").alias("vector")), "vec_id").select("query_id", "vector")
    return vector_search.search(chunks, asked, k, metric=metric, where=where, digits=6)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


@_query(f"WITH {_vec_sql('cosine')} SELECT query_id, chunk_id, doc_id, rank, round(distance, 9) AS distance, round(similarity, 9) AS similarity FROM hits")
def vector_topk_cosine(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir), "distance", "similarity").select("query_id", "chunk_id", "doc_id", "rank", "distance", "similarity")


@_query(f"WITH {_vec_sql('l2')} SELECT query_id, chunk_id, doc_id, rank, round(distance, 9) AS distance, round(similarity, 9) AS similarity FROM hits")
def vector_topk_l2(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir, "l2"), "distance", "similarity").select("query_id", "chunk_id", "doc_id", "rank", "distance", "similarity")


@_query(f"WITH {_vec_sql('cosine', 'label <> 3', 50)} SELECT query_id, chunk_id, doc_id, rank FROM hits")
def vector_topk_filtered(spark, sf_dir):
    return _hits(spark, sf_dir, k=50, where=F.col("doc_id") != 3).select("query_id", "chunk_id", "doc_id", "rank")


_SIM_DOCS = "SELECT query_id, doc_id, greatest(0, max(similarity)) AS score, count(*) AS matching_chunks FROM hits GROUP BY ALL"


@_query(f"WITH {_vec_sql('cosine')} SELECT query_id, doc_id, matching_chunks, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM ({_SIM_DOCS})")
def similarity_rank_docs(spark, sf_dir):
    return _rounded(ranking.by_similarity(_hits(spark, sf_dir)), "score")


@_query(f"WITH {_vec_sql('cosine')}, p AS (SELECT query_id, doc_id, sum(CASE WHEN similarity >= 0.52 THEN 1 ELSE 0 END)::DOUBLE AS score, max(similarity) AS best FROM hits GROUP BY ALL) SELECT query_id, doc_id, score, round(best, 9) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best DESC, doc_id) - 1 AS rank FROM p")
def relevance_rank_docs(spark, sf_dir):
    return _rounded(ranking.by_relevance(_hits(spark, sf_dir), 0.52), "best")


@_query(f"WITH {_vec_sql('cosine')} SELECT query_id, doc_id, chunk_id, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY similarity DESC, rank) AS n FROM hits) WHERE n = 1")
def best_chunk_per_doc(spark, sf_dir):
    return _rounded(ranking.best_chunk(_hits(spark, sf_dir)), "similarity")


@_query(f"WITH {_vec_sql('cosine', k=10000)} SELECT query_id, count(*) AS chunks_fetched, count(*) FILTER (similarity >= 0.52) AS chunks_above, count(DISTINCT doc_id) FILTER (similarity >= 0.52) AS documents_found, 1 AS iterations FROM hits GROUP BY query_id")
def fetch_stats(spark, sf_dir):
    return ranking.fetch_statistics(_hits(spark, sf_dir, k=vector_search.WIDE_FETCH), 0.52)


_FUSED_PART = ", fused AS (SELECT h.query_id, h.chunk_id, h.doc_id, h.rank AS rank_semantic, kw.rank AS rank_bm25, 1 / (60.0::DOUBLE + h.rank) + 1 / (60.0::DOUBLE + coalesce(kw.rank, 201)) AS rrf_score FROM hits h LEFT JOIN kw ON kw.query_id = h.query_id AND kw.chunk_id = h.chunk_id)"
_FUSED = _FOUND_SQL + f", {_vec_sql('cosine')}" + _FUSED_PART


@_query(_FUSED + " SELECT query_id, chunk_id, doc_id, rank_semantic, rank_bm25, round(rrf_score, 9) AS rrf_score FROM fused")
def hybrid_rrf_chunks(spark, sf_dir):
    fused = ranking.fuse(_hits(spark, sf_dir), _keyword(spark, sf_dir))
    return fused.select("query_id", "chunk_id", "doc_id", "rank_semantic", "rank_bm25", F.round("rrf_score", 9).alias("rrf_score"))


@_query(_FUSED + ", r AS (SELECT *, round(rrf_score, 9) AS s FROM fused), p AS (SELECT query_id, doc_id, max(s) AS score, count(*) AS matching_chunks, arg_max(chunk_id, (s, -rank_semantic)) AS chunk_id FROM r GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM p")
def hybrid_rrf_docs(spark, sf_dir):
    return ranking.fused_documents(ranking.fuse(_hits(spark, sf_dir), _keyword(spark, sf_dir)))


_KW_DOCS = "SELECT query_id, doc_id, max(score) AS score, count(*) AS matching_chunks FROM {src} GROUP BY ALL"


@_query(_FOUND_SQL + " SELECT query_id, doc_id, matching_chunks, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (" + _KW_DOCS.format(src="(SELECT kw.*, label AS doc_id FROM kw JOIN embeddings e ON e.vec_id = kw.chunk_id)") + ")")
def bm25_mode_docs(spark, sf_dir):
    return _rounded(ranking.keyword_documents(_keyword(spark, sf_dir), _chunks(spark, sf_dir)), "score")


@_query(_FOUND_SQL + f", {_vec_sql('cosine')} SELECT query_id, doc_id, matching_chunks, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM (" + _KW_DOCS.format(src="(SELECT kw.*, c.doc_id FROM kw JOIN (SELECT DISTINCT chunk_id, doc_id FROM hits) c ON c.chunk_id = kw.chunk_id)") + ")")
def bm25_mode_docs_strict(spark, sf_dir):
    """The narrow form: only documents among the semantic candidates."""
    return _rounded(ranking.keyword_documents(_keyword(spark, sf_dir), _hits(spark, sf_dir).select("chunk_id", "doc_id").distinct()), "score")


@_query("SELECT e.vec_id AS chunk_id, e.label AS doc_id, row_number() OVER (ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), e.vec_id) - 1 AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 5) q WHERE e.vec_id <> 5 AND e.label <> q.label QUALIFY rank < 10")
def more_like_this(spark, sf_dir):
    return vector_search.similar_chunks(_chunks(spark, sf_dir), 5, 10).select("chunk_id", "doc_id", "rank")


@_query(f"WITH {_vec_sql('cosine', 'label IN (2, 4)', 5)} SELECT query_id, chunk_id, doc_id, rank FROM hits")
def within_document_search(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    asked = _asked(spark).join(chunks.select(F.col("chunk_id").alias("vec_id"), F.col("embedding").alias("vector")), "vec_id").select("query_id", "vector")
    return vector_search.chunk_search(chunks, asked, 5, document_ids=[2, 4]).select("query_id", "chunk_id", "doc_id", "rank")


@_query("SELECT label AS doc_id, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY ALL")
def mean_pool_vectors(spark, sf_dir):
    return vectors.mean_pooled(_chunks(spark, sf_dir), "doc_id", "embedding").select("doc_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


# ---- text functions

@_query(r"SELECT doc_id, len(regexp_extract_all(text, '(?s)\\\[(.*?)\\\]', 1)) AS display_eq_count, len(regexp_extract_all(text, '\$(.*?)\$', 1)) AS inline_eq_count, display_eq_count + inline_eq_count > 0 AS has_equations FROM documents")
def equation_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.equation_counts(F.col("text")).alias("e")).select("doc_id", "e.*")


@_query(r"""SELECT count(*) AS total_chunks, round(100 * avg(CASE WHEN regexp_matches(text, '(?s)\\\[(.*?)\\\]') OR regexp_matches(text, '\$(.*?)\$') THEN 1 ELSE 0 END), 1) AS equation_percentage FROM documents""")
def database_stats(spark, sf_dir):
    return catalog.equation_share(_t(spark, sf_dir, "documents").select(text.equation_counts(F.col("text"))["has_equations"].alias("has_equations")))


@_query(r"""SELECT doc_id, md5(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '(?m)\n\d+\s*$', '', 'g'), '“”‘’', '""'''''), '^\s+|\s+$', '', 'g')) AS cleaned FROM documents""")
def clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.cleaned(F.col("text"))).alias("cleaned"))


_CITED_SQL = "'see doi: 10.' || (1000 + doc_id % 9000) || '/x.' || doc_id || '). Also https://doi.org/10.55555/' || lang || ',' || ' arXiv:2301.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || 'v2 on page _page_' || (doc_id % 30) || '_Figure and <span id=\"page-' || (doc_id % 7) || '-1\">'"


def _cited(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id")
    t = F.concat(F.lit("see doi: 10."), (i % 9000 + 1000).cast("string"), F.lit("/x."), i.cast("string"), F.lit("). Also https://doi.org/10.55555/"), F.col("lang"), F.lit(", arXiv:2301."), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit("v2 on page _page_"), (i % 30).cast("string"), F.lit('_Figure and <span id="page-'), (i % 7).cast("string"), F.lit('-1">'))
    return _t(spark, sf_dir, "documents").select("doc_id", t.alias("t"))


@_query(rf"""WITH c AS (SELECT doc_id, {_CITED_SQL} AS t FROM documents) SELECT doc_id, nullif(regexp_extract(t, '(\d{{4}}\.\d{{4,5}}(?:v\d+)?)', 1), '') AS arxiv_id, regexp_replace(nullif(regexp_extract(t, '(\d{{4}}\.\d{{4,5}}(?:v\d+)?)', 1), ''), 'v\d+$', '') AS arxiv_base_id,
nullif(regexp_extract(t, '(?i)(?:doi:|DOI:)?\s*(10\.\d+/[^\s]+)', 1), '') AS doi_lenient, regexp_replace(nullif(regexp_extract(t, '(10\.\d{{4,}}/[^\s]+)', 1), ''), '[.,;)]+$', '') AS doi_strict,
regexp_replace(nullif(regexp_extract(t, '(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)(10\.\d{{4,}}/[^\s,;)\]"''}}>]+)', 1), ''), '[.,;)]+$', '') AS doi_any FROM c""")
def extract_ids(spark, sf_dir):
    t = F.col("t")
    return _cited(spark, sf_dir).select("doc_id", text.arxiv_id(t).alias("arxiv_id"), text.arxiv_base_id(t).alias("arxiv_base_id"), text.doi_lenient(t).alias("doi_lenient"), text.doi_strict(t).alias("doi_strict"), text.doi_any(t).alias("doi_any"))


@_query(r"SELECT doc_id, array_to_string(list_sort(list_distinct([doc_id % 30 + 1, doc_id % 7 + 1])), ',') AS pages FROM documents")
def page_references(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", F.array_join(text.page_references(F.col("t")).cast("array<string>"), ",").alias("pages"))


_LINE_SQL = "string_split(text, chr(10))[1]"


@_query(f"""WITH s AS (SELECT doc_id, {_LINE_SQL} AS line FROM documents), a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(line, '[^a-zA-Z0-9 ._-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM s), b AS (SELECT doc_id, CASE WHEN c = '' THEN 'document' ELSE c END AS c FROM a), p AS (SELECT doc_id, CASE WHEN lower(c) LIKE '%.pdf' THEN c ELSE c || '.pdf' END AS c FROM b)
SELECT doc_id, CASE WHEN length(c) <= 120 THEN c ELSE CASE WHEN regexp_replace(c[1:116], '[ ._-]+$', '') = '' THEN 'document' ELSE regexp_replace(c[1:116], '[ ._-]+$', '') END || '.pdf' END AS display_name FROM p""")
def display_name(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", names.safe_filename(F.substring_index("text", "\n", 1)).alias("display_name"))


@_query(f"""WITH s AS (SELECT doc_id, string_split_regex({_LINE_SQL}, '\\s+') AS w, 1990 + doc_id % 30 AS y, sha256(text) AS h FROM documents), k AS (SELECT doc_id, y, h, lower(regexp_replace(strip_accents(string_split(w[1], ',')[1]), '[^\\x00-\\x7F]', '', 'g')) AS a, list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the', 'on', 'of'))[1] AS t FROM s)
SELECT doc_id, coalesce(nullif(a, ''), 'unknown') || '-' || y || '-' || coalesce(t, 'untitled') || '-' || h[1:12] AS citation_key FROM k""")
def citation_key(spark, sf_dir):
    line = F.substring_index("text", "\n", 1)
    return _t(spark, sf_dir, "documents").select("doc_id", names.citation_key(F.array(F.element_at(F.split(line, r"\s+"), 1)), F.col("doc_id") % 30 + 1990, line, F.sha2("text", 256)).alias("citation_key"))


@_query("""SELECT sha256(text) AS content_sha256, '@' || CASE lang WHEN 'en' THEN 'article' WHEN 'fr' THEN 'inproceedings' ELSE 'misc' END || '{' || lang || doc_id || ',' || chr(10) || '  author = {' || source || ' and ' || lang || '},' || chr(10) || CASE WHEN lang = 'fr' THEN '  booktitle = {' ELSE '  journal = {' END || 'a\\{b\\}' || source || '},' || chr(10) || '  year = {' || (1990 + doc_id % 30) || '},' || chr(10) || '}' || chr(10) AS value FROM documents""")
def bib_entry(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "journal-article").when(F.col("lang") == "fr", "conference-paper")
    none = F.lit(None).cast("string")
    value = names.bib_entry(F.concat(F.col("lang"), F.col("doc_id").cast("string")), kind, F.array("source", "lang"), F.col("doc_id") % 30 + 1990, none, F.concat(F.lit("a{b}"), F.col("source")), none)
    return _t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_sha256"), value.alias("value"))


@_query(f"""SELECT doc_id, 'file://' || replace(url_encode('/data/' || source || '/' || coalesce({_LINE_SQL}, '')), '%2F', '/') || '#page=' || (doc_id % 9 + 1) AS link FROM documents""")
def file_link(spark, sf_dir):
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.substring_index("text", "\n", 1))
    return _t(spark, sf_dir, "documents").select("doc_id", names.file_link(path, F.array(F.col("doc_id") % 9 + 1)).alias("link"))


@_query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview, source || ' | ' || lang || ' | ' || n_chars || ' - x' AS label, round(n_chars / 1048576.0::DOUBLE, 2) AS size_mb, 'sha256/' || sha256(text)[1:2] || '/' || sha256(text)[3:4] || '/' || sha256(text) AS dir FROM documents")
def format_fields(spark, sf_dir):
    name = F.concat_ws(" - ", "source", "lang", F.col("n_chars").cast("string"), F.lit("x"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 200).alias("preview"), names.doc_label(name).alias("label"), names.size_mb(F.col("n_chars")).alias("size_mb"), names.canonical_dir(F.sha2("text", 256)).alias("dir"))


@_query("SELECT doc_id, upper(lang[1:1]) || lang[2:2] AS authors, (1990 + doc_id % 40)::INTEGER AS year FROM documents")
def filename_metadata(spark, sf_dir):
    name = F.concat(F.initcap("lang"), (F.col("doc_id") % 40 + 1990).cast("string"), F.lit("_paper.pdf"))
    return _t(spark, sf_dir, "documents").select("doc_id", names.filename_metadata(name).alias("m")).select("doc_id", F.array_join("m.authors", ",").alias("authors"), "m.year")


@_query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents) SELECT doc_id, coalesce(list_filter(ls[1:5], lambda x: length(x) > 10 AND NOT (upper(x) = x AND lower(x) <> x))[1], ls[1]) AS title FROM l""")
def first_page_title(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", names.first_page_metadata(F.col("text"))["title"].alias("title"))


@_query("SELECT o_orderkey, array_to_string(list_transform(range(0, (o_orderkey % 40)::BIGINT, 7), lambda s: s || '-' || least(s + 6, o_orderkey % 40 - 1)), ',') AS ranges FROM orders")
def page_ranges(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.page_ranges(F.col("o_orderkey") % 40, 7), ",").alias("ranges"))


# ---- chunkers

_TURNS = "conversations"


def _talks(spark, sf_dir) -> DataFrame:
    """Conversations as Markdown documents: a heading for each turn."""
    part = F.concat(F.lit("# "), F.col("role"), F.lit("\n\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", part.alias("p"))))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("content"))


#: Sections of the talks (longer ones are cut behind their heading line, texts hold no blank line), put together until they
#: have 200 characters; what is left at the end goes to the chunk before it.
_SECTIONS_SQL = """WITH b AS (SELECT conv_id, turn, role, text, '# ' || role || chr(10) || chr(10) || text AS body FROM conversations WHERE role || text IS NOT NULL),
p AS (SELECT conv_id, turn, 0 AS k, role, body AS t FROM b WHERE length(body) <= 3000 UNION ALL SELECT conv_id, turn, 0, role, '# ' || role || chr(10) || chr(10) || '# ' || role FROM b WHERE length(body) > 3000 UNION ALL SELECT conv_id, turn, 1, role, body FROM b WHERE length(body) > 3000),
l AS (SELECT conv_id, list({'t': t, 'role': role} ORDER BY turn, k) AS own FROM p GROUP BY conv_id),
f AS (SELECT conv_id, own, list_reduce(list_prepend({'n': 0::BIGINT, 'k': 0::BIGINT, 'of': []::BIGINT[]}, list_transform(own, lambda x: {'n': length(x.t)::BIGINT, 'k': 0::BIGINT, 'of': []::BIGINT[]})),
lambda s, x: CASE WHEN CASE WHEN s.n = 0 THEN x.n ELSE s.n + 2 + x.n END >= 200 THEN {'n': 0::BIGINT, 'k': s.k + 1, 'of': list_append(s.of, s.k)} ELSE {'n': CASE WHEN s.n = 0 THEN x.n ELSE s.n + 2 + x.n END, 'k': s.k, 'of': list_append(s.of, s.k)} END) AS g FROM l),
u AS (SELECT conv_id, unnest(own) AS x, unnest(g.of) AS of, unnest(range(len(own))) AS i, g.k AS k FROM f),
c AS (SELECT conv_id, CASE WHEN of = k AND k > 0 THEN k - 1 ELSE of END AS chunk, string_agg(x.t, chr(10) || chr(10) ORDER BY i) AS content, [arg_max(x.role, i) FILTER (of < k OR k = 0)] AS section FROM u GROUP BY ALL)"""


@_query(_SECTIONS_SQL + " SELECT conv_id, chunk::INTEGER AS chunk_index, content, section FROM c")
def section_chunks(spark, sf_dir):
    return chunking.section_chunks(_talks(spark, sf_dir), id_col="conv_id")


@_query(_SECTIONS_SQL + r" SELECT conv_id, content, (chunk + 10)::INTEGER AS chunk_index, length(content) AS chunk_length, len(regexp_extract_all(content, '(?s)\\\[(.*?)\\\]', 1)) AS display_eq_count, len(regexp_extract_all(content, '\$(.*?)\$', 1)) AS inline_eq_count, display_eq_count + inline_eq_count > 0 AS has_equations FROM c")
def chunk_metadata(spark, sf_dir):
    return chunking.with_metadata(chunking.section_chunks(_talks(spark, sf_dir), id_col="conv_id"), 10).drop("section")


_FOLD_SQL = "list_reduce(list_transform(list_prepend('', string_split(text, chr(10))), lambda p: {{'len': length(p)::BIGINT, 'k': 0::BIGINT, 'of': []::BIGINT[]}}), lambda s, p: CASE WHEN s.len > 0 AND s.len + p.len > {most} THEN {{'len': p.len, 'k': s.k + 1, 'of': list_append(s.of, s.k + 1)}} ELSE {{'len': CASE WHEN s.len = 0 THEN p.len ELSE s.len + 2 + p.len END, 'k': s.k, 'of': list_append(s.of, s.k)}} END).of"


@_query(f"""WITH g AS (SELECT doc_id, string_split(text, chr(10)) AS p, {_FOLD_SQL.format(most=400)} AS of FROM documents), u AS (SELECT doc_id, unnest(p) AS p, unnest(of) AS chunk_index, unnest(range(1, len(p) + 1)) AS i FROM g), c AS (SELECT doc_id, chunk_index, string_agg(p, chr(10) || chr(10) ORDER BY i) AS content FROM u GROUP BY ALL)
SELECT doc_id, chunk_index::INTEGER AS chunk_index, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content, '1' AS page_numbers FROM c WHERE trim(content, chr(10) || ' ') <> ''""")
def page_chunks(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    return chunking.chunk_rows(docs, most=400).withColumn("page_numbers", F.array_join(F.col("page_numbers").cast("array<string>"), ","))


@_query("SELECT conv_id AS doc_id, turn, text AS content FROM conversations WHERE conv_id = 3 AND turn BETWEEN 1 AND 3")
def chunk_range_read(spark, sf_dir):
    return catalog.chunk_range(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content")), 3, 1, 3).withColumnRenamed("chunk_index", "turn")


@_query("SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def doc_text_concat(spark, sf_dir):
    return topics.document_texts(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content")))


@_query("SELECT conv_id AS doc_id, count(*) AS chunks, min(turn) AS first, max(turn) AS last, count(DISTINCT turn) AS distinct, min(turn) <> 0 OR max(turn) + 1 <> count(*) OR count(DISTINCT turn) <> count(*) AS has_gap FROM conversations GROUP BY conv_id")
def gap_check(spark, sf_dir):
    return dml.index_gaps(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index")))


@_query("SELECT conv_id AS doc_id, count(*) AS chunk_count FROM conversations GROUP BY conv_id")
def chunk_counts(spark, sf_dir):
    return catalog.chunk_counts(_t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")))


# ---- catalog

def _files(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", F.col("doc_id").alias("seq"), F.col("n_chars").alias("file_size_bytes"))


def _states(spark, sf_dir) -> DataFrame:
    """labels as links of files: the state that stands for their two marks."""
    state = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "pending").otherwise("imported")
    return _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_sha256"), state.alias("status"))


_STATES_SQL = "(SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'pending' ELSE 'imported' END AS status FROM labels)"


@_query(f"SELECT d.doc_id AS content_sha256, status FROM documents d LEFT JOIN {_STATES_SQL} l USING (doc_id) WHERE status IS NULL OR status IN ('failed', 'pending')")
def unlinked_left_join(spark, sf_dir):
    return catalog.unlinked(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_sha256")), _states(spark, sf_dir))


@_query("SELECT doc_id AS content_sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unresolved_anti_join(spark, sf_dir):
    return catalog.unresolved(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_sha256")), _states(spark, sf_dir))


@_query(f"SELECT count(*) AS linked FROM documents JOIN {_STATES_SQL} l USING (doc_id) WHERE status IN ('imported', 'pre-existing')")
def linked_inner_count(spark, sf_dir):
    return catalog.linked_count(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_sha256")), _states(spark, sf_dir))


@_query(f"SELECT (SELECT count(*) FROM documents) AS canonical_files, (SELECT count(*) FROM events) AS source_sightings, (SELECT count(*) FROM labels) AS zotero_links, (SELECT count(*) FROM orders) AS ingest_log, (SELECT count(*) FROM documents LEFT JOIN {_STATES_SQL} l USING (doc_id) WHERE status IS NULL OR status IN ('failed', 'pending')) AS unlinked")
def catalog_statistics(spark, sf_dir):
    return catalog.statistics(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_sha256")), _t(spark, sf_dir, "events"), _states(spark, sf_dir), _t(spark, sf_dir, "orders"))


@_query("SELECT sum(n_chars)::BIGINT AS bytes FROM documents")
def canonical_store_bytes(spark, sf_dir):
    return catalog.stored_bytes(_files(spark, sf_dir))


@_query("SELECT o_orderkey, o_orderdate AS ingested_at, c_name AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_files(spark, sf_dir):
    files = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("content_sha256"), "o_orderkey", F.col("o_orderdate").alias("ingested_at"))
    meta = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("content_sha256"), F.col("c_name").alias("title"), F.lit(None).alias("authors"), F.lit(None).alias("year"))
    return catalog.recent_files(files, meta, 50, "o_orderkey").select("o_orderkey", "ingested_at", "title")


@_query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return catalog.latest_per_key(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id")


_SEEN_SQL = "SELECT user_id::VARCHAR AS content_sha256, event_type AS source_path, 'm' AS machine_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL"


def _seen(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("content_sha256"), F.col("event_type").alias("source_path"), F.lit("m").alias("machine_id"), F.col("ts").cast("timestamp").alias("first_seen"), F.col("ts").cast("timestamp").alias("last_seen"))


def _plain_times(df: DataFrame, like: DataFrame) -> DataFrame:
    kind = like.schema["ts"].dataType
    return df.withColumns({c: F.col(c).cast(kind) for c in ("first_seen", "last_seen")})


@_query(_SEEN_SQL)
def upsert_first_last_seen(spark, sf_dir):
    """The second half of the events over a table of the first."""
    events = _t(spark, sf_dir, "events")
    first = F.pmod("event_id", F.lit(2)) == 0
    empty = _seen(events).limit(0)
    old = written(dml.upsert_sightings(empty, _seen(events.filter(first))), "sightings")
    return _plain_times(dml.upsert_sightings(old, _seen(events.filter(~first))), events)


@_query(_SEEN_SQL)
def stream_first_last_seen(spark, sf_dir):
    """The same as a stream of two batches that are folded into a table."""
    events = _t(spark, sf_dir, "events")
    path = work_path(spark, "sightings")
    for part in (0, 1):
        events.filter(F.pmod("event_id", F.lit(2)) == part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        incremental.sightings_stream(_seen(stream), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    schema = "content_sha256 string, source_path string, machine_id string, first_seen timestamp, last_seen timestamp"
    return _plain_times(incremental.current(spark, f"{path}/table", schema), events)


@_query("SELECT sha256(text) AS content_sha256, coalesce(min(source) FILTER (doc_id % 2 = 0), min(source)) AS path FROM documents GROUP BY sha256(text)")
def stream_ingest_once(spark, sf_dir):
    """Two batches; what the second brings again stays as the first brought it."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.col("source").alias("path"))
    path = work_path(spark, "ingest")
    for part in (0, 1):
        docs.filter(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"{path}/in")
        incremental.ingest_stream(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return incremental.current(spark, f"{path}/table", "content_sha256 string, path string")


@_query("SELECT o_orderstatus AS status, count(*) AS documents, coalesce(sum(o_custkey), 0)::BIGINT AS chunks FROM orders GROUP BY ALL")
def status_breakdown(spark, sf_dir):
    return catalog.status_counts(_t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("chunk_count")))


@_query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) AS total FROM orders GROUP BY ALL")
def status_pivot_by_project(spark, sf_dir):
    return catalog.status_pivot(_t(spark, sf_dir, "orders"), ["F", "O", "P"], "o_orderpriority", "o_orderstatus")


@_query("SELECT o_orderkey AS doc_id, o_orderdate AS added_date FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30' AND lower(o_orderpriority) LIKE '%high%' AND o_totalprice BETWEEN 10000 AND 300000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def subset_filter_sort_limit(spark, sf_dir):
    docs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("added_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("filename"), F.col("o_totalprice").alias("file_size_bytes"))
    return catalog.subset(docs, status="O", date_from="1996-01-01", date_to="1997-06-30", name_contains="HIGH", size_range=(10000, 300000), limit=100).select("doc_id", "added_date")


@_query("SELECT doc_id AS content_sha256, old_decision, new_decision FROM (SELECT user_id AS doc_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old_decision, event_type AS new_decision FROM events) WHERE old_decision IS DISTINCT FROM new_decision")
def decision_history(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("content_sha256"), F.col("event_type").alias("decision"), F.timestamp_seconds("event_id").alias("decided_at"))
    return dml.decision_changes(rows).drop("changed_at")


@_query("SELECT count(*) FILTER (event_type = 'click') AS success, count(*) FILTER (event_type = 'purchase') AS error, 0 AS skipped, count(*) AS total FROM events")
def outcome_tally(spark, sf_dir):
    s = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "purchase", "error")
    return experiments.outcome_tally(_t(spark, sf_dir, "events").select(s.alias("status")))


# ---- duplicates, merging, reconciling

@_query("SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS linked_to, min(doc_id) OVER (PARTITION BY text) = doc_id AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) AS is_new FROM documents")
def content_dedup(spark, sf_dir):
    files = _files(spark, sf_dir).select("content_hash", "doc_id", "seq")
    return reconcile.register(files, files.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi")).drop("seq")


@_query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return reconcile.duplicate_groups(_files(spark, sf_dir))


_SOURCES_SQL = """(SELECT d.doc_id AS id, 'grobid' AS s, 1 AS p, CASE WHEN l.quality = 1 THEN d.source END AS title, [d.lang] AS authors, NULL::INTEGER AS year, CASE WHEN l.toxic = 1 THEN d.lang END AS journal FROM documents d JOIN labels l USING (doc_id)
UNION ALL SELECT doc_id, 'arxiv', 4, lang, [source, lang], (2000 + n_chars % 20)::INTEGER, source FROM documents UNION ALL SELECT page_id, 'xmp', 5, url, ['x', 'y', 'z'], 1999, NULL FROM pages)"""


@_query(f"""WITH s AS {_SOURCES_SQL} SELECT id AS content_sha256, arg_min(title, p) AS title, arg_min(year, p) FILTER (year IS NOT NULL) AS year, arg_min(journal, p) FILTER (journal IS NOT NULL) AS journal, array_to_string(arg_max(authors, (len(authors), -p)), ',') AS authors, array_to_string(list_sort(list(DISTINCT s)), ',') AS source_extractors FROM s WHERE title IS NOT NULL AND title <> '' GROUP BY id""")
def metadata_priority_merge(spark, sf_dir):
    docs, labels, pages = (_t(spark, sf_dir, n) for n in ("documents", "labels", "pages"))
    none = lambda kind: F.lit(None).cast(kind)
    rest = [none("string").alias("abstract"), none("string").alias("doc_type")]
    g = docs.join(labels, "doc_id").select(F.col("doc_id").alias("content_sha256"), F.lit("grobid").alias("extractor_name"), F.when(F.col("quality") == 1, F.col("source")).alias("title"), F.array("lang").alias("authors"), none("int").alias("year"), F.when(F.col("toxic") == 1, F.col("lang")).alias("journal"), *rest)
    a = docs.select(F.col("doc_id").alias("content_sha256"), F.lit("arxiv").alias("extractor_name"), F.col("lang").alias("title"), F.array("source", "lang").alias("authors"), (F.col("n_chars") % 20 + 2000).cast("int").alias("year"), F.col("source").alias("journal"), *rest)
    x = pages.select(F.col("page_id").alias("content_sha256"), F.lit("xmp").alias("extractor_name"), F.col("url").alias("title"), F.array(*map(F.lit, "xyz")).alias("authors"), F.lit(1999).alias("year"), none("string").alias("journal"), *rest)
    return reconcile.merge_metadata(g.union(a).union(x)).select("content_sha256", "title", "year", "journal", F.array_join("authors", ",").alias("authors"), F.array_join("source_extractors", ",").alias("source_extractors"))


@_query("""WITH f AS (SELECT DISTINCT sha256(text) AS h FROM documents), st AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id)), o AS (SELECT DISTINCT sha256(html) AS h FROM pages UNION SELECT DISTINCT sha256(text) FROM documents WHERE lang = 'fr'), bk AS (SELECT h FROM o WHERE h NOT IN (SELECT h FROM st)), af AS (SELECT h FROM st UNION SELECT h FROM f UNION SELECT h FROM bk)
SELECT (SELECT count(*) FROM documents) AS found, (SELECT count(*) FROM f) AS unique_files, (SELECT count(*) FROM f WHERE h NOT IN (SELECT h FROM st)) AS new_files, (SELECT count(*) FROM f WHERE h IN (SELECT h FROM st)) AS already_stored, (SELECT count(*) FROM bk) AS only_in_library, (SELECT count(*) FROM af WHERE h NOT IN (SELECT h FROM o)) AS not_linked, (SELECT count(*) FROM documents) - (SELECT count(*) FROM f) AS duplicates""")
def reconcile_summary(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_sha256"))
    other = _t(spark, sf_dir, "pages").select(F.sha2("html", 256).alias("content_sha256")).union(docs.filter("lang = 'fr'").select("content_sha256"))
    return reconcile.reconcile(docs.select("content_sha256"), docs.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi").select("content_sha256"), other)


@_query("SELECT url AS path FROM pages WHERE url NOT IN (SELECT url FROM pages JOIN labels ON page_id = doc_id)")
def incremental_antijoin(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    done = pages.join(_t(spark, sf_dir, "labels"), F.col("page_id") == F.col("doc_id"), "left_semi")
    return remaining(pages.select("path"), done.select("path"))


# ---- experiments and topics

_RESULTS_SQL = f"{_vec_sql('cosine', k=10, name='hc')}, {_vec_sql('l2', k=10, name='hl')}, {_vec_sql('cosine', 'label < 5', 10, 'hf')}, res AS (SELECT 'cosine' AS experiment_id, query_id AS query, chunk_id AS doc_id, similarity FROM hc UNION ALL SELECT 'l2', query_id, chunk_id, similarity FROM hl UNION ALL SELECT 'few', query_id, chunk_id, similarity FROM hf WHERE query_id < 3)"


def _results(spark, sf_dir) -> DataFrame:
    cols = lambda df, name: df.select(F.lit(name).alias("experiment_id"), F.col("query_id").alias("query"), F.col("chunk_id").alias("doc_id"), "similarity")
    return cols(_hits(spark, sf_dir, k=10), "cosine").union(cols(_hits(spark, sf_dir, "l2", 10), "l2")).union(cols(_hits(spark, sf_dir, k=10, where=F.col("doc_id") < 5).filter("query_id < 3"), "few"))


@_query(f"WITH {_RESULTS_SQL} SELECT experiment_id, round(avg(s), 6) AS avg_similarity FROM (SELECT experiment_id, query, avg(similarity) AS s FROM res GROUP BY ALL) GROUP BY ALL")
def experiment_avg_similarity(spark, sf_dir):
    return _rounded(experiments.average_similarity(_results(spark, sf_dir)), "avg_similarity")


@_query(f"WITH {_RESULTS_SQL}, b AS (SELECT query, doc_id FROM res WHERE experiment_id = 'cosine'), n AS (SELECT query, count(*) AS n FROM b GROUP BY query), e AS (SELECT DISTINCT experiment_id FROM res) SELECT experiment_id, round(avg(coalesce(k, 0) / n::DOUBLE), 6) AS result_overlap FROM e CROSS JOIN n LEFT JOIN (SELECT experiment_id, query, count(*) AS k FROM res JOIN b USING (query, doc_id) GROUP BY ALL) k USING (experiment_id, query) GROUP BY ALL")
def experiment_overlap(spark, sf_dir):
    return experiments.overlap(_results(spark, sf_dir), "cosine")


@_query(f"WITH {_RESULTS_SQL}, a AS (SELECT DISTINCT experiment_id, q.query_id AS query FROM res, {_ASKED_SQL.replace('asked(', 'q(')}) SELECT experiment_id, round(avg(CASE WHEN r.query IS NULL THEN 0 ELSE 1 END), 6) AS query_coverage FROM a LEFT JOIN (SELECT DISTINCT experiment_id, query FROM res) r USING (experiment_id, query) GROUP BY ALL")
def query_coverage(spark, sf_dir):
    results = _results(spark, sf_dir)
    asked = results.select("experiment_id").distinct().crossJoin(_asked(spark).select(F.col("query_id").alias("query")))
    return experiments.coverage(asked, results)


_STOPS_SQL = ", ".join(f"'{w}'" for w in topics.STOP_WORDS)


@_query(f"""WITH w AS (SELECT lang AS topic_id, doc_id, unnest({_TOKENS_SQL}) AS term FROM documents), p AS (SELECT topic_id, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w WHERE length(term) > 1 AND term NOT IN ({_STOPS_SQL}) GROUP BY ALL), t AS (SELECT term, sum(tf) AS f FROM p GROUP BY term HAVING sum(df) >= 2), k AS (SELECT topic_id, term, tf, f FROM p JOIN t USING (term)), z AS (SELECT topic_id, sum(tf) AS words FROM k GROUP BY ALL), m AS (SELECT avg(words) AS mean FROM z),
r AS (SELECT topic_id, term, round(tf / words * ln(1 + mean / f), 6) AS weight FROM k JOIN z USING (topic_id), m) SELECT topic_id, rank, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM r) WHERE rank <= 5""")
def ctfidf_terms(spark, sf_dir):
    weights = topics.class_tfidf(_t(spark, sf_dir, "documents").select(F.col("lang").alias("topic_id"), "doc_id", "text"))
    return topics.topic_words(weights, 5, 6).select("topic_id", "rank", "term", "weight")


@_query()
def topic_assignment(spark, sf_dir):
    """Clusters of the pooled vectors (no SQL says them)."""
    pooled = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return topics.assign_topics(pooled, 10)


@_query("SELECT CASE WHEN lang = 'en' THEN 'grobid' ELSE 'xmp' END AS method, count(*) FILTER (n_chars > 1000) AS titles, count(*) FILTER (source = 'src1') AS abstracts FROM documents GROUP BY ALL UNION ALL SELECT 'any', count(*) FILTER (n_chars > 1000), count(*) FILTER (source = 'src1') FROM documents")
def method_coverage(spark, sf_dir):
    method = F.when(F.col("lang") == "en", "grobid").otherwise("xmp")
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_sha256"), method.alias("method"), F.when(F.col("n_chars") > 1000, "t").alias("title"), F.when(F.col("source") == "src1", "a").alias("abstract"))
    return experiments.method_coverage(rows)


# ---- changes to tables, ingest, staging

@_query("SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS inserted FROM documents")
def insert_if_absent(spark, sf_dir):
    return dml.inserted_flags(_t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@_query("SELECT count(*) FILTER (lang = 'fr') AS deleted, count(*) FILTER (lang <> 'fr') AS kept FROM documents")
def delete_counts(spark, sf_dir):
    return dml.delete_counts(_t(spark, sf_dir, "documents"), F.col("lang") == "fr")


@_query("SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'O' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY ALL")
def point_update(spark, sf_dir):
    orders = dml.update_where(_t(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000), {"o_orderstatus": F.lit("O")})
    return orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS documents, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P') AS extractions")
def cascade_removal(spark, sf_dir):
    docs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("content_hash"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    left = dml.cascade_delete(docs, lines, lines, spark.createDataFrame([("P",)], "content_hash string"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(left[0], "documents").crossJoin(F.broadcast(count(left[1], "extractions")))


@_query("SELECT d.doc_id, coalesce(l.name, d.source) AS pdf_name, l.name IS NOT NULL AND l.name <> d.source AS changed FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'new' ELSE 'src0' END AS name FROM labels) l USING (doc_id)")
def renamed_chunks(spark, sf_dir):
    names_now = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_sha256"), F.when(F.col("quality") == 1, "new").otherwise("src0").alias("display_name"))
    return dml.renamed(_t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("pdf_name")), names_now)


@_query("""WITH s AS (SELECT source || '/' || doc_id AS path, CASE WHEN lang = 'es' THEN 0 ELSE n_chars END AS length, sha256(text) AS h FROM documents), st AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 0), f AS (SELECT h, min(path) AS p FROM s WHERE length > 0 GROUP BY h)
SELECT path, CASE WHEN length = 0 THEN 'failed' WHEN h IN (SELECT h FROM st) OR path <> p THEN 'duplicate' ELSE 'new' END AS outcome FROM s LEFT JOIN f USING (h)""")
def ingest_outcomes(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("lang") == "es", 0).otherwise(F.col("n_chars")).alias("length"), F.sha2("text", 256).alias("content_sha256"))
    stored = docs.join(_t(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "left_semi")
    return reconcile.ingest_classes(docs, stored).select("path", "outcome")


@_query(f"WITH s AS {_SOURCES_SQL} SELECT id AS content_sha256, count(title) > 0 AND count(year) > 0 AND count(journal) > 0 AS all_filled FROM s GROUP BY id")
def all_fields_filled(spark, sf_dir):
    docs, labels, pages = (_t(spark, sf_dir, n) for n in ("documents", "labels", "pages"))
    none = lambda kind: F.lit(None).cast(kind)
    g = docs.join(labels, "doc_id").select(F.col("doc_id").alias("content_sha256"), F.when(F.col("quality") == 1, F.col("source")).alias("title"), none("int").alias("year"), F.when(F.col("toxic") == 1, F.col("lang")).alias("journal"))
    a = docs.select(F.col("doc_id").alias("content_sha256"), F.col("lang").alias("title"), F.col("n_chars").cast("int").alias("year"), F.col("source").alias("journal"))
    x = pages.select(F.col("page_id").alias("content_sha256"), F.col("url").alias("title"), F.lit(1999).alias("year"), none("string").alias("journal"))
    return reconcile.all_filled(g.union(a).union(x), ["title", "year", "journal"])


@_query("""WITH f AS (SELECT doc_id, lang || '.pdf' AS name, sha256(text)[1:8] AS h8 FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS n, row_number() OVER (PARTITION BY name, h8 ORDER BY doc_id) AS k FROM f), q AS (SELECT *, k - CASE WHEN min(n) OVER (PARTITION BY name, h8) = 1 THEN 1 ELSE 0 END AS j FROM r)
SELECT doc_id, CASE WHEN n = 1 THEN name ELSE replace(name, '.pdf', '') || '_' || h8 || CASE WHEN j > 1 THEN '_' || j ELSE '' END || '.pdf' END AS staged_name FROM q""")
def staged_names(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("lang"), F.lit(".pdf")).alias("original_filename"), F.sha2("text", 256).alias("content_sha256"), F.col("doc_id").alias("seq"))
    return reconcile.staged_names(docs).select("doc_id", "staged_name")


@_query("WITH b AS (SELECT sha256(text) AS h, source AS path, 0 AS o FROM documents WHERE lang = 'en' UNION ALL SELECT sha256(text), lang, 1 FROM documents) SELECT h AS content_sha256, arg_min(path, (o, path)) AS path FROM b GROUP BY h")
def copy_plan(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_sha256"), "source", "lang")
    forward = docs.filter("lang = 'en'").select("content_sha256", F.col("source").alias("path"))
    return reconcile.copy_plan(forward, docs.select("content_sha256", F.col("lang").alias("path")))


@_query("SELECT user_id AS content_sha256, arg_max(event_type, (CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END, lpad(event_id::VARCHAR, 9, '0'))) AS tool, arg_max(lpad(event_id::VARCHAR, 9, '0'), (CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END, lpad(event_id::VARCHAR, 9, '0'))) AS path FROM events GROUP BY user_id")
def newest_extraction(spark, sf_dir):
    from folioscope.sources.files import newest_extraction as newest

    return newest(_t(spark, sf_dir, "events").select(F.col("user_id").alias("content_sha256"), F.col("event_type").alias("tool"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("path")), ["purchase", "click"])


@_query("SELECT o_orderkey, 'T' || o_custkey AS title, 'A' || o_orderstatus || ' F,G' AS authors, year(o_orderdate)::INTEGER AS year, o_orderpriority AS journal, 'journal-article' AS doc_type FROM orders")
def crossref_projection(spark, sf_dir):
    from folioscope.functions.responses import crossref

    o = _t(spark, sf_dir, "orders")
    answer = F.format_string('{"message": {"title": ["T%d"], "author": [{"given": "A%s", "family": "F"}, {"family": "G"}, {"given": "x"}], "published": {"date-parts": [[%d, 1]]}, "container-title": ["%s"], "type": "journal-article"}}', "o_custkey", "o_orderstatus", F.year("o_orderdate"), "o_orderpriority")
    return o.select("o_orderkey", crossref(answer).alias("m")).select("o_orderkey", "m.*").withColumn("authors", F.array_join("authors", ","))


@_query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS events FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    """Hourly events per user as a stream with a watermark that lets every row of the table in."""
    events = _t(spark, sf_dir, "events")
    path = work_path(spark, "windows")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = incremental.windowed_counts(stream, "ts", "3650 days", "1 hour", "user_id")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/table/v={number:012d}")

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = incremental.current(spark, f"{path}/table", "window_start timestamp, user_id long, events long")
    return out.withColumn("window_start", F.col("window_start").cast(events.schema["ts"].dataType))


@_query("SELECT doc_id, lang, n_chars FROM documents WHERE source IN ('src1', 'src5', 'src19')")
def lookup_in_list(spark, sf_dir):
    return catalog.lookup(_t(spark, sf_dir, "documents"), "source", ["src1", "src5", "src19"], "n_chars").select("doc_id", "lang", "n_chars")


@_query("SELECT doc_id AS content_sha256, quality FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
def approved_files(spark, sf_dir):
    decided = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_sha256"), F.when(F.col("toxic") == 0, "approved").otherwise("rejected").alias("decision"), F.col("quality").alias("decided_at"))
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_sha256"))
    return catalog.approved(decided.join(files, "content_sha256", "left_semi")).select("content_sha256", F.col("decided_at").alias("quality"))


@_query("SELECT doc_id AS content_sha256, CASE WHEN toxic IS NULL THEN 'undecided' WHEN toxic = 0 THEN 'approved' ELSE 'rejected' END AS decision FROM documents LEFT JOIN labels USING (doc_id)")
def triage_scan(spark, sf_dir):
    from folioscope.sources.files import with_decisions

    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_sha256"), F.col("n_chars").alias("modificationTime"), F.col("source").alias("path"))
    decided = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_sha256"), F.when(F.col("toxic") == 0, "approved").otherwise("rejected").alias("decision"))
    return with_decisions(files, decided).select("content_sha256", "decision")


@_query("SELECT lang AS project_id, count(*) AS documents, sum(n_chars)::BIGINT AS chunks, min(doc_id) AS first_added, max(doc_id) AS last_added FROM documents GROUP BY lang")
def project_stats(spark, sf_dir):
    return experiments.project_stats(_t(spark, sf_dir, "documents").select(F.col("lang").alias("project_id"), F.col("n_chars").alias("chunk_count"), F.col("doc_id").alias("added_date")))


@_query("""WITH w AS (SELECT conv_id, turn // 3 AS k, min(turn) + 1 AS first, max(turn) + 1 AS last, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY ALL)
SELECT conv_id::VARCHAR AS path, coalesce(string_agg(chr(10) || chr(10) || '<!-- Pages ' || first || '-' || last || ' -->' || chr(10) || chr(10) || chr(10) || t, chr(10) ORDER BY first) FILTER (length(t) > 50), '') AS content, count(*) FILTER (length(t) > 50) AS good, count(*) FILTER (length(t) <= 50) AS failed FROM w GROUP BY conv_id""")
def stitched_extraction(spark, sf_dir):
    """Conversations as files whose pages are their turns, read three pages at a time."""
    from folioscope.plans.extraction import extract_windows, stitched

    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    files = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.encode(F.array_join(F.transform(turns, lambda x: x["text"]), "\f"), "UTF-8").alias("content"), F.count(F.lit(1)).cast("int").alias("page_count"))
    return stitched(extract_windows(files, "form_feed"))


@_query("SELECT doc_id AS content_sha256, CASE WHEN doc_id IN (SELECT page_id FROM pages) THEN 'pre-existing' WHEN toxic IS NULL THEN 'pending' WHEN toxic = 1 THEN 'failed' ELSE 'imported' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def sync_outcomes(spark, sf_dir):
    key = lambda df, c: df.select(F.col(c).alias("content_sha256"))
    tried = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_sha256"), F.when(F.col("toxic") == 1, "x").alias("error"))
    return reconcile.sync_outcomes(key(_t(spark, sf_dir, "documents"), "doc_id"), key(_t(spark, sf_dir, "pages"), "page_id"), tried)


from folioscope.plans import more_queries, store_queries  # noqa: E402,F401  (register their own)
