"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Pages of an archive; by page id: records held twice, and the replica's altered, lost, repeated and added ones.
ARCHIVE_PAGES, TWICE, CORRUPT, MISSING, REPEATED, ADDED = 2000, (887, 19), (101, 7), (503, 11), (701, 13), (811, 17)
ADDED_ID = 1_000_000_000


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the pages against a replica in which some records are altered, lost, repeated and added:
    a row for each archive, and one for each damaged record."""
    from folioscope.llm.warc import fixity_report, record_table, replica_table

    is_one = lambda of: F.col("page_id") % of[0] == of[1]
    archive = F.floor(F.col("page_id") % ADDED_ID / ARCHIVE_PAGES)
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pages = pages.union(pages.filter(is_one(TWICE)))
    index = record_table(pages, archive)
    altered = F.when(is_one(CORRUPT), F.concat(F.lit("#"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    kept = pages.filter(~is_one(MISSING)).withColumn("html", altered)
    added = kept.filter(is_one(ADDED)).withColumn("page_id", F.col("page_id") + ADDED_ID)
    replica = kept.union(kept.filter(is_one(REPEATED))).union(added)
    report, damaged = fixity_report(index, replica_table(replica, index, archive))
    state = F.when(F.col("intact"), "intact").otherwise("differs").alias("state")
    report = report.select("archive", F.lit(None).cast("long").alias("record_id"), F.lit(None).cast("long").alias("offset"), state, "n_records", "n_bytes", "root_a", "root_b", "n_ranges_differ", "n_damaged")
    return report.unionByName(damaged, allowMissingColumns=True)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / language / hundred of ids; every fiftieth is a licence file,
    of its directory or of one above it."""
    from folioscope.llm.licenses import licenses

    docs = _table(spark, sf_dir, "documents")
    i, top, mid = F.col("doc_id"), F.col("source"), F.concat_ws("/", "source", "lang")
    low = F.concat_ws("/", mid, F.floor(i / 100).cast("string"))
    licence = F.concat(F.lit("/LICENSE."), i.cast("string"))
    path = F.when(i % 200 == 0, F.concat(top, licence)).when(i % 100 == 0, F.concat(mid, licence)).when(i % 50 == 0, F.concat(low, licence)).otherwise(F.concat(low, F.lit("/"), i.cast("string"), F.lit(".txt")))
    return licenses(docs.select("doc_id", path.alias("path"), "text")).withColumn("own_score", F.round("own_score", 6))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 2, spaced=True)


def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.divergence import quality

    return quality(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 2, spaced=False)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.contamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.secrets import secrets

    return secrets(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.wrapper import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.fill_in_middle import fill_in_middle, restored

    out = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_group_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.alignment import alignment

    return alignment(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioscope.llm.byte_bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_distribution_divergence": op4_distribution_divergence,
    "op5_token_files": op5_token_files,
    "op6_order_minhash": op6_order_minhash,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_wrapper_induction": op10_wrapper_induction,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_group_alignment": op12_group_alignment,
    "op13_byte_bpe": op13_byte_bpe,
}


def _warc_sql() -> str:
    from folioscope.llm.warc import FAN_OUT, LEVELS, RANGE_BYTES

    crlf = "chr(13) || chr(10)"

    def record(body: str) -> str:
        lines = ["'WARC/1.0'", "'WARC-Type: response'", "'WARC-Record-ID: <urn:record:' || page_id || '>'", "'WARC-Target-URI: ' || coalesce(url, '')", "'Content-Type: text/html'", f"'Content-Length: ' || strlen({body})", "''", body, "''"]
        return f" || {crlf} || ".join(lines) + f" || {crlf}"

    is_one = lambda of: f"page_id % {of[0]} = {of[1]}"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    parts = [
        f"p AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM pages WHERE {is_one(TWICE)})",
        f"h AS (SELECT page_id // {ARCHIVE_PAGES} AS archive, page_id AS id, strlen({record('html')}) AS len, sha256({record('html')}) AS sha FROM p)",
        f"a AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY archive ORDER BY id, sha {before}), 0)::BIGINT AS off FROM h)",
        f"q AS (SELECT page_id, url, CASE WHEN {is_one(CORRUPT)} THEN '#' || substr(html, 2) ELSE html END AS html FROM p WHERE NOT {is_one(MISSING)})",
        f"q2 AS (SELECT * FROM q UNION ALL SELECT * FROM q WHERE {is_one(REPEATED)} UNION ALL SELECT page_id + {ADDED_ID}, url, html FROM q WHERE {is_one(ADDED)})",
        f"g AS (SELECT page_id % {ADDED_ID} // {ARCHIVE_PAGES} AS archive, page_id AS id, strlen({record('html')}) AS len, sha256({record('html')}) AS sha FROM q2)",
        "a1 AS (SELECT *, row_number() OVER (PARTITION BY archive, id, sha ORDER BY off) AS k FROM a)",
        "b1 AS (SELECT g.*, row_number() OVER (PARTITION BY archive, id, sha) AS k FROM g)",
        "b2 AS (SELECT b1.archive, b1.id, b1.len, b1.sha, a1.off FROM b1 LEFT JOIN a1 USING (archive, id, sha, k))",
        "a3 AS (SELECT archive, id, off, row_number() OVER (PARTITION BY archive, id ORDER BY off) AS k FROM a WHERE (archive, off) NOT IN (SELECT (archive, off) FROM b2 WHERE off IS NOT NULL))",
        "b3 AS (SELECT archive, id, len, sha, row_number() OVER (PARTITION BY archive, id ORDER BY sha) AS k FROM b2 WHERE off IS NULL)",
        "b4 AS (SELECT b3.archive, b3.id, b3.len, b3.sha, a3.off FROM b3 LEFT JOIN a3 USING (archive, id, k))",
        "e AS (SELECT archive, max(off + len) AS top FROM a GROUP BY archive)",
        f"b5 AS (SELECT b4.archive, id, sha, (coalesce(top, 0) + coalesce(sum(len) OVER (PARTITION BY b4.archive ORDER BY id, sha {before}), 0))::BIGINT AS off FROM b4 LEFT JOIN e USING (archive) WHERE b4.off IS NULL)",
        "b AS (SELECT archive, id, sha, off FROM b2 WHERE off IS NOT NULL UNION ALL SELECT archive, id, sha, off FROM b4 WHERE off IS NOT NULL UNION ALL SELECT archive, id, sha, off FROM b5)",
    ]
    for t in ("a", "b"):
        parts.append(f"t{t}0 AS (SELECT archive, off // {RANGE_BYTES} AS node, sha256(string_agg(off || ':' || sha, ',' ORDER BY off)) AS digest FROM {t} GROUP BY ALL)")
        parts += [f"t{t}{k} AS (SELECT archive, node // {FAN_OUT} AS node, sha256(string_agg(digest, ',' ORDER BY t{t}{k - 1}.node)) AS digest FROM t{t}{k - 1} GROUP BY archive, t{t}{k - 1}.node // {FAN_OUT})" for k in range(1, LEVELS + 1)]
    parts += [
        "w AS (SELECT archive, count(*) AS n FROM ta0 FULL JOIN tb0 USING (archive, node) WHERE ta0.digest IS DISTINCT FROM tb0.digest GROUP BY archive)",
        "d AS (SELECT archive, coalesce(a.id, b.id) AS id, off, CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'extra' ELSE 'corrupt' END AS state FROM a FULL JOIN b USING (archive, off) WHERE a.sha IS DISTINCT FROM b.sha)",
        "s AS (SELECT archive, count(*) AS n_records, sum(len)::BIGINT AS n_bytes FROM a GROUP BY archive)",
        "c AS (SELECT archive, count(*) AS n FROM d GROUP BY archive)",
    ]
    return "WITH " + ", ".join(parts) + f""" SELECT archive::VARCHAR AS archive, NULL::BIGINT AS record_id, NULL::BIGINT AS "offset", CASE WHEN ra.digest IS NOT DISTINCT FROM rb.digest THEN 'intact' ELSE 'differs' END AS state,
coalesce(n_records, 0) AS n_records, coalesce(n_bytes, 0) AS n_bytes, ra.digest AS root_a, rb.digest AS root_b, coalesce(w.n, 0) AS n_ranges_differ, coalesce(c.n, 0) AS n_damaged
FROM ta{LEVELS} ra FULL JOIN tb{LEVELS} rb USING (archive) LEFT JOIN s USING (archive) LEFT JOIN w USING (archive) LEFT JOIN c USING (archive)
UNION ALL SELECT archive::VARCHAR, id, off, state, NULL, NULL, NULL, NULL, NULL, NULL FROM d"""


def _license_sql() -> str:
    from folioscope.llm.licenses import LEAST, SENTENCE_END, TEMPLATES

    quote = lambda t: t.replace("'", "''")
    listed = ", ".join(f"('{n}', {i}, '{quote(t)}')" for n, ts in sorted(TEMPLATES.items()) for i, t in enumerate(ts))
    low = "source || '/' || lang || '/' || (doc_id // 100)"
    path = f"CASE WHEN doc_id % 200 = 0 THEN source || '/LICENSE.' || doc_id WHEN doc_id % 100 = 0 THEN source || '/' || lang || '/LICENSE.' || doc_id WHEN doc_id % 50 = 0 THEN {low} || '/LICENSE.' || doc_id ELSE {low} || '/' || doc_id || '.txt' END"
    return f"""WITH tpl AS (SELECT name, i, word, count(*) AS n FROM (SELECT name, i, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS word FROM (VALUES {listed}) AS v(name, i, t)) GROUP BY ALL),
f AS (SELECT doc_id, {path} AS path, text, doc_id % 50 = 0 AS is_license FROM documents), total AS (SELECT count(*) AS n_files FROM f),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM f) WHERE word IN (SELECT word FROM tpl) GROUP BY word),
idf AS (SELECT word, ln((1 + n_files) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT word FROM tpl) LEFT JOIN df USING (word), total),
tv AS (SELECT name, i, word, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY name, i)) AS x FROM tpl JOIN idf USING (word)),
part AS (SELECT doc_id, 0 AS k, unnest(string_split(text, chr(10))) AS t FROM f UNION ALL SELECT doc_id, 1, unnest(string_split_regex(text, '{SENTENCE_END}')) FROM f UNION ALL SELECT doc_id, 2, text FROM f WHERE is_license), lines AS (SELECT row_number() OVER () AS line, doc_id, t FROM part),
tok AS (SELECT line, doc_id, word, count(*) AS n FROM (SELECT line, doc_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS word FROM lines) GROUP BY ALL),
norm AS (SELECT line, sqrt(sum(CASE WHEN idf IS NULL THEN 0 ELSE (n * idf) ** 2 END) + sum(CASE WHEN idf IS NULL THEN n * n ELSE 0 END) * (ln(1 + n_files) + 1) ** 2) AS norm FROM tok LEFT JOIN idf USING (word), total GROUP BY line, n_files),
cosine AS (SELECT doc_id, line, name, i, sum(n * idf * x) / norm AS c FROM tok JOIN idf USING (word) JOIN tv USING (word) JOIN norm USING (line) GROUP BY doc_id, line, name, i, norm),
own AS (SELECT doc_id, name AS own_license, c AS own_score FROM cosine WHERE c >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 9) DESC, name) = 1),
g AS (SELECT f.doc_id, path, is_license, regexp_replace(path, '/[^/]*$', '') AS dir, own_license, coalesce(own_score, 0) AS own_score FROM f LEFT JOIN own USING (doc_id)),
stated AS (SELECT dir AS above, own_license AS license FROM g WHERE is_license AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) = 1),
near AS (SELECT g.doc_id, above, license FROM g JOIN stated ON above = '' OR g.dir = above OR starts_with(g.dir, above || '/') QUALIFY row_number() OVER (PARTITION BY g.doc_id ORDER BY length(above) DESC) = 1)
SELECT g.doc_id, path, own_license, round(own_score, 6) AS own_score, coalesce(own_license, license) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from FROM g LEFT JOIN near USING (doc_id)"""


def _divergence_sql() -> str:
    from folioscope.llm.divergence import _CLASSES, _WORDS, CHAR_LIMIT, COMMON_WORDS, MIN_WORDS, WORD_LIMIT

    ws = r"[\x20\x09-\x0D]+"
    gone = lambda p: f"length(text) - length(regexp_replace(text, '{p}', '', 'g'))"
    forms = lambda w: ", ".join(f"'{x}'" for x in sorted({w, w.capitalize(), w.upper()}))
    common = ", ".join("CASE lang " + " ".join(f"WHEN '{lang}' THEN len(list_filter(w, lambda x: x IN ({forms(listed[i])})))" for lang, listed in COMMON_WORDS.items()) + f" END AS w_{i}" for i in range(12))
    part = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END)"

    def distance(names: list[str], total: str) -> str:
        terms = []
        for c in names:
            p, q = f"({c} / nullif({total}, 0)::DOUBLE)", f"ref_{c}"
            terms.append(f"{part(p, q)} + {part(q, p)}")
        return f"CASE WHEN {total} > 0 AND ref_{names[0]} IS NOT NULL THEN sqrt(greatest((" + " + ".join(terms) + ") / 2, 0)) END"

    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    refs = ", ".join([f"sum({c}) / sum(n_bytes)::DOUBLE AS ref_{c}" for c in _CLASSES] + [f"sum({c}) / sum(n_words)::DOUBLE AS ref_{c}" for c in _WORDS])
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents), s AS (SELECT *, list_filter(string_split_regex(text, '{ws}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)), rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
f AS (SELECT s.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, {gone('[#*$%&|<>]+')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, length(text) AS n_chars, strlen(text) AS n_bytes, {gone('[A-Z]+')} AS c_upper, {gone('[0-9]+')} AS c_digit, {gone("[!\\\"''()+,\\-./:;=?@\\[\\\\\\]^_`{}~]+")} AS c_punct, {common} FROM s LEFT JOIN hit USING (doc_id)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, word_chars - c_upper - c_digit - n_symbols - c_punct AS c_rest, n_chars - word_chars AS c_space, n_symbols AS c_symbol, n_bytes - n_chars AS c_wide, n_words - ({' + '.join(f'w_{i}' for i in range(12))}) AS w_12 FROM f),
r AS (SELECT lang, {refs} FROM g WHERE lang IN ({langs}) AND NOT base_failed GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(n_words >= {MIN_WORDS} AND (({distance(_CLASSES, 'n_bytes')}) > {CHAR_LIMIT} OR ({distance(_WORDS, 'n_words')}) > {WORD_LIMIT}), FALSE) AS kept FROM g LEFT JOIN r USING (lang)"""


def _contamination_sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win), dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN win USING (n, k)), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _middle_sql() -> str:
    rank = lambda k: f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT"
    joined = lambda part: f"coalesce(array_to_string({part}, ''), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS w FROM d),
r AS (SELECT *, len(w) AS n, least({rank(0)} % (len(w) + 1), {rank(1)} % (len(w) + 1)) AS i, greatest({rank(0)} % (len(w) + 1), {rank(1)} % (len(w) + 1)) AS j,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {rank(2)} % 100 >= 100 THEN 'plain' WHEN {rank(3)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, {joined('w[1:i]')} AS prefix, {joined('w[i + 1:j]')} AS middle, {joined('w[j + 1:]')} AS suffix FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""


ORACLES: dict[str, str] = {"op1_warc_fixity": _warc_sql(), "op2_license_scan": _license_sql(), "op4_distribution_divergence": _divergence_sql(), "op7_decontamination": _contamination_sql(), "op11_fill_in_middle": _middle_sql()}
