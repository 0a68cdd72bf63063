import hashlib
import re

from folioscope.llm.fill_in_middle import fill_in_middle, restored
from folioscope.llm.queries import QUERIES

TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\r\nb\rc\n", "é\n日本\n😀 x\n", "has <P> in it\n", "<S", "x<M>", "<\n<S\n>\nP>\n", "same\nrows\n", "same\nrows\n", "l\n" * 20_000 + "end", "y" * 300_000]


def frame(spark, texts):
    rows = [(i, t, "clash", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, n int")


def by_hand(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_texts_equal_the_definition_and_come_back(spark):
    texts = TEXTS * 6
    out = fill_in_middle(frame(spark, texts).repartition(5))
    rows = out.select("*", restored(out.output, out.form).alias("back")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, texts[r.doc_id])
        assert r.back == (texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_whole_query_equals_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_fill_in_middle"](spark, sf).collect()}
    want = {i: (*by_hand(i, t)[:4], sha(by_hand(i, t)[4]), sha(t or "")) for i, t in texts.items()}
    assert got == want


def test_shares_empty_tables_null_and_repeated_ids(spark):
    assert fill_in_middle(frame(spark, [])).count() == 0
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('line\n', 8) AS text")
    assert {r.form for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(docs, spm_share=0).collect()} == {"psm"}
    share = fill_in_middle(docs, rate=30).filter("form <> 'plain'").count() / 2000
    assert 0.25 < share < 0.35
    twice = spark.createDataFrame([(None, "a\nb"), (None, "a\nb"), (3, "a\nb"), (3, "a\nb")], "doc_id long, text string")
    rows = fill_in_middle(twice).collect()
    assert len(rows) == 4 and len(set(rows)) == 2
