import pytest
from pyspark.sql import functions as F

from folioscope.functions import names, responses, text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()[0]


c = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """Columns need a session."""
    global c
    c = F.col("c")


@pytest.mark.parametrize(
    "source, want",
    [("Hello World", ["hello", "world"]), (r"\lambda x_i A^n", [r"\lambda", "x_i", "a^n"]), ("", []), ("a,b;(c) [d] {e} 'f' \"g\": h-i.j", list("abcdefg") + ["h-i.j"])],
)
def test_tokens(spark, source, want):
    assert one(spark, text.tokens(c), c=source) == want


def test_equations(spark):
    e = one(spark, text.equation_counts(c), c=r"\[E = mc^2\]")
    assert (e.display_eq_count, e.inline_eq_count, e.has_equations) == (1, 0, True)
    assert one(spark, text.display_equations(c), c="\\[a\nb\\] \\[c\\]") == ["a\nb", "c"]
    assert one(spark, text.inline_equations(c), c=r"$\alpha + \beta = \gamma$") == [r"\alpha + \beta = \gamma"]
    assert one(spark, text.inline_equations(c), c="$$x$$") == ["", ""]


@pytest.mark.parametrize("source, want", [("_page_0_Picture_0.jpeg", [1]), ('id="page-14-2"', [15]), ("(#page-14-0)", []), ('_page_5_x_page_3_y id="page-3-0"', [4, 6])])
def test_page_references(spark, source, want):
    assert one(spark, text.page_references(c), c=source) == want


def test_cleaned(spark):
    assert one(spark, text.cleaned(c), c="Line one\n\n\n\nLine two with  multiple   spaces") == "Line one\n\nLine two with multiple spaces"
    assert one(spark, text.cleaned(c), c="text\n12\nmore “q” ‘s’\n13") == "text\nmore \"q\" 's'"


def test_ids(spark):
    assert [one(spark, text.arxiv_id(c), c=x) for x in ("2506.06542v1.pdf", "1501.03291.pdf", "regular_paper.pdf")] == ["2506.06542v1", "1501.03291", None]
    assert one(spark, text.arxiv_base_id(c), c="2506.06542v12.pdf") == "2506.06542"
    assert one(spark, text.doi_lenient(c), c="see DOI: 10.1000/test.doi.12345") == "10.1000/test.doi.12345"
    assert one(spark, text.doi_lenient(c), c="none") is None
    assert one(spark, text.doi_strict(c), c="(10.1234/ab.c).;") == "10.1234/ab.c"
    assert one(spark, text.doi_any(c), c='bare 10.1111/a, then https://doi.org/10.2222/b."') == "10.2222/b"
    assert one(spark, text.arxiv_any(c), c="arXiv:hep-th/9901001") == "hep-th/9901001"


def test_labels_and_ranges(spark):
    label = text.error_label(c, F.lit(1), F.lit(3))
    assert one(spark, label, c="IndexError: list index out of range") == "Dataloader error (pages 1-3)"
    assert one(spark, label, c="") == "No error output (pages 1-3)" and one(spark, label, c="x") == "Unknown error (pages 1-3)"
    assert one(spark, text.page_ranges(F.col("n"), 3), n=7) == ["0-2", "3-5", "6-6"] and one(spark, text.page_ranges(F.col("n"), 3), n=0) == []
    assert one(spark, text.json_slice(c), c='say {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert one(spark, text.shifted_page_images(c, F.lit(10)), c="a _page_2_F.png b _page_11_G _page_x_") == "a _page_12_F.png b _page_21_G _page_x_"
    assert one(spark, text.preview(c, 3), c="abcd") == "abc..." and one(spark, text.preview(c, 4), c="abcd") == "abcd"


SHA = "0006d958c6c7" + "0" * 52


@pytest.mark.parametrize(
    "authors, year, title, want",
    [(["John Smith"], 2023, "Deep Learning", "smith-2023-deep"), ([], 2023, "Deep Learning", "unknown-2023-deep"), (["John Smith"], 0, "Deep", "smith-nodate-deep"), (["A B"], 2020, "The Deep Method", "b-2020-deep"), (["Müller, Hans"], 2021, "Neural", "muller-2021-neural"), (["Hans Müller"], 2021, "", "muller-2021-untitled")],
)
def test_citation_key(spark, authors, year, title, want):
    got = one(spark, names.citation_key(F.col("a"), F.col("y"), F.col("t"), F.lit(SHA)), a=authors, y=year, t=title)
    assert got == f"{want}-{SHA[:12]}"


def test_bib_entry(spark):
    got = one(spark, names.bib_entry(F.lit("k"), F.lit("proceedings-article"), F.col("a"), F.lit(2020), c, F.lit("Conf {X}"), F.lit(None).cast("string")), a=["A B", "C D"], c="T\\x")
    assert got == "@inproceedings{k,\n  author = {A B and C D},\n  booktitle = {Conf \\{X\\}},\n  title = {T\\\\x},\n  year = {2020},\n}\n"


def test_names(spark):
    assert one(spark, names.safe_filename(c), c="a/b: c") == "a b c.pdf" and one(spark, names.safe_filename(c), c="???") == "document.pdf"
    long = one(spark, names.safe_filename(c), c="x" * 115 + " yyyyyyy")
    assert long == "x" * 115 + ".pdf"
    assert [one(spark, names.last_name(c), c=x) for x in ("Ann Lee and Bo Chi", "Lee; Chi", " ", "Anders Sandler")] == ["Lee", "Lee", None, "Sandler"]
    assert one(spark, names.name_from_text(c), c="\n A  Title \nAnn Lee, Bo\nIn 1999 and 2001") == "Lee 1999 A Title"
    null = F.lit(None).cast("string")
    assert one(spark, names.display_name(null, F.lit(None).cast("int"), null, null, c), c="file.PDF") == "file.PDF"
    assert one(spark, names.doc_label(c), c="A - 2020 - T - x") == "A | 2020 | T - x" and one(spark, names.doc_label(c), c="A - B") == "A - B"
    assert one(spark, names.file_link(c, F.array(F.lit(4))), c="/a b/ü+~.pdf") == "file:///a%20b/%C3%BC%2B~.pdf#page=4"
    assert [one(spark, names.human_bytes(F.col("n")), n=x) for x in (12, 1280, 1536, 5 << 30, 3 << 50)] == ["12 B", "1.2 KB", "1.5 KB", "5.0 GB", "3072.0 TB"]
    assert one(spark, names.author_list(F.col("a")), a=["a", "b", "c", "d"]) == "a, b, c et al."
    assert one(spark, names.storage_id(c), c="/h/Zotero/storage/AB12/x.pdf") == "AB12" and one(spark, names.storage_id(c), c="/x") is None
    assert [one(spark, names.source_type(c), c=x) for x in ("/Zotero/storage/x", "/Dropbox/x", "/x")] == ["zotero", "dropbox", "local"]
    assert one(spark, names.valid_sha256(c), c=SHA.upper()) == SHA and one(spark, names.valid_sha256(c), c="zz") is None
    lines = one(spark, names.metadata_lines(F.array(F.lit("A")), F.lit("T"), F.lit(None), F.lit(None), c, F.lit(3)), c="J")
    assert tuple(lines) == ('A, "T"', "unknown, unknown, J, 3")
    assert tuple(one(spark, names.filename_metadata(c), c="Smith2023_MachineLearning.pdf")) == (["Smith"], 2023)
    assert tuple(one(spark, names.filename_metadata(c), c="2301.12345v1.pdf")) == (None, None)
    page = one(spark, names.first_page_metadata(c), c="HEADER OF THE PAGE\nA proper title line\nJohn Smith and J. Doe\nPublished in Annals of Things\n2019")
    assert (page.title, page.authors, page.year, page.journal) == ("A proper title line", ["John Smith", "J. Doe"], 2019, "Annals of Things")
    assert one(spark, names.pdf_date_year(c, F.lit("D:2011")), c="D:20210101") == 2021 and one(spark, names.pdf_date_year(c, F.lit("D:2011")), c="bad") == 2011


def test_responses(spark):
    doc = '{"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}, {"given": "x"}], "published-print": {"date-parts": [[2019, 2]]}, "container-title": ["J"], "type": "journal-article"}}'
    assert tuple(one(spark, responses.crossref(c), c=doc)) == ("T", ["A B", "C"], 2019, "J", "journal-article")
    assert tuple(one(spark, responses.scholar(c), c='{"title": "T", "authors": [{"name": "A"}, {"name": null}], "year": 2020, "venue": ""}')) == ("T", ["A"], 2020, None, None)
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Ti</title></titleStmt><publicationStmt><date when="2018-03-01"/></publicationStmt><sourceDesc><biblStruct><analytic><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author><author><persName><forename>Bo</forename><surname>Chi</surname></persName></author></analytic><monogr><title level="j">Jo</title></monogr></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>One.</p><p> Two. </p></abstract></profileDesc></teiHeader></TEI>'
    assert tuple(one(spark, responses.grobid(c), c=tei)) == ("Ti", ["Ann Lee", "Bo Chi"], 2018, "Jo", "One. Two.")
    xmp = '<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><rdf:RDF><rdf:Description><dc:title><rdf:Alt><rdf:li>XT</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>A B</rdf:li><rdf:li>C D</rdf:li></rdf:Seq></dc:creator><dc:identifier>https://arxiv.org/abs/2505.23302v1</dc:identifier><dc:identifier>doi:10.1234/x.y.</dc:identifier></rdf:Description></rdf:RDF></x:xmpmeta>'
    assert tuple(one(spark, responses.xmp(c), c=xmp)) == ("XT", ["A B", "C D"], "10.1234/x.y", "2505.23302v1")
    assert one(spark, responses.authors_from_json(responses.authors_to_json(F.col("a"))), a=["Smith, J", "B"]) == ["Smith, J", "B"]


def test_times_beyond_the_year_9999(spark):
    """As DuckDB's strftime writes them: no sign before a year of five digits."""
    far = 5_999_999 * 86399
    assert one(spark, names.epoch_text(c), c=far) == "18397-04-01 13:20:01"
    assert one(spark, names.local_minute(F.timestamp_seconds(c), "+02:00"), c=far) == "18397-04-01 15:20"
    assert one(spark, names.epoch_text(c), c=86399) == "1970-01-01 23:59:59"
