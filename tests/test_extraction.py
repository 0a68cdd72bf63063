import pytest

from folioscope.plans.extraction import converted, extract_windows, register_page_reader, stitched, with_header


def test_a_bad_window_costs_only_its_pages(spark):
    def reader():
        def read(data, first, last):
            if b"boom" in data.split(b"\f")[first - 1]:
                raise RuntimeError("bad page")
            return "".join(x.decode() for x in data.split(b"\f")[first - 1 : last])

        return read

    register_page_reader("fragile", reader)
    page = lambda c: c * 60
    files = spark.createDataFrame([("/x/a.pdf", bytearray("\f".join([page("a"), page("b"), "boom", "d", page("e")]).encode()), 5), ("/x/b.pdf", bytearray(b"boom"), 1)], "path string, content binary, page_count int")
    windows = extract_windows(files, "fragile", step=1).cache()
    assert [(r.first, r.error) for r in windows.filter("path like '%a.pdf' and error is not null").orderBy("first").collect()] == [(3, "RuntimeError: bad page"), (4, "Empty or insufficient content")]
    rows = {r.path[-5:]: r for r in with_header(stitched(windows), files).collect()}
    assert (rows["a.pdf"].good, rows["a.pdf"].failed) == (3, 2) and rows["b.pdf"].content == ""
    body = "\n".join(f"\n\n<!-- Pages {i}-{i} -->\n\n\n{page(c)}" for i, c in ((1, "a"), (2, "b"), (5, "e")))
    assert rows["a.pdf"].content == "<!-- Extraction of a.pdf -->\n<!-- Actual page count: 5 -->\n<!-- Successful chunks: 3 -->\n<!-- Failed chunks: 2 -->\n\n" + body
    assert extract_windows(files.limit(0), "fragile").count() == 0
    cut = extract_windows(files, "fragile", step=1, most=1).filter("error LIKE 'Not read%'")
    assert cut.count() == files.filter("page_count > 1").count() > 0
    with pytest.raises(ValueError, match="fragile"):
        extract_windows(files, "none")


def test_converted_parts_count_images_through(spark):
    parts = spark.createDataFrame([("p", 10, "![](_page_1_P.png)"), ("p", 0, "![](_page_1_P.png)")], "path string, first_page int, text string")
    assert converted(parts).first().content == "![](_page_1_P.png)\n\n![](_page_11_P.png)"


def test_unknown_page_counts_lose_nothing_without_a_word(spark):
    text = "\f".join("word " * 20 for _ in range(7))
    files = spark.createDataFrame([("long", bytearray(text.encode()), None), ("short", bytearray(b"page " * 30), None), ("known", bytearray(text.encode()), 7)], "path string, content binary, page_count int")
    rows = extract_windows(files, "form_feed", step=2, most=4).filter("error LIKE 'Not read%'").collect()
    assert sorted((r.path, r.first, r.last) for r in rows) == [("known", 5, 7), ("long", 5, None)]
