import random

from folioscope.operators.chunking import chunk_rows, section_chunks, section_chunks_of, with_metadata


def pages(spark, content, most=2000):
    df = spark.createDataFrame([(1, content)], "doc_id long, content string")
    return [(r.content, r.page_numbers) for r in chunk_rows(df, most=most).orderBy("chunk_index").collect()]


def brute(content, most):
    """Page chunks in plain Python over positions of the paragraphs."""
    import re

    marks = [(m.start(), int(m[1]), int(m[2])) for m in re.finditer(r"<!-- Pages (\d+)-(\d+) -->", content)]

    def page(pos):
        own = [i for i, m in enumerate(marks) if m[0] <= pos]
        if not own:
            return 1
        i = own[-1]
        end = marks[i + 1][0] if i + 1 < len(marks) else len(content)
        at, a, b = marks[i]
        if pos >= end:
            return 1
        return a if a == b else min(b, a + int((b - a + 1) * ((pos - at) / (end - at))))

    groups, now = [], ""
    for p in content.split("\n\n"):
        if now and len(now) + len(p) > most:
            groups.append(now)
            now = p
        else:
            now = f"{now}\n\n{p}" if now else p
    if now.strip():
        groups.append(now)
    out, start = [], 0
    for g in groups:
        out.append((g.strip(), sorted({page(start + int(len(g) * i / 10)) for i in range(11)}) if marks else [1]))
        start += len(g) + 2
    return out


def test_fixtures(spark):
    assert pages(spark, "Short text.") == [("Short text.", [1])] and pages(spark, "") == []
    many = pages(spark, "\n\n".join(["This is paragraph one."] * 50), 200)
    assert len(many) > 1 and all(len(t) <= 250 for t, _ in many)
    marked = pages(spark, "<!-- Pages 1-3 -->\n\n" + "A" * 90 + "\n\n<!-- Pages 4-6 -->\n\n" + "B" * 90, 100)
    assert len(marked) >= 2 and all(1 <= p <= 6 for _, ps in marked for p in ps)


def test_page_chunks_against_plain_python(spark):
    rng = random.Random(5)
    for _ in range(25):
        parts = [rng.choice(["", " ", "x" * rng.randrange(80), f"<!-- Pages {rng.randrange(9)}-{rng.randrange(9, 14)} -->", "a b\nc"]) for _ in range(rng.randrange(12))]
        content = "\n\n".join(parts)
        assert pages(spark, content, 60) == brute(content, 60), repr(content)


def test_sections():
    three = section_chunks_of("# Introduction\n\ntext\n\n# Methods\n\ntext\n\n# Results\n\ntext", 3000, 0)
    assert [h for _, h in three] == [["Introduction"], ["Methods"], ["Results"]]
    assert [h for _, h in section_chunks_of("## Background\nx\n### Deep\ny\n## Approach\nz", 3000, 0)] == [["Background"], ["Approach"]]
    long = section_chunks_of("# Long Section\n\n" + "\n\n".join(["Word " * 100] * 10), 1500)
    assert len(long) > 1 and all(h == ["Long Section"] and "Long Section" in t and len(t) <= 1700 for t, h in long)
    assert long[0][0].count("# Long Section") == 2
    assert section_chunks_of("no headings here") == [("no headings here", [])] and section_chunks_of("") == []
    assert section_chunks_of("## **Introduction**\n\nx", 3000, 0)[0][1] == ["Introduction"]
    assert section_chunks_of("pre\n\n# A\n\nb", 3000, 0)[0] == ("pre", [])
    merged = section_chunks_of("# A\n\nx\n\n# B\n\n" + "y" * 300 + "\n\n# C\n\nz", 3000, 200)
    assert len(merged) == 1 and merged[0][1] == ["B"] and merged[0][0].startswith("# A") and merged[0][0].endswith("z")
    assert section_chunks_of("# A\n\nx", 3000, 200) == [("# A\n\nx", ["A"])]


def test_section_rows_and_metadata(spark):
    df = spark.createDataFrame([("d", "# A\n\n$x$ and \\[y\\]\n\n# B\n\nplain")], "doc_id string, content string")
    rows = with_metadata(section_chunks(df, least=0), 10).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.section, r.display_eq_count, r.inline_eq_count, r.has_equations, r.chunk_length) for r in rows] == [(10, ["A"], 1, 1, True, len(rows[0].content)), (11, ["B"], 0, 0, False, len("# B\n\nplain"))]


def test_thousands_of_page_marks_take_no_more_than_their_share(spark):
    import time

    from folioscope.operators.chunking import page_chunks_of

    content = "\n\n".join(f"<!-- Pages {i}-{i + 1} -->\n\n" + f"paragraph {i} of some length. " * 20 for i in range(1, 4001))
    start = time.monotonic()
    got = list(page_chunks_of(content, 1000))
    assert time.monotonic() - start < 2 and len(got) > 2000
    assert got == brute(content, 1000)
    rows = chunk_rows(spark.createDataFrame([(1, content), (2, None), (3, "x")], "doc_id long, content string"), most=1000).collect()
    assert [(r.content, r.page_numbers) for r in sorted(rows) if r.doc_id == 1] == got and len(rows) == len(got) + 1


def test_chunks_of_a_long_document_come_in_several_batches(spark, monkeypatch):
    from folioscope.operators import chunking

    monkeypatch.setattr(chunking, "BATCH_CHARS", 500)
    df = spark.createDataFrame([(1, "\n\n".join(f"# Part {i}\n\n" + "word " * 30 for i in range(40)))], "doc_id long, content string")
    want = chunking.section_chunks_of(df.first().content, 400, 100)
    assert [(r.content, r.section) for r in chunking.section_chunks(df, most=400, least=100).orderBy("chunk_index").collect()] == want
