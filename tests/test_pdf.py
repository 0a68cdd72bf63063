import random
import zlib

import pytest

from folioscope.functions.pdf import Damaged, facts_of, pdf_metadata, read


def build(objects, root=1, info=None, *, eol=b"\n", start=None):
    """A file of numbered objects with a cross-reference table."""
    out, places = b"%PDF-1.4" + eol, {}
    for n, body in objects.items():
        places[n] = len(out)
        out += f"{n} 0 obj".encode() + eol + body + eol + b"endobj" + eol
    at = len(out)
    out += b"xref" + eol + f"0 {max(places) + 1}".encode() + eol + b"0000000000 65535 f" + eol.rjust(2)
    for n in range(1, max(places) + 1):
        out += (f"{places[n]:010d} 00000 n" if n in places else "0000000000 00000 f").encode() + eol.rjust(2)
    out += b"trailer" + eol + f"<< /Size {max(places) + 1} /Root {root} 0 R".encode() + (f" /Info {info} 0 R".encode() if info else b"") + b" >>" + eol
    return out + b"startxref" + eol + str(at if start is None else start).encode() + eol + b"%%EOF" + eol


def tree(n_pages, first=2, fan=3):
    """Objects of a catalog and a nested page tree."""
    number, leaves = [first], []

    def new():
        number[0] += 1
        return number[0] - 1

    objects = {}
    top = new()

    def node(at, n, up):
        kids = []
        if n <= fan:
            for _ in range(n):
                k = new()
                objects[k] = f"<< /Type /Page /Parent {at} 0 R >>".encode()
                leaves.append(k)
                kids.append(k)
        else:
            for i in range(fan):
                k = new()
                node(k, n // fan + (i < n % fan), at)
                kids.append(k)
        objects[at] = f"<< /Type /Pages /Count {n} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()

    node(top, n_pages, None)
    objects[1] = f"<< /Type /Catalog /Pages {top} 0 R >>".encode()
    return dict(sorted(objects.items())), number[0]


INFO = rb"<< /Title (A \(nested\) t\151tle\
 goes on) /Author <416E6E2041> /Subject (Journal#of) /CreationDate (D:20150304) >>"
WANT = ("A (nested) title goes on", "Ann A", "Journal#of", "D:20150304", None)


@pytest.mark.parametrize("pages", [0, 1, 7, 40])
@pytest.mark.parametrize("eol", [b"\n", b"\r\n"])
def test_tables(pages, eol):
    objects, n = tree(pages)
    objects[n] = INFO
    whole = build(objects, info=n, eol=eol)
    assert facts_of(whole) == (*WANT, pages, None)
    # a wrong start, a cut end, bytes before it all: the objects are searched for
    assert facts_of(build(objects, info=n, eol=eol, start=3)) == (*WANT, pages, None)
    assert facts_of(whole[: whole.rfind(b"startxref")]) == (*WANT, pages, None)
    assert facts_of(b"junk\n" + whole) == (*WANT, pages, None)


def test_updates_count_from_the_last():
    objects, n = tree(2)
    objects[n] = INFO
    whole = build(objects, info=n)
    at = whole.rfind(b"xref\n0")
    more = whole + f"{n} 0 obj\n<< /Title <FEFF00C9007400E9> /ModDate (20190101) >>\nendobj\n".encode()
    end = len(more)
    more += f"xref\n{n} 1\n{len(whole):010d} 00000 n \ntrailer\n<< /Size {n + 1} /Root 1 0 R /Info {n} 0 R /Prev {at} >>\nstartxref\n{end}\n%%EOF".encode()
    assert facts_of(more) == ("Été", None, None, None, "20190101", 2, None)


def packed(pages, predictor=True, damage=False):
    """Objects in a compressed object stream, a cross-reference stream with a predictor."""
    objects, n = tree(pages)
    objects[n] = INFO
    heads, body = [], b""
    for k, v in objects.items():
        heads.append(f"{k} {len(body)}")
        body += v + b" "
    first = " ".join(heads).encode() + b" "
    inner = zlib.compress(first + body)
    out = b"%PDF-1.5\n"
    pack, xref = n + 1, n + 2
    pack_at = len(out)
    out += f"{pack} 0 obj\n<< /Type /ObjStm /N {len(objects)} /First {len(first)} /Length {len(inner)} /Filter /FlateDecode >>\nstream\n".encode() + inner + b"\nendstream\nendobj\n"
    xref_at = len(out)
    rows = [bytes([0, 0, 0, 0, 0])]
    order = list(objects)
    for k in range(1, xref + 1):
        rows.append(bytes([2]) + pack.to_bytes(3, "big") + bytes([order.index(k)]) if k in objects else bytes([1]) + (pack_at if k == pack else xref_at).to_bytes(3, "big") + b"\0")
    flat = b"".join(rows)
    if predictor:
        before, flat = bytes(5), b""
        for i, row in enumerate(rows):
            kind = (2, 1, 0, 3, 4)[i % 5]
            done = bytearray()
            for j, x in enumerate(row):
                left, up, corner = (row[j - 1] if j else 0), before[j], (before[j - 1] if j else 0)
                guess = left + up - corner
                by = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: min((left, up, corner), key=lambda v: abs(guess - v))}[kind]
                done.append((x - by) & 255)
            flat += bytes([kind]) + bytes(done)
            before = row
    coded = zlib.compress(flat)
    parms = "/DecodeParms << /Predictor 15 /Columns 5 >> " if predictor else ""
    out += f"{xref} 0 obj\n<< /Type /XRef /Size {xref + 1} /W [1 3 1] /Root 1 0 R /Info {n} 0 R /Length {len(coded)} /Filter /FlateDecode {parms}>>\nstream\n".encode() + coded + b"\nendstream\nendobj\n"
    return out + (b"startxref\n99999999\n" if damage else f"startxref\n{xref_at}\n".encode()) + b"%%EOF"


@pytest.mark.parametrize("predictor", [True, False])
@pytest.mark.parametrize("damage", [True, False])
def test_object_streams(predictor, damage):
    assert facts_of(packed(11, predictor, damage)) == (*WANT, 11, None)


def test_damaged_files_are_outcomes():
    objects, n = tree(5)
    whole = build(objects)
    for bad in (None, b"", b"not a file", b"%PDF-1.4\nnothing", whole[:30]):
        assert facts_of(bad)[6] and facts_of(bad)[5] is None
    assert "encrypted" in facts_of(whole.replace(b"/Root", b"/Encrypt 9 0 R /Root"))[6]
    # a page tree that holds itself
    loop = build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page >>"})
    assert facts_of(loop)[5] == 1
    rng = random.Random(6)
    for whole in (packed(4), build({**objects, n: INFO}, info=n)):
        for _ in range(300):
            broken = bytearray(whole)
            for _ in range(rng.randrange(1, 20)):
                broken[rng.randrange(len(broken))] = rng.randrange(256)
            assert len(facts_of(bytes(broken))) == 7
    with pytest.raises(Damaged):
        read(b"[" * 500, 0)


def test_rows_through_spark(spark):
    objects, n = tree(3)
    objects[n] = INFO
    rows = spark.createDataFrame([("a", bytearray(build(objects, info=n))), ("b", bytearray(packed(9))), ("c", bytearray(b"x")), ("d", None)], "path string, content binary")
    got = {r.path: r for r in pdf_metadata(rows).collect()}
    assert (got["a"].title, got["a"].authors, got["a"].year, got["a"].journal, got["a"].page_count, got["a"].error) == (WANT[0], ["Ann A"], 2015, "Journal#of", 3, None)
    assert got["b"].page_count == 9 and got["c"].error and got["d"].error and got["c"].title is None
