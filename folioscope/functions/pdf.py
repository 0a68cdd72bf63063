"""What a PDF file says of itself: its information entries and the number of its pages.

A small reader of the file format: cross-reference tables and streams, object streams, and where these are damaged a
search for the objects themselves. It reads names, dates and the page tree, no page contents.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.names import pdf_date_year

#: Bytes that a compressed part may unfold to.
MOST_INFLATED = 1 << 28
_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """A reference to the object of this number."""


class Damaged(ValueError):
    """The file does not say what it should there."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from behind its parenthesis."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            c = data[at : at + 1]
            at += 1
            if c in b"01234567" and c:
                m = re.compile(rb"[0-7]{1,3}").match(data, at - 1)
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif c == b"\r":
                at += data[at : at + 1] == b"\n"
            elif c != b"\n":
                out += _ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    raise Damaged("a string does not end")


def read(data: bytes, at: int, depth: int = 0):
    """The value at a place and where it ends: dict, list, Ref, bytes (strings), str (names), numbers, True, False, None."""
    at = _SPACE.match(data, at).end()
    if depth > 100:
        raise Damaged("values are nested too deeply")
    if data.startswith(b"<<", at):
        out, at = {}, at + 2
        while True:
            at = _SPACE.match(data, at).end()
            if data.startswith(b">>", at):
                return out, at + 2
            key, at = read(data, at, depth + 1)
            if not isinstance(key, str):
                raise Damaged("a key is no name")
            out[key], at = read(data, at, depth + 1)
    if data.startswith(b"[", at):
        items, at = [], at + 1
        while True:
            at = _SPACE.match(data, at).end()
            if data.startswith(b"]", at):
                return items, at + 1
            item, at = read(data, at, depth + 1)
            items.append(item)
    if data.startswith(b"(", at):
        return _string(data, at + 1)
    if data.startswith(b"<", at):
        end = data.find(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        if end < 0:
            raise Damaged("a string does not end")
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if m := _NAME.match(data, at):
        return re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1]).decode("latin-1"), m.end()
    if m := _REFERENCE.match(data, at):
        return Ref(m[1]), m.end()
    if m := _NUMBER.match(data, at):
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    for word, value in ((b"true", True), (b"false", False), (b"null", None)):
        if data.startswith(word, at):
            return value, at + len(word)
    raise Damaged(f"no value at {at}")


class Pdf:
    def __init__(self, data: bytes):
        self.data, self.places, self.trailer = data, {}, {}
        self.packed: dict[int, dict[int, object]] = {}
        try:
            self._tables()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise Damaged("there is no root")
        except (Damaged, ValueError, IndexError, RecursionError, zlib.error):
            self._search()

    def _tables(self) -> None:
        """Cross-references from the last one back; what is newer counts."""
        last = self.data.rfind(b"startxref")
        if last < 0:
            raise Damaged("there is no startxref")
        todo, seen = [int(_NUMBER.match(self.data, _SPACE.match(self.data, last + 9).end())[0])] if _NUMBER.match(self.data, _SPACE.match(self.data, last + 9).end()) else [], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if at in seen:
                    continue
                raise Damaged("a cross-reference lies outside")
            seen.add(at)
            own = self._table(at) if self.data.startswith(b"xref", _SPACE.match(self.data, at).end()) else self._stream_table(at)
            self.trailer = own | self.trailer
            todo += [own[k] for k in ("XRefStm", "Prev") if isinstance(own.get(k), int)]

    def _table(self, at: int) -> dict:
        at = _SPACE.match(self.data, at).end() + 4
        section = re.compile(rb"\s*(\d+)\s+(\d+)\s*")
        entry = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
        while m := section.match(self.data, at):
            at = m.end()
            for number in range(int(m[1]), int(m[1]) + int(m[2])):
                e = entry.match(self.data, at)
                if e is None:
                    raise Damaged("a cross-reference has no entry")
                if e[3] == b"n":
                    self.places.setdefault(number, (int(e[1]), None))
                at = e.end()
        at = _SPACE.match(self.data, at).end()
        if not self.data.startswith(b"trailer", at):
            raise Damaged("there is no trailer")
        value, _ = read(self.data, at + 7)
        return value if isinstance(value, dict) else {}

    def _stream_table(self, at: int) -> dict:
        m = _OBJECT.match(self.data, _SPACE.match(self.data, at).end())
        if m is None:
            raise Damaged("there is no cross-reference")
        facts, body = self._stream(m.end())
        widths, index = facts["W"], facts.get("Index") or [0, facts["Size"]]
        size, place = sum(widths), 0
        for first, n in zip(index[::2], index[1::2]):
            for number in range(first, first + n):
                fields, k = [], place
                for w in widths:
                    fields.append(int.from_bytes(body[k : k + w], "big") if w else None)
                    k += w
                place += size
                kind = 1 if fields[0] is None else fields[0]
                if kind == 1:
                    self.places.setdefault(number, (fields[1], None))
                elif kind == 2:
                    self.places.setdefault(number, (fields[2] or 0, fields[1]))
        return facts

    def _search(self) -> None:
        """Objects where they are found, the last of a number counts; trailers and the root among them."""
        self.places, self.packed, self.trailer = {m.group(1) and int(m[1]): (m.start(), None) for m in _OBJECT.finditer(self.data)}, {}, {}
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                value, _ = read(self.data, m.end())
                self.trailer |= value if isinstance(value, dict) else {}
            except (Damaged, ValueError):
                continue
        for number in list(self.places):
            try:
                facts = self.get(Ref(number))
                if not isinstance(facts, dict):
                    continue
                if facts.get("Type") == "ObjStm":
                    for i, held in enumerate(self._pack(number)):
                        self.places.setdefault(held, (i, number))
                        inner = self.get(Ref(held))
                        if isinstance(inner, dict) and inner.get("Type") == "Catalog":
                            self.trailer.setdefault("Root", Ref(held))
                elif facts.get("Type") == "XRef":
                    self.trailer = {k: v for k, v in facts.items() if k in ("Root", "Info", "Encrypt")} | self.trailer
                elif facts.get("Type") == "Catalog":
                    self.trailer.setdefault("Root", Ref(number))
            except (Damaged, ValueError, zlib.error):
                continue

    def _stream(self, at: int) -> tuple[dict, bytes]:
        """A stream object's facts and its bytes, unfolded."""
        facts, at = read(self.data, at)
        at = _SPACE.match(self.data, at).end()
        if not isinstance(facts, dict) or not self.data.startswith(b"stream", at):
            raise Damaged("there is no stream")
        at += 6
        at += 2 if self.data.startswith(b"\r\n", at) else 1
        size = self.get(facts.get("Length"))
        end = at + size if isinstance(size, int) and self.data[at + size : at + size + 20].lstrip().startswith(b"endstream") else self.data.find(b"endstream", at)
        body = self.data[at : end if end >= 0 else len(self.data)]
        names = self.get(facts.get("Filter"))
        names = names if isinstance(names, list) else [names] if names else []
        options = self.get(facts.get("DecodeParms")) or {}
        options = (options[0] or {}) if isinstance(options, list) and options else options
        for name in names:
            if name not in ("FlateDecode", "Fl"):
                raise Damaged(f"a stream is folded by {name}")
            unfold = zlib.decompressobj()
            body = unfold.decompress(body, MOST_INFLATED)
            if unfold.unconsumed_tail:
                raise Damaged("a stream unfolds to too much")
            if options.get("Predictor", 1) >= 10:
                body = _unpredicted(body, options.get("Columns", 1) * options.get("Colors", 1) * options.get("BitsPerComponent", 8) // 8)
        return facts, body

    def _pack(self, number: int) -> dict[int, object]:
        """The objects of an object stream, in order."""
        if number not in self.packed:
            place = self.places.get(number)
            m = _OBJECT.match(self.data, _SPACE.match(self.data, place[0]).end()) if place and place[1] is None else None
            if m is None:
                raise Damaged("an object stream is not there")
            facts, body = self._stream(m.end())
            heads, at = [], 0
            for _ in range(2 * self.get(facts["N"])):
                value, at = read(body, at)
                heads.append(value)
            self.packed[number] = {n: read(body, self.get(facts["First"]) + o)[0] for n, o in zip(heads[::2], heads[1::2])}
        return self.packed[number]

    def get(self, value, hops: int = 20):
        """A value, references followed; what is not there is null."""
        while isinstance(value, Ref) and hops:
            hops -= 1
            place = self.places.get(int(value))
            if place is None:
                return None
            if place[1] is not None:
                value = self._pack(place[1]).get(int(value))
                continue
            m = _OBJECT.match(self.data, _SPACE.match(self.data, place[0]).end())
            if m is None or int(m[1]) != int(value):
                raise Damaged(f"object {int(value)} is not where it should be")
            value, _ = read(self.data, m.end())
        return value

    def pages(self) -> int:
        """Leaves of the page tree; each node counts once."""
        root = self.get(self.trailer.get("Root"))
        todo, seen, n = [root.get("Pages")] if isinstance(root, dict) else [], set(), 0
        while todo:
            ref = todo.pop()
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    continue
                seen.add(int(ref))
            node = self.get(ref)
            if isinstance(node, dict):
                kids = self.get(node.get("Kids"))
                if isinstance(kids, list):
                    todo += kids
                else:
                    n += 1
        return n

    def text(self, key: str) -> str | None:
        """An information entry as text; empty ones are null."""
        info = self.get(self.trailer.get("Info"))
        value = self.get(info.get(key)) if isinstance(info, dict) else None
        if not isinstance(value, bytes):
            return None
        if value.startswith(b"\xfe\xff"):
            out = value[2:].decode("utf-16-be", "replace")
        elif value.startswith(b"\xef\xbb\xbf"):
            out = value[3:].decode("utf-8", "replace")
        else:
            out = value.decode("latin-1")
        return out.rstrip("\0") or None


def _unpredicted(body: bytes, width: int) -> bytes:
    """Rows of a PNG predictor, undone (none, left, up, mean, Paeth of single bytes)."""
    out, before = bytearray(), bytes(width)
    for at in range(0, len(body), width + 1):
        kind, row = body[at], bytearray(body[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            if kind == 1:
                row[i] = (row[i] + left) & 255
            elif kind == 2:
                row[i] = (row[i] + up) & 255
            elif kind == 3:
                row[i] = (row[i] + (left + up) // 2) & 255
            elif kind == 4:
                guess = left + up - corner
                near = min((left, up, corner), key=lambda x: abs(guess - x))
                row[i] = (row[i] + near) & 255
        before = bytes(row).ljust(width, b"\0")
        out += row
    return bytes(out)


def facts_of(data: bytes | None) -> tuple:
    """title, author, subject, created, modified, page_count, error."""
    try:
        if not data or b"%PDF-" not in data[:1024]:
            raise Damaged("this is no PDF file")
        pdf = Pdf(data)
        if pdf.trailer.get("Encrypt") is not None:
            raise Damaged("the file is encrypted")
        if not isinstance(pdf.get(pdf.trailer.get("Root")), dict):
            raise Damaged("there is no root")
        return (*(pdf.text(k) for k in ("Title", "Author", "Subject", "CreationDate", "ModDate")), pdf.pages(), None)
    except Exception as error:  # noqa: BLE001 - whatever a broken file leads to is that file's outcome
        return None, None, None, None, None, None, f"{type(error).__name__}: {error}"


def pdf_metadata(files: DataFrame) -> DataFrame:
    """(path, content) -> path, title, authors, year, journal, page_count, error: a row per file, damaged ones with their
    error. One file at a time is held."""
    names = ["title", "author", "subject", "created", "modified", "page_count", "error"]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.string()]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                content = b.column("content")[i].as_py()
                yield pa.RecordBatch.from_arrays([b.column("path").slice(i, 1), *[pa.array([x], k) for x, k in zip(facts_of(content), kinds)]], names=["path", *names])

    rows = files.select("path", "content").mapInArrow(run, "path string, title string, author string, subject string, created string, modified string, page_count int, error string")
    authors = F.when(F.col("author").isNotNull(), F.array("author"))
    return rows.select("path", "title", authors.alias("authors"), pdf_date_year(F.col("created"), F.col("modified")).alias("year"), F.col("subject").alias("journal"), "page_count", "error")
