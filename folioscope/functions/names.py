"""Names, keys, paths and labels of documents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import YEAR, collapsed, found, trimmed

# Latin letters with marks and the plain letters under them (compatibility decomposition).
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
# Words that do not open a citation key, and entry types.
_SKIPPED = ["a", "an", "the", "on", "of"]
_ENTRY_TYPES = {"journal-article": "article", "proceedings-article": "inproceedings", "conference-paper": "inproceedings", "book": "book", "book-chapter": "inbook"}


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def valid_sha256(value: Column) -> Column:
    """The lower-cased hash, or null if it is not 64 hex digits."""
    low = F.lower(F.trim(value))
    return F.when(low.rlike("^[0-9a-f]{64}$"), low)


def canonical_dir(sha: Column) -> Column:
    return F.concat_ws("/", F.lit("sha256"), F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)


def batch_id(paths: Column) -> Column:
    """Sixteen digits that name a list of paths in its order."""
    return F.substring(F.md5(F.array_join(paths, "")), 1, 16)


def source_type(path: Column) -> Column:
    return F.when(path.contains("Zotero/storage"), "zotero").when(path.contains("Dropbox"), "dropbox").otherwise("local")


def storage_id(path: Column) -> Column:
    """The path segment after the first one named storage, or null."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "storage")
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def extraction_path(root: Column, doc_id: Column) -> Column:
    return F.concat_ws("/", root, F.lit("extractions"), doc_id)


def safe_filename(name: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9 ._-]+", " "), r"\s+", " "))
    clean = F.when(clean == "", "document").otherwise(clean)
    clean = F.when(F.endswith(F.lower(clean), F.lit(".pdf")), clean).otherwise(F.concat(clean, F.lit(".pdf")))
    stem = F.regexp_replace(F.substring(clean, 1, 116), r"[ ._-]+$", "")
    short = F.concat(F.when(stem == "", "document").otherwise(stem), F.lit(".pdf"))
    return F.when(F.length(clean) <= 120, clean).otherwise(short)


def last_name(author: Column) -> Column:
    """Last word of the first of several authors, or null."""
    first = F.trim(F.regexp_replace(collapsed(author), r"(?is)(\band\b|;|,).*$", ""))
    return F.nullif(F.element_at(F.split(first, " "), -1), F.lit(""))


def name_from_text(text: Column) -> Column:
    """'author year title' from a first page: line one is the title, line two the authors."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), collapsed), lambda x: x != "")
    title, author = F.get(lines, 0), last_name(F.get(lines, 1))
    return F.nullif(F.concat_ws(" ", author, found(text, YEAR, 0), title), F.lit(""))


def display_name(author: Column, year: Column, title: Column, first_page: Column, filename: Column) -> Column:
    """From metadata if any of it is there, else from the first page, else from the file's name."""
    from_meta = F.nullif(F.concat_ws(" ", last_name(author), F.nullif(year.cast("string"), F.lit("0")), F.nullif(F.trim(title), F.lit(""))), F.lit(""))
    return safe_filename(F.coalesce(from_meta, name_from_text(first_page), F.nullif(filename, F.lit("")), F.lit("document.pdf")))


def plain_letters(text: Column) -> Column:
    """Lower case, marks taken off Latin letters, all else beyond ASCII dropped."""
    return F.lower(F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"[^\x00-\x7F]", ""))


def citation_key(authors: Column, year: Column, title: Column, sha: Column) -> Column:
    """author-year-word-hash, with unknown, nodate and untitled where there is nothing to take."""
    first = F.trim(F.get(authors, 0))
    last = F.when(first.contains(","), F.trim(F.substring_index(first, ",", 1))).otherwise(F.element_at(F.split(collapsed(first), " "), -1))
    author = F.coalesce(F.nullif(plain_letters(last), F.lit("")), F.lit("unknown"))
    words = F.filter(F.transform(F.split(F.lower(title), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: (w != "") & ~w.isin(_SKIPPED))
    word = F.coalesce(F.get(words, 0), F.lit("untitled"))
    when = F.coalesce(F.nullif(year.cast("string"), F.lit("0")), F.lit("nodate"))
    return F.concat_ws("-", author, when, word, F.substring(sha, 1, 12))


def bib_entry(key: Column, doc_type: Column, authors: Column, year: Column, title: Column, journal: Column, abstract: Column) -> Column:
    """A BibTeX entry; fields stand in alphabetical order, braces and backslashes are escaped."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _ENTRY_TYPES.items() for x in p]), F.coalesce(doc_type, F.lit(""))), F.lit("misc"))
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    line = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("},"))
    in_book = kind == "inproceedings"
    fields = [
        line("abstract", escaped(abstract)), line("author", F.when(authors.isNotNull(), F.array_join(authors, " and "))), F.when(in_book, line("booktitle", escaped(journal))),
        F.when(~in_book, line("journal", escaped(journal))), line("title", escaped(title)), line("year", year.cast("string")),
    ]
    return F.concat(F.concat_ws("\n", F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",")), *fields, F.lit("}")), F.lit("\n"))


def doc_label(name: Column) -> Column:
    """'Author - Date - Title' with bars between; other names as they are."""
    parts = F.split(name, " - ", 3)
    return F.when(F.size(parts) == 3, F.array_join(parts, " | ")).otherwise(name)


def file_link(path: Column, pages: Column) -> Column:
    """A file:// link whose path is quoted but for slashes, to the first page if there is one."""
    quoted = F.replace(F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    page = F.get(pages, 0)
    return F.concat(F.lit("file://"), quoted, F.when(page.isNotNull(), F.concat(F.lit("#page="), page.cast("string"))).otherwise(""))


def human_bytes(size: Column) -> Column:
    """'1.2 KB' and the like; halves go to the even digit."""
    out = None
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        shown = F.concat(size.cast("string") if k == 0 else F.format_string("%.1f", F.bround(size / (1024.0**k), 1)), F.lit(f" {unit}"))
        out = shown if out is None else F.when(size < 1024 ** (k + 1), shown).otherwise(out)
    return out


def size_mb(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def _formatted(at: Column, form: str) -> Column:
    """A time as text; years of more than four digits stand without the sign that Spark sets before them."""
    return F.regexp_replace(F.date_format(at, form), r"^\+", "")


def epoch_text(seconds: Column) -> Column:
    return _formatted(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def local_minute(utc: Column, zone: str) -> Column:
    return _formatted(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd HH:mm")


def author_list(authors: Column) -> Column:
    """The first three names, 'et al.' if there are more."""
    return F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))


def metadata_lines(authors: Column, title: Column, year: Column, doc_type: Column, journal: Column, pages: Column) -> Column:
    """struct(line1, line2) of a document's description, with 'unknown' for what is missing."""
    known = lambda c: F.coalesce(F.nullif(F.nullif(c.cast("string"), F.lit("")), F.lit("0")), F.lit("unknown"))
    quoted = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit('"'), title, F.lit('"'))).otherwise("unknown")
    return F.struct(F.concat(F.coalesce(F.get(authors, 0), F.lit("unknown")), F.lit(", "), quoted).alias("line1"), F.concat_ws(", ", known(year), known(doc_type), known(journal), known(pages)).alias("line2"))


def filename_metadata(filename: Column) -> Column:
    """struct(authors, year) that a file's name tells."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    year = found(stem, r"((?:19|20)\d{2})").cast("int")
    from_id = found(stem, r"(\d{4})\.\d+").cast("int")
    author = found(stem, r"^([A-Z][a-z]+)")
    return F.struct(F.when(author.isNotNull(), F.array(author)).alias("authors"), F.coalesce(year, F.when(from_id.between(1900, 2100), from_id)).alias("year"))


def first_page_metadata(text: Column) -> Column:
    """struct(title, authors, year, journal) that a first page tells."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    # a heading in capitals has a capital and no small letter
    shouted = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    long_ones = F.filter(F.slice(lines, 1, 5), lambda x: (F.length(x) > 10) & ~shouted(x))
    names = F.regexp_extract_all(F.substring(text, 1, 500), F.lit(r"(\b[A-Z][a-z]+\s+[A-Z][a-z]+\b|\b[A-Z]\.\s*[A-Z][a-z]+\b)"), F.lit(1))
    authors = F.slice(F.filter(names, lambda x: ~F.element_at(F.split(x, r"\s+"), 1).isin("The", "And", "For", "With", "From")), 1, 5)
    head = F.substring(text, 1, 1000)
    venue = lambda p: F.when(F.length(collapsed(F.regexp_extract(head, p, 1))) > 5, collapsed(F.regexp_extract(head, p, 1)))
    journal = F.coalesce(venue(r"(?:Published in|Proceedings of|In)\s+([A-Z][^\n]{10,80})"), venue(r"([A-Z][a-z]+\s+(?:Journal|Conference|Proceedings)[^\n]{0,60})"))
    return F.struct(F.coalesce(F.get(long_ones, 0), F.get(lines, 0)).alias("title"), F.when(F.size(authors) > 0, authors).alias("authors"), found(head, YEAR, 0).cast("int").alias("year"), journal.alias("journal"))


def pdf_date_year(created: Column, modified: Column) -> Column:
    """The year of a PDF date ('D:2021...' or '2021...'), of creation before change."""
    year = lambda c: F.regexp_extract(c, r"^(?:D:)?(\d{4})", 1).try_cast("int")
    return F.coalesce(year(created), year(modified))


def exit_code(failed: Column) -> Column:
    return F.when(failed > 0, 2).otherwise(0)
