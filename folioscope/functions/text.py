"""Text functions as Column expressions (all built-ins, inside code generation where Spark can).

Regular expressions here are those that RE2 shares, so that results can be checked by SQL; where
white space must also be that of Unicode, the pattern carries (?U).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must find what the documents' own conventions say.
TOKEN_BREAK = r"[\s,;:()\[\]{}'\"]+"
DISPLAY_EQUATION = r"(?s)\\\[(.*?)\\\]"
INLINE_EQUATION = r"\$(.*?)\$"
PAGE_IMAGE, PAGE_ANCHOR = r"_page_(\d+)_", r'id="page-(\d+)-'
ARXIV_ID = r"(\d{4}\.\d{4,5}(?:v\d+)?)"
ARXIV_OLD = r"(?i)arXiv:([a-z-]+/\d{7})"
ARXIV_URL = r"(?i)arxiv\.org/abs/(\d{4}\.\d{4,5})"
DOI_LENIENT = r"(?i)(?:doi:|DOI:)?\s*(10\.\d+/[^\s]+)"
DOI_STRICT = r"(10\.\d{4,}/[^\s]+)"
DOI_PREFIXED = r"(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,}/[^\s,;)\]\"'}>]+)"
DOI_BARE = r"\b(10\.\d{4,}/[^\s,;)\]\"'}>]+)"
YEAR = r"\b(?:19|20)\d{2}\b"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where there is none (or it is empty)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def trimmed(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased search tokens; backslash, underscore, caret, dot and hyphen stay inside them."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def word_counts(words: Column) -> Column:
    """Distinct words with how often each is there, in order: array<struct<term, tf int>>; counted where the text lies."""

    def counted(own: Column) -> Column:
        n = F.size(own)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(own, i) != F.get(own, i - 1)))
        # a transform of one element evaluates what it holds once
        return F.get(F.transform(F.array(starts), lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(n)), lambda a, b: F.struct(F.get(own, a).alias("term"), (b - a).alias("tf")))), 0)

    some = F.get(F.transform(F.array(F.array_sort(words)), counted), 0)
    return F.when(F.size(words) > 0, some).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def display_equations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DISPLAY_EQUATION), F.lit(1))


def inline_equations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(INLINE_EQUATION), F.lit(1))


def equation_counts(text: Column) -> Column:
    """struct(display_eq_count, inline_eq_count, has_equations)."""
    d, i = F.size(display_equations(text)), F.size(inline_equations(text))
    return F.struct(d.alias("display_eq_count"), i.alias("inline_eq_count"), (d + i > 0).alias("has_equations"))


def page_references(text: Column) -> Column:
    """Sorted distinct pages, from 1, that a snippet's image names and span anchors name."""
    all_of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.concat(all_of(PAGE_IMAGE), all_of(PAGE_ANCHOR)), lambda p: p.cast("int") + 1)))


def cleaned(text: Column) -> Column:
    """Scanned text put right: blank-line runs, space runs, lone page numbers, curly quotes, ends."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r" {2,}", " ")
    out = F.regexp_replace(out, r"(?m)\n\d+\s*$", "")
    out = F.translate(out, "“”‘’", "\"\"''")
    return trimmed(out)


def arxiv_id(text: Column) -> Column:
    return found(text, ARXIV_ID)


def arxiv_base_id(text: Column) -> Column:
    """The arXiv id without its version."""
    return F.regexp_replace(arxiv_id(text), r"v\d+$", "")


def arxiv_any(text: Column) -> Column:
    """From a link, else a new-style id, else an old-style one."""
    return F.coalesce(found(text, ARXIV_URL), found(text, r"(\d{4}\.\d{4,5})"), found(text, ARXIV_OLD))


def doi_lenient(text: Column) -> Column:
    return found(text, DOI_LENIENT)


def doi_strict(text: Column) -> Column:
    return F.regexp_replace(found(text, DOI_STRICT), r"[.,;)]+$", "")


def doi_any(text: Column) -> Column:
    """One with a prefix if there is such, else a bare one; closing punctuation goes."""
    return F.regexp_replace(F.coalesce(found(text, DOI_PREFIXED), found(text, DOI_BARE)), r"[.,;)]+$", "")


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def error_label(stderr: Column, first: Column, last: Column) -> Column:
    """What an extractor's error output tells of; the first listed pattern counts."""
    # Messages and what they mean.
    known = [
        ("Failed to load page", "Corrupted page"),
        ("list index out of range", "Dataloader error"),
        ("Image not found", "Missing images"),
        ("repetitions", "Repetitive content"),
        ("degrees of freedom", "Statistical error"),
    ]
    label = F.lit("Unknown error")
    for message, meaning in reversed(known):
        label = F.when(F.contains(stderr, F.lit(message)), meaning).otherwise(label)
    label = F.when(F.coalesce(stderr, F.lit("")) == "", "No error output").otherwise(label)
    return F.concat(label, F.lit(" (pages "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))


def json_slice(text: Column) -> Column:
    """From the first { to the last }, or null."""
    return found(text, r"(?s)(\{.*\})")


def page_ranges(page_count: Column, step: int) -> Column:
    """'first-last' ranges of `step` pages, from 0; none for an empty document."""
    starts = F.sequence(F.lit(0), page_count - 1, F.lit(step))
    ranges = F.transform(starts, lambda s: F.concat_ws("-", s.cast("string"), F.least(s + step - 1, page_count - 1).cast("string")))
    return F.when(page_count > 0, ranges).otherwise(F.array().cast("array<string>"))


def shifted_page_images(text: Column, first_page: Column) -> Column:
    """Image names _page_N_ with N counted from the whole document's start.

    The text is split at the names; every piece after the first begins with the number left over.
    """
    pieces = F.split(text, r"_page_(?=\d+_)")
    moved = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("_page_"), (F.regexp_extract(p, r"^(\d+)_", 1).cast("long") + first_page).cast("string"), F.regexp_replace(p, r"^\d+", ""))))
    return F.when(first_page == 0, text).otherwise(F.array_join(moved, ""))
