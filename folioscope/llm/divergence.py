"""Operator 4, quality rules by distribution divergence, with DataFrame functions only.

Each text has two histograms: character classes, and the words most common in its language (one
bin for all other words). Their references are the sums over all documents of the language that
pass the base rules. A text is dropped if the Jensen-Shannon distance (base 2, so 0 to 1) of either
histogram to the reference exceeds its limit. Short texts give histograms too thin to judge: below
MIN_WORDS words only the base rules decide, and so for languages without a reference.

Base rules, over words [^\\x20\\x09-\\x0D]+: n_words < 10, or more than a fifth of the words stand in
five-word windows found twice or more in the text.

Defined results: a null or empty text has no words and fails the base rules; the id and language
columns may be null; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialise

# The commonest function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
#: Words below which the histograms are not judged.
MIN_WORDS = 50
#: Largest distances of documents that stay.
CHAR_LIMIT, WORD_LIMIT = 0.32, 0.32
_SPACE = r"[\x20\x09-\x0D]+"
#: c_rest: small letters and letters beyond ASCII; c_wide: bytes beyond the first of each character.
_CLASSES = ["c_rest", "c_upper", "c_digit", "c_space", "c_symbol", "c_punct", "c_wide"]
_WORDS = [f"w_{i}" for i in range(13)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body."""
    return F.get(F.transform(F.array(value), body), 0)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(words: Column) -> Column:
    """How many words stand in a five-word window that occurs twice or more.

    Windows are compared by a 64-bit hash. Only texts that have a repeated window sort them; then
    the marked positions in order cover min(5, distance to the mark before) words each.
    """

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashed) - 5), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(5)]))

    def marked(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        flagged = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return F.sort_array(F.filter(flagged, lambda i: i.isNotNull()))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.lit(-5).alias("last"))
        step = lambda acc, p: F.struct((acc["total"] + F.least(F.lit(5), p - acc["last"])).alias("total"), p.alias("last"))
        return F.aggregate(positions, start, step, lambda acc: acc["total"])

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(_let(ordered, marked)))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(_let(_let(hashed, windows), count)).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts and both histograms, one row per document, in one pass over the texts."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text, n = F.col("text"), F.length("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, _SPACE), lambda x: x != "")

    def common(w: Column) -> Column:
        """Counts of the listed words of the text's language, in any case of their letters."""

        def bins(listed: list[str]) -> Column:
            cased = sorted({y for x in listed for y in (x, x.capitalize(), x.upper())})
            # two spaces between, so that neighbouring words share none
            short = F.concat(F.lit(" "), F.lower(F.array_join(F.filter(w, lambda x: x.isin(cased)), "  ")), F.lit(" "))
            return _let(short, lambda p: F.array(*[((F.length(p) - F.length(F.replace(p, F.lit(f" {x} "), F.lit("")))) / (len(x) + 2)).cast("long") for x in listed]))

        out = F.lit(None).cast("array<bigint>")
        for lang, listed in COMMON_WORDS.items():
            out = F.when(F.col("lang") == lang, bins(listed)).otherwise(out)
        return out

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), common(w).alias("common"))

    counted = src.select(
        "doc_id", "lang", n.cast("long").alias("n"), F.octet_length(text).cast("long").alias("n_bytes"), _let(words, of_words).alias("w"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        (n - _without(text, "[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (n - _without(text, "[A-Z]+")).cast("long").alias("c_upper"),
        (n - _without(text, "[0-9]+")).cast("long").alias("c_digit"),
        (n - _without(text, r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]+")).cast("long").alias("c_punct"),
    )
    flat = counted.select("doc_id", "lang", "w.*", "n_dup_lines", "n_symbols", "n", "n_bytes", "c_upper", "c_digit", "c_punct")
    shown = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    return flat.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") - F.col("c_upper") - F.col("c_digit") - F.col("n_symbols") - F.col("c_punct")).alias("c_rest"),
        "c_upper", "c_digit", (F.col("n") - F.col("word_chars")).alias("c_space"), F.col("n_symbols").alias("c_symbol"), "c_punct", (F.col("n_bytes") - F.col("n")).alias("c_wide"),
        *[F.get("common", i).alias(f"w_{i}") for i in range(12)], (F.col("n_words") - shown).alias("w_12"),
        "n_bytes",
    )


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance, base 2, of two distributions; null if one of them is unknown."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    both = [part(x, y) + part(y, x) for x, y in zip(p, q)]
    known = p[0].isNotNull() & q[0].isNotNull()
    return F.when(known, F.sqrt(F.greatest(sum(both[1:], both[0]) / 2, F.lit(0.0))))


def quality(docs: DataFrame, *, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document the base counts, base_failed, both distances and kept.

    Texts are read once: their features are a small written table, from which the references (one
    row for each language of COMMON_WORDS, so their broadcast is bounded) and the verdicts come.
    """
    seen = materialise(features(docs, id_col, text_col, lang_col), "quality-features")
    listed = seen.filter(F.col("lang").isin(list(COMMON_WORDS)) & ~F.col("base_failed"))
    share = lambda name, total: F.sum(name) / F.sum(total)
    reference = listed.groupBy("lang").agg(*[share(c, "n_bytes").alias(f"ref_{c}") for c in _CLASSES], *[share(c, "n_words").alias(f"ref_{c}") for c in _WORDS])
    out = seen.join(F.broadcast(reference), "lang", "left")
    pair = lambda names, total: js_distance([F.col(c) / F.nullif(F.col(total), F.lit(0)) for c in names], [F.col(f"ref_{c}") for c in names])
    out = out.withColumn("char_distance", pair(_CLASSES, "n_bytes")).withColumn("word_distance", pair(_WORDS, "n_words"))
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > char_limit) | (F.col("word_distance") > word_limit))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance")
