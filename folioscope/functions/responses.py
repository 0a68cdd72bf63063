"""Metadata out of service responses: JSON by schema, XML by paths (names without their prefixes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import collapsed, doi_strict, found, trimmed

_CROSSREF = "struct<message:struct<title:array<string>,author:array<struct<given:string,family:string>>,published:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,type:string,abstract:string>>"
_SCHOLAR = "struct<title:string,authors:array<struct<name:string>>,year:int,abstract:string,venue:string>"


def _none_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def authors_to_json(authors: Column) -> Column:
    return F.to_json(authors)


def authors_from_json(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def crossref(text: Column) -> Column:
    """struct(title, authors, year, journal, doc_type); the year is that of publication, else of print."""
    m = F.from_json(text, _CROSSREF)["message"]
    named = F.filter(F.coalesce(m["author"], F.array()), lambda a: F.coalesce(a["family"], F.lit("")) != "")
    authors = F.transform(named, lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), a["family"]))
    year = lambda k: F.get(F.get(m[k]["date-parts"], 0), 0)
    return F.struct(F.get(m["title"], 0).alias("title"), _none_if_empty(authors).alias("authors"), F.when(m["published"].isNotNull(), year("published")).otherwise(year("published-print")).alias("year"), F.get(m["container-title"], 0).alias("journal"), m["type"].alias("doc_type"))


def crossref_survey(text: Column) -> Column:
    """The survey's variant: online dates count third, and abstracts are cut at 120 characters."""
    m = F.from_json(text, _CROSSREF)["message"]
    year = lambda k: F.get(F.get(m[k]["date-parts"], 0), 0)
    cut = F.when(F.length(m["abstract"]) > 120, F.concat(F.substring(m["abstract"], 1, 120), F.lit("..."))).otherwise(m["abstract"])
    return F.struct(F.get(m["title"], 0).alias("title"), F.coalesce(year("published"), year("published-print"), year("published-online")).alias("year"), cut.alias("abstract"))


def scholar(text: Column) -> Column:
    """struct(title, authors, year, abstract, journal)."""
    p = F.from_json(text, _SCHOLAR)
    names = F.filter(F.transform(F.coalesce(p["authors"], F.array()), lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.struct(p["title"].alias("title"), _none_if_empty(names).alias("authors"), p["year"].alias("year"), p["abstract"].alias("abstract"), F.nullif(p["venue"], F.lit("")).alias("journal"))


def _xpath(text: Column, path: str) -> Column:
    return F.xpath(text, F.lit(path))


def _named(path: str) -> str:
    """a/b//c[@x='y'] with each step by local name."""
    out = []
    for step in path.split("/"):
        tag, _, test = step.partition("[")
        out.append(step if not tag or tag.endswith(")") or tag.startswith("@") else f"*[local-name()='{tag}']" + (f"[{test}" if test else ""))
    return "/".join(out)


def grobid(xml: Column) -> Column:
    """struct(title, authors, year, journal, abstract) of a TEI header."""
    one = lambda p: F.nullif(F.get(_xpath(xml, _named(p)), 0), F.lit(""))
    # author by author, so that one without a forename changes nothing for the others
    source = F.regexp_extract(xml, r"(?s)<(?:\w+:)?sourceDesc\b.*?</(?:\w+:)?sourceDesc>", 0)
    nodes = F.regexp_extract_all(source, F.lit(r"(?s)(<(?:\w+:)?author\b[^>]*[^/>]?>.*?</(?:\w+:)?author>)"), F.lit(1))
    part = lambda a, tag: F.get(_xpath(a, _named(f"//{tag}/text()")), 0)
    named = F.transform(nodes, lambda a: F.when(part(a, "surname").isNotNull(), F.concat_ws(" ", part(a, "forename"), part(a, "surname"))))
    authors = F.filter(named, lambda a: a.isNotNull())
    year = found(one("//publicationStmt//date/@when"), r"^(\d{4})").cast("int")
    paragraphs = F.filter(F.transform(_xpath(xml, _named("//profileDesc/abstract//p/text()")), trimmed), lambda p: p != "")
    abstract = F.coalesce(F.nullif(F.array_join(paragraphs, " "), F.lit("")), F.nullif(trimmed(one("//profileDesc/abstract/text()")), F.lit("")))
    return F.struct(one("//titleStmt/title/text()").alias("title"), _none_if_empty(authors).alias("authors"), year.alias("year"), F.coalesce(one("//monogr/title[@level='j']/text()"), one("//monogr/meeting/text()")).alias("journal"), abstract.alias("abstract"))


def xmp(xml: Column) -> Column:
    """struct(title, authors, doi, arxiv_id) of an embedded Dublin Core packet."""
    texts = lambda p: F.filter(F.transform(_xpath(xml, _named(p)), trimmed), lambda t: t != "")
    ids = F.concat(texts("//identifier/text()"), texts("//identifier//li/text()"))
    linked = F.transform(ids, lambda t: found(t, r"(?i)arxiv\.org/abs/(\d{4}\.\d{4,5}(?:v\d+)?)"))
    plain = F.transform(ids, lambda t: F.when(F.lower(t).contains("arxiv"), found(t, r"(\d{4}\.\d{4,5}(?:v\d+)?)")))
    dois = F.transform(ids, lambda t: F.when(found(t, r"(?i)(arxiv\.org/abs/)").isNull(), doi_strict(t)))
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), 0)
    return F.struct(F.get(texts("//title//li/text()"), 0).alias("title"), _none_if_empty(texts("//creator//li/text()")).alias("authors"), first(dois).alias("doi"), F.coalesce(first(linked), first(plain)).alias("arxiv_id"))


def one_line(text: Column) -> Column:
    return collapsed(text)
