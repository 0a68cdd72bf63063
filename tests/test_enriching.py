import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import responses
from folioscope.operators import hooks
from folioscope.operators.tables import Table
from folioscope.plans.enriching import Library, Step, enrich
from folioscope.sources.places import work_path

FRONT = Step("grobid", lambda: F.col("front"), responses.scholar)
WAVES = ((FRONT,), (Step("doi_crossref", lambda: F.col("doi"), responses.crossref), Step("arxiv", lambda: F.col("original_filename"), lambda r: F.struct(F.get_json_object(r, "$.title").alias("title"), F.get_json_object(r, "$.doi").alias("doi")))), (Step("semantic_scholar", lambda: F.col("title"), responses.scholar),))


@pytest.fixture
def library(spark):
    lib = Library(spark, work_path(spark, "library"), 4)
    rows = [(c * 64, f"/lib/{c}/{c}.pdf", f"{c}.pdf", f"{c}.pdf", 1, 10, None) for c in "abcde"]
    lib.files.insert_new(spark.createDataFrame(rows, "content_sha256 string, canonical_path string, display_name string, original_filename string, page_count int, file_size_bytes long, ingested_at timestamp"))
    return lib


@pytest.fixture
def services(monkeypatch, tmp_path):
    """a is known whole by its front, b's title by its name, then more by the title; c by nobody; d's service fails; e is slow."""
    log = str(tmp_path / "asked")

    def service(name, answers):
        def factory():
            def ask(key):
                with open(log, "a") as out:
                    out.write(f"{name}:{key}\n")
                answer = answers.get(key)
                if isinstance(answer, str):
                    raise KeyError(answer)
                return json.dumps(answer) if answer is not None else None

            return ask

        return factory

    whole = {"title": "All of A", "authors": [{"name": "Ann Alpha"}], "year": 2001, "abstract": "x"}
    table = {
        "grobid": {"front a": whole, "front d": "down"},
        "arxiv": {"b.pdf": {"title": "Bee Paper"}, "e.pdf": {"title": "E"}},
        "semantic_scholar": {"Bee Paper": {"title": "The Bee Paper", "authors": [{"name": "Bo Beta"}, {"name": "Cy"}], "year": 1999}},
    }
    monkeypatch.setattr(hooks, "LOOKUPS", hooks.LOOKUPS)
    for name, answers in table.items():
        monkeypatch.setitem(hooks.LOOKUPS, name, service(name, answers))

    def asked():
        with open(log) as lines:
            return sorted(x.strip() for x in lines)

    return asked


def fronts(spark):
    return spark.createDataFrame([(c * 64, f"front {c}") for c in "abcde"], "content_sha256 string, front string")


def test_second_run_does_nothing(spark, library, services):
    summary, bib = enrich(library, "2024-01-01", fronts=fronts(spark), waves=WAVES, tries=1)
    assert summary == {"total": 5, "already_resolved": 0, "asked": 11, "resolved": 3, "renamed": 3, "unknown": 1, "failed": 1}
    resolved = {r.content_sha256[0]: (r.title, r.authors, r.year, r.source_extractors) for r in library.resolved.read().collect()}
    assert resolved == {"a": ("All of A", ["Ann Alpha"], 2001, ["grobid"]), "b": ("The Bee Paper", ["Bo Beta", "Cy"], 1999, ["arxiv", "semantic_scholar"]), "e": ("E", None, None, ["arxiv"])}
    assert "All of A" in bib.filter(F.col("content_sha256") == "a" * 64).first().value
    # a left after the first wave; d's failed front is asked once a run
    first = services()
    assert first == sorted([*[f"grobid:front {c}" for c in "abcde"], *[f"arxiv:{c}.pdf" for c in "bcde"], "semantic_scholar:Bee Paper", "semantic_scholar:E"])
    names = {r.content_sha256[0]: (r.display_name, r.canonical_path) for r in library.files.read().collect()}
    assert names["a"][1] == f"/lib/a/{names['a'][0]}" and "2001" in names["a"][0] and names["c"][0] == "c.pdf"
    assert library.log.read().count() == 3
    versions = [t.version() for t in (library.files, library.sources, library.resolved, library.log)]
    again, _ = enrich(library, "2024-02-01", fronts=fronts(spark), waves=WAVES, tries=1)
    # only what failed is asked again; the empty answers for c are kept
    assert again == {"total": 2, "already_resolved": 0, "asked": 1, "resolved": 0, "renamed": 0, "unknown": 1, "failed": 1}
    assert services() == sorted([*first, "grobid:front d"])
    assert versions == [t.version() for t in (library.files, library.sources, library.resolved, library.log)]


def test_hashes_force_and_dry_run(spark, library, services):
    some = spark.createDataFrame([("a" * 64,), ("nothing",)], "content_sha256 string")
    dry, _ = enrich(library, "2024-01-01", hashes=some, fronts=fronts(spark), waves=WAVES, dry_run=True)
    assert (dry["total"], dry["resolved"], dry["failed"]) == (2, 1, 1) and library.sources.version() == -1
    enrich(library, "2024-01-01", hashes=some, fronts=fronts(spark), waves=WAVES, rename=False)
    assert library.log.version() == -1 and library.resolved.read().count() == 1
    cached, _ = enrich(library, "2024-01-02", hashes=some, fronts=fronts(spark), waves=WAVES)
    assert (cached["already_resolved"], cached["asked"]) == (1, 0)
    forced, _ = enrich(library, "2024-01-03", hashes=some, fronts=fronts(spark), waves=WAVES, force=True)
    assert (forced["asked"], forced["resolved"]) == (1, 1) and services() == ["grobid:front a"] * 2
    assert str(library.resolved.read().first().resolved_at)[:10] == "2024-01-03"


def test_a_run_that_stops_goes_on_where_it_was(spark, library, services, monkeypatch):
    upsert = Table.upsert

    def stops(self, rows, order, **more):
        if "resolved" in self.path:
            raise RuntimeError("lost")
        return upsert(self, rows, order, **more)

    monkeypatch.setattr(Table, "upsert", stops)
    with pytest.raises(RuntimeError):
        enrich(library, "2024-01-01", fronts=fronts(spark), waves=WAVES, tries=1)
    monkeypatch.setattr(Table, "upsert", upsert)
    n = len(services())
    summary, _ = enrich(library, "2024-01-01", fronts=fronts(spark), waves=WAVES, tries=1)
    assert summary["resolved"] == 3 and summary["asked"] == 1 and len(services()) == n + 1
