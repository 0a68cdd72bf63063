import os
import shutil
import subprocess
import sys

import pytest
from sql_twin import assert_same

from folioscope.plans.queries import ORACLES, QUERIES

SF, REPO = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_section_query_against_the_function(spark):
    from folioscope.operators.chunking import section_chunks_of
    from folioscope.plans.queries import _talks

    want = {(r.conv_id, i, t) for r in _talks(spark, SF).collect() for i, (t, _) in enumerate(section_chunks_of(r.content))}
    assert {(r.conv_id, r.chunk_index, r.content) for r in QUERIES["section_chunks"](spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_training_data_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
