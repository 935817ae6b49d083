"""The driver's entry with the subpackage: its queries are there, and what they need may not be missing."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from ledgerloom.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).parents[2]


def test_queries_are_registered():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sorted(int(m[1]) for n in found if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(QUERIES) < set(found) and set(ORACLES) < set(sql) and found["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "temperature_mixing", "mixture_packing"]


def test_a_broken_dependency_is_not_hidden():
    code = "import sys; sys.modules['ledgerloom.llm.hashing'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(ROOT)})
    assert done.returncode and "ledgerloom.llm.hashing" in done.stderr


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(compare, name):
    assert compare(QUERIES[name], ORACLES[name])
