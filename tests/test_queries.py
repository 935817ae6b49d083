"""Every registered query with SQL gives the SQL's rows; those without have rows."""

import subprocess
import sys
from pathlib import Path

import pytest

from ledgerloom import registry

from .conftest import SMALL

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(compare, name):
    assert compare(registry.QUERIES[name], registry.ORACLES[name]) or name == "validate_ledger"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"injected_errors"}))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).limit(1).count() == 1


def test_entry_imports_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['ledgerloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'net_balance' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(ROOT)})


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "ledgerloom.llm" not in path.read_text(), path
