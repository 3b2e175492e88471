from __future__ import annotations

from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "quirework").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quirework").parts:
            assert "quirework.llm" not in path.read_text() and "import llm" not in path.read_text(), path


def test_queries_and_sql():
    import __spark_entry__ as e

    known = e.queries()
    assert len(known) > 50 and set(e.oracle_sql()) <= set(known) and all(callable(f) for f in known.values())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and {"lang", "domain", "documents"} == set(rows[0].asDict())
