"""The driver contract: registration, independence of the llm subpackage, plans."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_llm():
    code = "import sys; sys.modules['citaria.llm'] = None; import __spark_entry__ as e; assert 'score_levels' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_core_does_not_name_llm():
    for p in (ROOT / "citaria").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "citaria.llm" not in p.read_text(), p


@pytest.mark.skipif(not DATA.is_dir(), reason="no test data")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["run", "nivel", "macro_f1", "f1_real", "f1_inventada", "f1_incompleta", "tau", "s", "b", "score"]
    df.collect()


@pytest.mark.skipif(not DATA.is_dir(), reason="no test data")
def test_only_needed_columns_are_read(spark):
    plan = entry.queries()["tipo_de"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<citacao_id:bigint,trecho:string>" in plan
