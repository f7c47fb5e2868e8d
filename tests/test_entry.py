"""The driver contract, with and without the subpackage for training data."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="needs the test data")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "arborlake", tmp_path / "arborlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'induced_l1' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "arborlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


@pytest.mark.parametrize("name", ["induced_l1", "cut_overrides", "diff_summary", "validate_cycle", "weak_components"])
@pytest.mark.skipif(not SMALL.exists(), reason="needs the test data")
def test_queries_match_their_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = e.queries()[name](spark, str(SMALL)).select(columns).collect()
    assert sorted(str(tuple(r)) for r in got) == want
