"""Every registered query with SQL, against it, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
from graphloom.plans import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    from compare import rows

    df = registry.queries()[name](spark, FOLDER)
    c, got = rows(df.columns, df.collect())
    cur = db.execute(registry.oracle_sql()[name])
    d, want = rows([x[0] for x in cur.description], cur.fetchall())
    assert c == d and got == want


def test_nothing_outside_imports_llm():
    for p in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p


def test_rest_without_llm(tmp_path):
    """In a copy without both folders everything else imports, and the queries are those of the core."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
    told = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    told += "; import importlib, pathlib; [importlib.import_module('.'.join(p.with_suffix('').parts)) for p in pathlib.Path('graphloom').rglob('*.py')]"
    out = subprocess.run([sys.executable, "-c", told], cwd=copy, capture_output=True, text=True, check=True).stdout.splitlines()
    assert out[-2].split() == sorted(registry.queries()) and out[-1].split() == sorted(registry.oracle_sql())
