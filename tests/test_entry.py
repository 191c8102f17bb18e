"""The driver's contract, and queries against their SQL on the smallest tables."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path(entry.SMALL)


def test_flagship(spark):
    if not SMALL.exists():
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_read_whole_tables():
    """No query of the engine or the subpackage cuts a table by sample, modulo of an id or a prefix of texts."""
    for p in (ROOT / "lodestrata").rglob("*queries.py"):
        code = p.read_text()
        assert not re.search(r"\.sample\(|TABLESAMPLE|using sample|pmod\(|%\s*50\b", code, re.IGNORECASE), p


def test_core_does_not_import_llm():
    for p in (ROOT / "lodestrata").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(?:from|import)\s+lodestrata\.llm", p.read_text()), p
    code = "import sys; sys.modules['lodestrata.llm'] = None; sys.modules['lodestrata.llm.queries'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}).returncode == 0


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5)
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not SMALL.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in SMALL.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = entry.queries()[name](spark, str(SMALL))
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    key = lambda r: [(v is None, str(v)) for v in r]
    got = sorted(([norm(v) for v in r] for r in df.select(*cols).collect()), key=key)
    want = sorted(([norm(v) for v in r] for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    assert got == want


def test_intermediate_tables_can_be_cleaned(spark):
    from lodestrata.session import Scratch, clean, shared_dir

    s = Scratch(spark, "test")
    assert s.table(spark.range(3)).count() == 3 and Path(s.root.removeprefix("file://")).exists()
    clean(spark)
    assert not Path(s.root.removeprefix("file://")).exists() and Path(shared_dir(spark).removeprefix("file://")).exists()
