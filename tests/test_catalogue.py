"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the entry module works without the text operators."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from pulsegrid.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(row[k] for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    want = con.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_others_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_without_text_operators(tmp_path):
    """As after their folders and the pipeline are deleted."""
    import shutil

    shutil.copytree(ROOT / "pulsegrid", tmp_path / "pulsegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ac_dc_image' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
