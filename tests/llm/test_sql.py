"""The operators' queries with SQL against DuckDB on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from pulsegrid.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.queries()[name](spark, str(DATA)), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == Counter(tuple(dict(zip(want.columns, r, strict=True))[c] for c in order) for r in want.fetchall())


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
