"""Every registered query with SQL against DuckDB on the smallest tables; the SQL-free ones have tests of their own."""

import os
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def same(a, b) -> bool:
    if pd.isna(a) or pd.isna(b):
        return bool(pd.isna(a) and pd.isna(b))
    return a == b


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert all(same(a, b) for c in columns for a, b in zip(got[c], want[c], strict=True))


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score", "place"]
