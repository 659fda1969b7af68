"""Every query with SQL against DuckDB on the smallest data, values compared."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
CORE = sorted(n for n in entry.oracle_sql())


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    mine = sorted(([_plain(r[c]) for c in columns] for r in df.collect()), key=str)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(([_plain(dict(zip(names, r))[c]) for c in columns] for r in cursor.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_entry(spark):
    assert entry.entry(spark).columns
