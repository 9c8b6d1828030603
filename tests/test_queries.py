"""Every query with SQL gives the rows of that SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
#: All but the training-data operators', which have tests of their own.
NAMES = sorted(name for m in entry._MODULES for name in m.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()

    def plain(rows):
        return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)

    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
