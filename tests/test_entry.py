import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not (n.startswith("op") and n[2:3].isdigit()) and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query_against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    if name in entry.oracle_sql():
        want = con.execute(entry.oracle_sql()[name])
        cols = [d[0] for d in want.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in cols)) for r in got) == sorted(repr(r) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
