"""Every registered query of the catalogue against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from catalyard.plans import registered

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_query(spark, db, name):
    got = registered.QUERIES[name](spark, DATA)
    want = db.sql(registered.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    tidy = lambda rows: sorted(str(tuple(x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r)) for r in rows)
    assert tidy(tuple(r) for r in got.select(*cols).collect()) == tidy(want.select(*(f'"{c}"' for c in cols)).fetchall())
