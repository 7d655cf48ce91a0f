"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from framewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if not isinstance(v, (str, bytes)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    want = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
