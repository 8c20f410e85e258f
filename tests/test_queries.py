"""Every registered query with SQL, on the smallest tables, against DuckDB; the others must give rows."""

import math
import os

import duckdb
import pytest

from cuecorpus.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if not ORACLES[name]:
        return
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    expected = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    assert sorted(map(repr, (tuple(plain(r[c]) for c in order) for r in rows))) == sorted(map(repr, expected))
