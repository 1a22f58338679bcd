"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from inkwell.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*names).collect()), key=repr)
    assert got
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(want.columns) == names
        assert got == sorted((plain(r) for r in want.select(*map(duckdb.ColumnExpression, names)).fetchall()), key=repr)
