"""Every registered query of the ranking engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from rankloom.plans import catalogue
from rankloom.plans.base import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = db.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in cur.fetchall())
    assert got == want


def test_catalogue_is_complete():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert len(catalogue.QUERIES) > 100
