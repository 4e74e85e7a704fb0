"""Every query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from readloom import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    res = con.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_rows_only(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() >= 0
