"""Every core query against its SQL on the smallest test tables."""

import datetime
import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = {k: v for m in entry.CORE for k, v in m.QUERIES.items()}


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(spark, name, query, sql):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = query(spark, DATA)
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(x[names.index(n)]) for n in sorted(names)]) for x in r.fetchall())
    got = sorted(repr([plain(x[n]) for n in sorted(names)]) for x in df.collect())
    assert got == want, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, name):
    sql = {k: v for m in entry.CORE for k, v in m.SQL.items()}
    if name in sql:
        compare(spark, name, CORE[name], sql[name])
    else:
        assert CORE[name](spark, DATA).count() >= 0


def test_entry_has_rows(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
