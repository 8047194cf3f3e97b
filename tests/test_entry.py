"""The driver's contract: every query of the core runs on the smallest tables and equals its oracle."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def core():
    from factloom.plans import core_queries, data_queries

    return {**core_queries.QUERIES, **data_queries.QUERIES}, {**core_queries.SQL, **data_queries.SQL}


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@needs_data
@pytest.mark.parametrize("name", sorted(core()[0]))
def test_query(spark, name):
    queries, sql = core()
    df = queries[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in sql:
        import duckdb

        con = duckdb.connect()
        for f in glob.glob(f"{FOLDER}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        cur = con.execute(sql[name])
        at = [[d[0] for d in cur.description].index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    elif name.endswith("_found"):
        assert got and len(got) == len(set(got))


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
