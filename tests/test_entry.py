"""The driver's contract on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {f"p{n}_found" for n in (2, 4, 5, 7)} <= set(q)
    assert e.entry(spark).count() > 0


def test_queries_equal_their_sql(spark):
    import glob

    import duckdb

    import __spark_entry__ as e

    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    said = lambda v: None if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    q = e.queries()
    for name, sql in e.oracle_sql().items():
        df, rel = q[name](spark, DATA), db.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns), name
        at = [rel.columns.index(c) for c in columns]
        want = sorted((tuple(said(r[i]) for i in at) for r in rel.fetchall()), key=str)
        assert sorted((tuple(said(r[c]) for c in columns) for r in df.collect()), key=str) == want, name
