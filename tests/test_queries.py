"""Each query of the core library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from fennelmill.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name].run(spark, DATA)
    names = sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    q = duck.sql(QUERIES[name].sql)
    assert sorted(q.columns) == names
    at = [q.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
