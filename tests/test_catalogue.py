"""Each of the engine's queries against its SQL."""

import datetime as dt
from collections import Counter

import duckdb
import pytest

from fathom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(t[i]) for i in order) for t in tuples)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    cur = duck.execute(SQL[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want
