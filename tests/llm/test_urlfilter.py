"""The cascades of filters against a set."""

import duckdb
import numpy as np
import pytest

from fathom.llm import urlfilter as U


def test_query_equals_sql(spark, sf):
    df = U.op7_url_filter(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cur = con.execute(U.OP7_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())
    got = df.collect()
    assert want == sorted(repr(tuple(r)) for r in got)
    assert 0 < sum(r.listed for r in got) < len(got)


SHARDED = {"shard_keys": 100, "broadcast_bytes": 0, "shard_pages": 7}


@pytest.mark.parametrize("listed, kw", [(0, {}), (1, {}), (700, {}), (2999, {}), (3000, {}), (700, {"shard_keys": 100}), (700, SHARDED), (0, SHARDED), (3000, SHARDED)])
def test_exact_over_the_universe(spark, listed, kw):
    rng = np.random.default_rng(listed)
    keys = [f"h{i % 40}.example.org/p{i}" for i in rng.permutation(3000)]
    pages = spark.createDataFrame([(i, f"https://www.{k}/?q={i}") for i, k in enumerate(keys)], "page_id long, url string")
    block = spark.createDataFrame([(k,) for k in [*keys[:listed], "absent.example.org"]], "key string")
    got = {r.key: r.listed for r in U.filter_urls(pages, block, **kw).collect()}
    assert got == {k: i < listed for i, k in enumerate(keys)}


def test_a_key_of_most_pages(spark):
    pages = spark.range(5000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN concat('http://a.org/', id) ELSE 'http://hot.org/x' END AS url")
    block = spark.createDataFrame([("hot.org/x",)], "key string")
    rows = U.filter_urls(pages, block, **SHARDED).collect()
    assert len(rows) == 5000 and all(r.listed == (r.page_id % 3 != 0) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 3000, 20_000])
def test_cascade(n):
    h1, h2 = np.random.default_rng(5).integers(-(2**62), 2**62, (2, 20_000))
    on = np.arange(20_000) < n
    levels, confused = U.cascade(h1, h2, on)
    assert (U.contains(levels, h1, h2) == on).all() and not len(confused)
    assert len(levels) < 40


def test_hashes_are_independent(spark):
    rows = spark.range(2000).selectExpr("concat('k', id) AS key").select("key", U.F.xxhash64("key").alias("h1"), U.F.xxhash64(U.F.lit(U._SALT), "key").alias("h2"), U.F.xxhash64("key", U.F.lit(U._SALT)).alias("chained")).collect()
    chained = spark.createDataFrame([(r.h1,) for r in rows], "h long")
    assert len({r.h2 for r in rows}) == 2000 and all(r.h2 != r.chained for r in rows)
    assert abs(np.corrcoef([r.h1 for r in rows], [r.h2 for r in rows])[0, 1]) < 0.1 and chained.count() == 2000


def test_confused_keys_are_listed_one_by_one(spark, monkeypatch):
    """Hashes of one bit confuse most keys; the result stays exact."""
    monkeypatch.setattr(U, "MAX_LEVELS", 3)
    real = U.F.xxhash64
    monkeypatch.setattr(U.F, "xxhash64", lambda *c: real(*c).bitwiseAND(U.F.lit(1)) if c[-1] == "key" else real(*c))
    keys = [f"a{i}.org/x" for i in range(50)]
    pages = spark.createDataFrame([(i, f"http://{k}") for i, k in enumerate(keys)], "page_id long, url string")
    block = spark.createDataFrame([(k,) for k in keys[:20]], "key string")
    got = {r.key: r.listed for r in U.filter_urls(pages, block).collect()}
    assert got == {k: i < 20 for i, k in enumerate(keys)}


def test_edges(spark):
    rows = [(1, "http://bets.example.com/x", "k"), (1, "http://bets.example.com/x", "k"), (None, "https://user@www.Bets.example.com:80/x/?a#b", "k"), (2, None, "k"), (3, "", "k"), (4, "no host", "k"), (5, "ftp://ok.example.com/" + "y" * 100_000, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    block = spark.createDataFrame([("bets.example.com/x",), ("bets.example.com/x",), (None,)], "key string")
    got = sorted((r.page_id or 0, (r.key or "")[:20], r.listed) for r in U.filter_urls(pages, block).collect())
    assert got == [(0, "bets.example.com/x", True), (1, "bets.example.com/x", True), (1, "bets.example.com/x", True), (2, "", False), (3, "", False), (4, "", False), (5, "ok.example.com/yyyyy", False)]
    assert U.filter_urls(pages.limit(0), block).count() == 0
    assert not any(r.listed for r in U.filter_urls(pages, block.limit(0)).collect())
