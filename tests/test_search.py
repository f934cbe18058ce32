"""Search that reads each text once."""

import pytest
from pyspark.sql import functions as F

from fathom.engine import Engine
from fathom.operators import search

ROWS = [(1, "Rust is fast, rust is safe"), (2, "wireless rust_belt headphones"), (3, "Headphones for a rusty RUST player"), (4, None), (5, ""), (6, "no such thing"), (7, "the é rust")]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string")


@pytest.mark.parametrize("distance", [0, 1])
def test_ranked_reads_texts_once(spark, docs, distance):
    e = Engine(spark)
    e.register("docs", docs, "id")
    q = e.search("docs").query("rust headphones rust")
    df = (q.fuzzy(distance) if distance else q).ranked("text")
    # What is counted of the texts is a table by now, which the order and its ranges read.
    assert "regexp" not in plan(df.select("id", "_score"))
    want = search.bm25(docs, "text", "rust headphones rust", distance=distance)
    assert df.columns == want.columns
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("distance", [0, 1])
def test_ranked_keeps_rows_whose_keys_repeat(spark, docs, distance):
    twice = docs.unionByName(docs.filter("id < 4")).unionByName(docs.filter("id = 1").withColumn("id", F.lit(None).cast("long")))
    e = Engine(spark)
    e.register("docs", twice, "id")
    q = e.search("docs").query("rust")
    got = (q.fuzzy(distance) if distance else q).ranked("text").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, search.bm25(twice, "text", "rust", distance=distance).collect()))
    assert sum(r["id"] == 1 for r in got) == 2 and sum(r["id"] is None for r in got) == 1


def test_index_shuffles_no_words(spark):
    texts = [(i, " ".join(f"word{(i * j) % 211}" for j in range(300))) for i in range(20)]
    e = Engine(spark)
    e.register("texts", spark.createDataFrame(texts, "id long, text string").coalesce(2), "id")
    sc = spark.sparkContext
    sc.setJobGroup("index", "")
    try:
        e.create_text_index("texts", "text")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("index") for s in tracker.getJobInfo(j).stageIds}
    rows = [store.lastStageAttempt(s) for s in stages]
    assert sum(r.outputRecords() for r in rows) > 1000
    # All that is shuffled is the partial totals.
    assert sum(r.shuffleWriteRecords() for r in rows) <= 8


def test_full_text_search_scores_as_bm25(spark, docs):
    e = Engine(spark)
    e.register("docs", docs, "id")
    query = "Rust headphones rust the such é"
    got = e.full_text_search("docs", "text", query)
    rounded = lambda df: {(r["id"], r["text"], round(r["_score"], 9)) for r in df.collect()}
    assert rounded(got) == rounded(search.bm25(docs, "text", query)) and got.count() == 5
    assert e.full_text_search("docs", "text", "nowhere").count() == 0
