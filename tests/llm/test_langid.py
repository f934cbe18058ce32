"""The network: its gradient, what it predicts of held-out documents, and edges."""

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import langid as G
from fathom.llm.common import raw

from .conftest import EDGES


def test_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in G.init(3, 4, 1).items()}
    x = rng.integers(0, 20, (9, 6))
    mask = (np.arange(9)[:, None] < np.array([9, 9, 5, 9, 2, 7])[None, :]).astype(np.float64)
    y = rng.integers(0, 3, 6)
    _, g = G.gradient(p, x, mask, y)
    for name in p:
        for _ in range(6):
            i = tuple(int(rng.integers(n)) for n in p[name].shape) if not name.startswith("x") else (int(rng.integers(p[name].shape[0])), int(rng.integers(20)))
            eps = 1e-3
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][i] += eps
            down[name][i] -= eps
            want = (G.gradient(up, x, mask, y)[0] - G.gradient(down, x, mask, y)[0]) / (2 * eps)
            assert g[name][i] == pytest.approx(want, abs=3e-4)


@pytest.fixture(scope="module")
def split(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    return [r for r in rows if r[0] % 2], [r for r in rows if r[0] % 2 == 0]


def test_held_out_accuracy(spark, split):
    train, test = split
    schema = "doc_id long, text string, lang string"
    model = G.train(*G.sample(spark.createDataFrame(train, schema)))
    got = G.identify(spark.createDataFrame(test, schema), model).collect()
    prose = [r for r in got if len(r.text) >= 40]
    right = sum(r.predicted == r.lang for r in prose)
    assert right >= 0.95 * len(prose)
    assert sum(r.keep for r in got) >= 0.998 * len(got)
    for r in got:
        assert sum(r.positions) == len(r.text.encode())


def test_whole_texts_are_learned_from(spark):
    """What stands only after 64 K characters is drawn as often as what is before."""
    rows = [(i, "a" * 70_000 + "ö" * 70_000, "xx") for i in range(40)]
    drawn, labels = G.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert labels == ["xx"] * 40 and all(len(w) == G.TRAIN_WINDOWS for w in drawn)
    late = sum("ö".encode() in w for ws in drawn for w in ws)
    assert 0.55 < late / (40 * G.TRAIN_WINDOWS) < 0.78
    # Shorter ones come whole.
    whole = [(i, "a" * 30_000 + "ö" * 20_000, "xx") for i in range(5)]
    assert G.sample(spark.createDataFrame(whole, "doc_id long, text string, lang string"))[0] == [t for _, t, _ in whole]


def test_ties_go_to_the_first_class():
    p = {k: np.zeros_like(v) for k, v in G.init(3).items()}
    sums, votes = G.predict(p, *raw(pa.array(["abc" * 50, "x"])))
    assert votes.tolist() == [[150, 0, 0], [1, 0, 0]] and np.allclose(sums, np.array([[50] * 3, [1 / 3] * 3]), rtol=1e-4)


def test_rare_languages_are_no_classes(spark):
    rows = [(i, "some words of this language", "xx") for i in range(10)] + [(100 + i, "andere worte", "yy") for i in range(G.MIN_DOCS - 1)]
    assert set(G.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[1]) == {"xx"}


def test_windows_cover_each_byte_once():
    texts = pa.array(["", "a" * G.WINDOW, "b" * (G.WINDOW + 1), None, "c" * 1000, "d"])
    data, off = raw(texts)
    start, size, text = G.windows(data, off)
    covered = np.zeros(len(data), int)
    for s, n in zip(start, size, strict=True):
        covered[s : s + n] += 1
    assert (covered == 1).all()
    p = G.init(3)
    sums, votes = G.predict(p, data, off)
    assert np.allclose(sums.sum(axis=1), np.diff(off), rtol=1e-4)
    # The same text alone gives the same as among others.
    alone, _ = G.predict(p, *raw(pa.array(["c" * 1000])))
    assert np.allclose(alone[0], sums[4], rtol=1e-4)


def test_noise_is_rejected(spark, split):
    train, _ = split
    model = G.train(*G.sample(spark.createDataFrame(train, "doc_id long, text string, lang string")))
    rng = np.random.default_rng(9)
    junk = ["".join(map(chr, rng.integers(33, 127, 400))) for _ in range(20)] + [" ".join(str(x) for x in rng.integers(0, 10**6, 80)) for _ in range(20)]
    got = G.identify(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).collect()
    assert sum(not r.keep for r in got) >= 0.9 * len(got)


def test_query_keeps_all_rows(spark, sf, documents):
    out = G.op10_language_id(spark, sf).collect()
    assert len(out) == documents.count()
    prose = [r for r in out if r.lang]
    assert sum(r.predicted == r.lang for r in prose) >= 0.9 * len(prose)


def test_edges(spark, make, split):
    df = make(EDGES, clash=True)
    out = G.identify(df)
    assert out.columns == [*df.columns, "predicted", "prob", "positions", "keep"]
    rows = out.collect()
    assert len(rows) == len(EDGES) and all(r.predicted is None for r in rows)
    assert [r.keep for r in rows] == [bool(t) for _, t in EDGES]
    model = G.train([t for _, t, _ in split[0]], [c for _, _, c in split[0]], steps=5)
    rows = G.identify(df, model).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert (r.predicted is None) == (not r.text) and (r.text or not r.keep)
    assert G.identify(df.limit(0), model).count() == 0 and G.identify(df.limit(0)).count() == 0
    assert G.stage(spark, df, "").columns == df.columns
