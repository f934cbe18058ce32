"""Line dedup against all pairs of lines."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import common
from fathom.llm import linededup as L

from .conftest import EDGES

_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


def words(line):
    return frozenset(_WORD.findall(line.lower().encode()))


def brute(rows, t=L.THRESHOLD, least=L.MIN_WORDS):
    """rows without the lines that match an earlier one; rows in order of id and text, nulls first."""
    seen, out = [], []
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        if text is None:
            out.append((k, None))
            continue
        kept = []
        for line in text.split("\n"):
            w = words(line)
            if len(w) >= least:
                if any(len(w & s) >= t * len(w | s) - 1e-9 for s in seen):
                    seen.append(w)
                    continue
                seen.append(w)
            kept.append(line)
        out.append((k, "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def variants(seed, n):
    """Lines that differ from others by some words."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [list(rng.choice(vocabulary, int(rng.integers(4, 25)))) for _ in range(n // 3)]
    lines = []
    for _ in range(n):
        x = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 3))):
            x[int(rng.integers(len(x)))] = str(rng.choice(vocabulary))
        lines.append(" ".join(x))
    return [(i, "\n".join(lines[j : j + 5])) for i, j in enumerate(range(0, n, 5))]


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9, 1.0])
def test_exact(make, threshold):
    rows = variants(int(threshold * 10), 240)
    got = [(r.doc_id, r.text) for r in L.dedup_lines(make(rows), threshold=threshold).collect()]
    assert ordered(got) == ordered(brute(rows, threshold))


def test_query_matches_brute_force(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    out = L.op2_line_dedup(spark, sf).collect()
    assert ordered((r.doc_id, r.text) for r in out) == ordered(brute(rows))
    lines = {k: t.count("\n") + 1 for k, t in rows}
    assert all(r.n_lines == lines[r.doc_id] and r.n_removed <= r.n_lines for r in out)
    assert sum(r.n_removed for r in out) > 0


def test_query_equals_sql(spark, sf):
    df = L.op2_line_dedup(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(L.OP2_SQL)
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("hot", [5, 50])
def test_hot_words_are_dealt_without_loss(make, hot):
    rows = variants(3, 240)
    got = [(r.doc_id, r.text) for r in L.dedup_lines(make(rows), threshold=0.7, hot=hot).collect()]
    assert ordered(got) == ordered(brute(rows, 0.7))


def test_a_line_of_every_document(make):
    rows = [(i, f"All rights reserved.\nOwn words of {i} here {i * 7}\nok\nA licence line of ten words that all of these documents share number {i % 3}") for i in range(2000)]
    got = {r.doc_id: r for r in L.dedup_lines(make(rows)).collect()}
    assert got[0].n_removed == 0 and all(r.n_removed == 3 for k, r in got.items() if k > 2)
    assert all(r.text == f"Own words of {k} here {k * 7}" for k, r in got.items() if k > 2)


def test_a_line_of_many_pairs_is_cut_once(monkeypatch):
    """Pairs are verified on the words of each distinct line, and by the same similarity as one pair at a time."""
    cut = []
    real = common.shingles
    monkeypatch.setattr(common, "shingles", lambda texts, n: cut.append(len(texts)) or real(texts, n))
    rng = np.random.default_rng(4)
    lines = [*(" ".join(rng.choice([f"w{i}" for i in range(9)], int(rng.integers(1, 12)))) for _ in range(30)), "", "...", None]
    pairs = [(lines[i], lines[j]) for i in range(len(lines)) for j in range(len(lines))]
    got = common.jaccard(*(pa.array(x, pa.string()) for x in zip(*pairs, strict=True)), 1)
    sets = [(words(a or ""), words(b or "")) for a, b in pairs]
    assert got.tolist() == [len(a & b) / max(1, len(a | b)) for a, b in sets]
    assert sum(cut) <= len(lines)
    assert len(common.jaccard(pa.array([], pa.string()), pa.array([], pa.string()), 1)) == 0


@pytest.mark.parametrize("t", [0.5, 0.8, 0.9, 1.0])
def test_sets_too_small_to_resemble_others(t):
    least = L.least_joined(t)
    if t < 1:
        assert least >= t * (least + 1) - 1e-9 and (least == 1 or least - 1 < t * least - 1e-9)


def test_edges(spark, make):
    df = make(EDGES, clash=True)
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert ordered((r.doc_id, r.text) for r in rows) == ordered(brute(EDGES))
    assert {r["__key"] for r in rows} == {"__key!"} and {r["gone"] for r in rows} == {"gone!"}
    assert [r.n_lines for r in rows if r.text is None] == [0, 0]
    again = L.dedup_lines(out)
    assert again.columns == out.columns
    assert L.dedup_lines(df.limit(0)).count() == 0
    assert L.stage(spark, df, "").columns == df.columns
