"""Near-duplicates against the exact similarity of all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import hyperminhash as H
from fathom.llm.common import shingles, unique_in

from .conftest import EDGES

_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


def sets(text, n=H.SHINGLE):
    w = _WORD.findall((text or "").lower().encode())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def pairs(texts, t):
    s = [sets(x) for x in texts]
    return {(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and len(s[i] & s[j]) >= t * len(s[i] | s[j]) - 1e-12}


def groups(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in edges:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_groups_of_documents(spark, sf, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    near = pairs([t for _, t in rows], H.THRESHOLD)
    got = {r.doc_id: r for r in H.op8_hyperminhash(spark, sf).collect()}
    assert len(got) == len(rows)
    ids = [k for k, _ in rows]
    together = sum(got[ids[i]].group == got[ids[j]].group for i, j in near)
    assert near and together >= 0.9 * len(near)
    # What is together is so by similar pairs alone.
    want = groups(len(rows), near)
    for i, k in enumerate(ids):
        assert want[ids.index(got[k].group)] == want[i]
    by = Counter(r.group for r in got.values())
    for r in got.values():
        assert r.group_size == by[r.group] and r.keep == (r.doc_id == r.group)


@pytest.mark.parametrize("j", [0.5, 0.7, 0.9])
def test_recall(make, j):
    rng = np.random.default_rng(int(10 * j))
    rows = []
    for i in range(150):
        n = int(rng.integers(30, 400))
        a = [f"v{x}" for x in rng.integers(0, 1 << 30, n)]
        # Cutting a tail leaves the share j of the shingles.
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[: int(np.ceil(j * (n - 2))) + 2]))]
    got = {r.doc_id: r.group for r in H.near_duplicates(make(rows)).collect()}
    near = pairs([t for _, t in rows], H.THRESHOLD)
    assert len(near) == 150
    assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)


def test_estimate_is_corrected():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.3, 0.8):
        errors = []
        for _ in range(40):
            n = 3000
            both = rng.integers(0, 2**63, int(n * 2 * share / (1 + share)), dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]) for _ in range(2))
            regs = [H.registers(np.zeros(n, np.int64), x * np.uint64(2) + np.uint64(1), 1) for x in (a, b)]
            est, _ = H.estimate(regs[0], regs[1], np.array([n]), np.array([n]))
            errors.append(float(est[0]) - share)
        assert abs(np.mean(errors)) < 0.03


def test_shingles_are_those_of_words():
    texts = ["a b c d", "", "one", "A, b! C d", None]
    where, h = unique_in(*shingles(pa.array(texts), 3))
    assert Counter(where.tolist()) == {0: 2, 2: 1, 3: 2}
    assert set(h[where == 0]) == set(h[where == 3])


def test_groups_of_thousands(make):
    base = " ".join(f"x{i}" for i in range(80))
    rows = [(i, f"{base} tail{i}") for i in range(3000)] + [(5000 + i, base) for i in range(1500)] + [(9000, "quite another text of a few words")]
    got = H.near_duplicates(make(rows)).filter("keep").select("doc_id", "group_size").collect()
    assert sorted(map(tuple, got)) == [(0, 4500), (9000, 1)]


def test_hot_bands_are_dealt_without_loss(documents):
    """The same groups whether a band is compared by one task or by many."""
    groups = lambda hot: sorted((r.doc_id, r.group) for r in H.near_duplicates(documents, hot=hot).select("doc_id", "group").collect())
    assert groups(2) == groups(H.HOT)


def test_crosses_are_all_pairs_of_different_components(spark):
    rng = np.random.default_rng(3)
    rows = [(int(b), i, int(l)) for i, (b, l) in enumerate(zip(rng.integers(0, 4, 90), rng.integers(100, 104, 90)))]
    first = {}
    for b, i, _ in rows:
        first.setdefault(b, i)
    df = spark.createDataFrame([(b, i, first[b], l) for b, i, l in rows], "band long, key long, first long, label long")
    want = {(i, j) for b, i, l in rows for c, j, m in rows if i < j and b == c and l != m and i != first[b]}
    from fathom.llm.common import Scratch

    for hot in (3, 10, 1000):
        cells = H._cells(df, Scratch(spark), hot).repartition("band", "cell").sortWithinPartitions("band", "cell")
        got = [(r.a, r.b) for r in cells.mapInArrow(H._crosses, "a long, b long").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_stage_tells_copies_by_what_they_were(spark, make, tmp_path):
    """What line dedup left of a copy goes with the copy; ids that repeat are compared as they are."""
    a = "\n".join(f"line {i} has words of its own {i * 7} {i * 13}" for i in range(20))
    came = [(1, a), (2, a.replace("line 5 has", "line 5 had")), (3, "quite another text of some words"), (4, None), (5, ""), (6, "twice"), (6, "twice and more")]
    make(came, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    left = make([(1, a), (2, "line 5 had words of its own 35 65"), (3, came[2][1]), (4, None), (5, ""), (6, "twice"), (6, "twice and more"), (7, came[2][1])], clash=True)
    out = H.stage(spark, left, str(tmp_path))
    assert out.columns == left.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, a), (3, came[2][1]), (4, ""), (5, ""), (6, "twice"), (6, "twice and more")]
    assert H.stage(spark, left.limit(0), str(tmp_path)).count() == 0


def test_edges(spark, make):
    df = make([*EDGES, (8, EDGES[1][1]), (9, EDGES[1][1].upper())], clash=True)
    out = H.near_duplicates(df)
    assert out.columns == [*df.columns, "group", "group_size", "keep"]
    rows = out.collect()
    assert len(rows) == df.count()
    assert {r["root"] for r in rows} == {"root!"} and {r["__key"] for r in rows} == {"__key!"}
    wordless = [r for r in rows if r.text is None or not sets(r.text)]
    assert len(wordless) == 6 and all(r.keep and r.group_size == 1 for r in wordless)
    assert sorted(r.keep for r in rows if r.doc_id == 3) == [False, True]
    orphan = [r for r in rows if (r.text or "").lower() == EDGES[1][1]]
    assert sorted((r.doc_id or 0, r.keep, r.group) for r in orphan) == [(0, True, None), (8, False, None), (9, False, None)]
    assert H.near_duplicates(df.limit(0)).count() == 0
