"""Best-fit packing: the query against one machine's run of the same rounds, sweeps against a search of all gaps, and what must hold of any packing."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathom.llm import packing as P
from fathom.llm import spm

from .conftest import EDGES


@pytest.fixture(scope="module")
def codec():
    return spm.Codec(spm._load(spm.MODEL))


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_sweeps_are_best_fit(seed, ranges):
    """Whole or in ranges with what they have left matched across: each piece, from the longest down, has the least gap left that holds it."""
    rng = np.random.default_rng(seed)
    rows = sorted([(int(s), P.WAITING, i) for i, s in enumerate(rng.integers(1, 40, 60))] + [(int(s), P.GAP, i) for i, s in enumerate(rng.integers(1, 50, 30))])
    got, left, free = {}, {}, {}
    for r, part in enumerate(np.array_split(np.arange(len(rows)), ranges)):
        p, q, rest, gaps = P.matched(np.array([rows[i][1] for i in part]))
        got |= {rows[part[a]][2]: rows[part[b]][2] for a, b in zip(p, q, strict=True)}
        left[r], free[r] = [rows[part[i]] for i in rest][::-1], [rows[part[i]] for i in gaps]
    for a, i, b, j, n in P.across({r: len(x) for r, x in left.items()}, {r: len(x) for r, x in free.items()}):
        got |= {x[2]: y[2] for x, y in zip(left[a][i : i + n], free[b][j : j + n], strict=True)}
    want, open_ = {}, [(s, i) for s, k, i in rows if k == P.GAP]
    for s, _, i in sorted((r for r in rows if r[1] == P.WAITING), reverse=True):
        if fits := [g for g in open_ if g[0] >= s]:
            want[i] = min(fits)[1]
            open_.remove(min(fits))
    assert got == want


def sizes(codec, text):
    return len(codec.encode(text or "")) + 1


def one_machine(sizes_, capacity):
    """(id: (bin, at)) of pieces (id: size), by the rounds that pack describes, a piece at a time; small pieces aren't strung here."""
    waiting, gaps, out, bins = dict(sizes_), {}, {}, 0
    while waiting:
        fresh = P.new_bins(Counter(waiting.values()), Counter(g for g in gaps.values() if g >= min(waiting.values())) if gaps else {}, capacity) if not gaps or max(waiting.values()) > max(gaps.values()) else 0
        for _ in range(fresh):
            gaps[bins] = capacity
            bins += 1
        used = set()
        for i, s in sorted(waiting.items(), key=lambda x: -x[1]):
            fits = sorted((g, b) for b, g in gaps.items() if g >= s and b not in used)
            if fits:
                g, b = fits[0]
                used.add(b)
                out[i] = (b, capacity - g)
        for i, (b, _) in out.items():
            if i in waiting:
                gaps[b] -= waiting.pop(i)
    return out, bins


def holds(rows, total, capacity):
    """All tokens of all documents are placed once, and bins are filled without overlaps or holes."""
    got = Counter()
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.size
        assert 1 <= r.size <= capacity
        bins[r.bin].append((r.at, r.size))
    assert got == total
    for pieces in bins.values():
        at = 0
        for a, s in sorted(pieces):
            assert a == at
            at += s
        assert at <= capacity
    return len(bins)


def totals(codec, rows):
    out = Counter()
    for k, t in rows:
        out[k] += sizes(codec, t)
    return out


@pytest.mark.parametrize("ranges", [1 << 17, 40])
def test_equals_one_machine(spark, documents, codec, ranges):
    """The sizes in each bin, for one range and for several; pieces of less than a 32nd, which would be strung, are left out."""
    capacity = 4096
    docs = [(r.doc_id, r.text) for r in documents.collect() if capacity // 32 < sizes(codec, r.text) < capacity]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = P.pack(df.repartition(3), capacity=capacity, sweep_rows=ranges).collect()
    want, bins = one_machine({k: sizes(codec, t) for k, t in docs}, capacity)
    shape = lambda x: Counter(tuple(sorted(v)) for v in x.values())
    got, expected = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.bin].append((r.at, r.size))
    for i, (b, at) in want.items():
        expected[b].append((at, sizes(codec, dict(docs)[i])))
    assert shape(got) == shape(expected) and len(got) <= bins


def test_is_the_same_for_any_number_of_ranges(documents, codec):
    runs = [sorted(map(tuple, P.pack(documents.repartition(n), capacity=512, sweep_rows=rows).collect()), key=repr) for n, rows in ((1, 1 << 17), (5, 100), (2, 33))]
    drop = lambda rows: sorted((k, p, at, s) for k, p, b, at, s in rows)
    assert drop(runs[0]) == drop(runs[1]) == drop(runs[2])


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packs_all_and_tightly(documents, codec, capacity):
    total = totals(codec, [(r.doc_id, r.text) for r in documents.collect()])
    n = holds(P.pack(documents, capacity=capacity).collect(), total, capacity)
    assert n <= 1.1 * math.ceil(sum(total.values()) / capacity) + 2


def test_many_small_documents_take_few_rounds(make, codec, monkeypatch):
    rounds = []
    real = P._round
    monkeypatch.setattr(P, "_round", lambda *a: rounds.append(1) or real(*a))
    rows = [(i, "a") for i in range(20_000)]
    n = holds(P.pack(make(rows), string_rows=3000).collect(), totals(codec, rows), P.CAPACITY)
    assert len(rounds) <= 20 and n <= 1.1 * math.ceil(20_000 * sizes(codec, "a") / P.CAPACITY) + 1


def test_rounds_within_one_range_are_one_job(spark, documents, monkeypatch):
    """A table is written for each round of several ranges only; the driver kept a job and a plan for each round."""
    names = []
    real = P.Scratch.write
    monkeypatch.setattr(P.Scratch, "write", lambda self, name, df: names.append(name) or real(self, name, df))
    P.pack(documents)
    assert len(names) <= 4
    bins = np.array([0, 1, 7, 1 << 40, 12345])
    want = [r[0] for r in spark.createDataFrame([(int(b),) for b in bins], "bin long").selectExpr("xxhash64(CAST(NULL AS STRING), bin)").collect()]
    assert P._tie(bins).tolist() == want


def test_query_and_its_sequences(spark, sf, documents, codec):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    places = P.op3_best_fit_packing(spark, sf)
    got = places.collect()
    holds(got, totals(codec, rows), P.CAPACITY)
    ids = {k: [*codec.encode(t).tolist(), spm.END] for k, t in rows}
    want = defaultdict(dict)
    for r in got:
        want[r.bin][r.at] = ids[r.doc_id][r.piece * P.CAPACITY : r.piece * P.CAPACITY + r.size]
    made = {r.bin: r.ids for r in P.sequences(places, documents).collect()}
    assert {b: [x for at in sorted(v) for x in v[at]] for b, v in want.items()} == made


def test_edges(spark, make, codec):
    df = make(EDGES, clash=True)
    out = P.pack(df, capacity=100)
    assert out.columns == ["doc_id", "piece", "bin", "at", "size"]
    holds(out.collect(), totals(codec, EDGES), 100)
    assert P.pack(df.limit(0)).collect() == []
    holds(P.pack(df, capacity=1).filter("doc_id = 1").collect(), totals(codec, [(1, "")]), 1)
    with pytest.raises(ValueError):
        P.pack(df, capacity=0)
