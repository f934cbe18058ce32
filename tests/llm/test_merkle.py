"""Fingerprints of documents against trees built by hand, and bases against the similarity of all pairs."""

import hashlib
import re

import duckdb

from fathom.llm import merkle as M

from .conftest import EDGES
from .test_hyperminhash import sets


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def tree(text):
    leaves = [md5(p) for p in text.split("\n")]
    sections, current = [], []
    for i, leaf in enumerate(leaves):
        if i and leaf < M.MARK:
            sections.append(current)
            current = []
        current.append(leaf)
    sections.append(current)
    hashes = [md5("".join(s)) for s in sections]
    return leaves, hashes, md5("".join(hashes))


def test_equals_sql(spark, sf):
    df = M.op4_merkle(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(M.OP4_SQL)
    names = [d[0] for d in cur.description]
    assert names == df.columns
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.collect())


def places(x):
    return {int(i) for i in x.split(",") if i}


def test_near_copies_get_a_base_and_their_edits(spark):
    """All documents with an earlier one that shares most of its shingles and any of its sentences; one without a common sentence may have none."""
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in M.op4_merkle(spark, sf).collect()}
    texts = dict(rows)
    shingles = {k: sets(t) for k, t in rows}
    cut = lambda t: {x.strip() for x in re.split(r" ?[.!?\n][ .!?\n]*", re.sub(r"[^\w.!?\n]+|_", " ", t.lower())) if x.strip()}
    parts = {k: cut(t) for k, t in rows}
    near = missed = 0
    for n, (k, t) in enumerate(rows):
        for j, u in rows[:n]:
            a, b = shingles[k], shingles[j]
            if not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or len(a & b) < 0.8 * len(a | b):
                continue
            near += 1
            if got[k].base is None:
                assert not parts[k] & parts[j]
                missed += 1
            elif t == u:
                assert got[k].same and texts[got[k].base] == t
            break
    assert near > 20 and missed <= 0.05 * near
    for r in got.values():
        if r.base is not None and not r.same:
            mine, old = texts[r.doc_id].split("\n"), texts[r.base].split("\n")
            assert places(r.changed_paragraphs) == {i for i, p in enumerate(mine, 1) if p not in old}
            assert places(r.removed_paragraphs) == {i for i, p in enumerate(old, 1) if p not in mine}


def test_edits_are_located(make):
    paragraphs = [f"paragraph number {i} of a text" for i in range(200)]
    edited = [*paragraphs[:60], "a new one", *paragraphs[60:120], "changed", *paragraphs[121:150], *paragraphs[151:]]
    again = [*edited[:10], "edited once more", *edited[11:]]
    rows = [(1, "\n".join(paragraphs)), (2, "\n".join(edited)), (3, "\n".join(paragraphs)), (4, "nothing in common"), (5, "\n".join(edited)), (6, "\n".join(again))]
    got = {r.doc_id: r for r in M.fingerprints(make(rows)).collect()}
    assert got[3].base == 1 and got[3].same and got[3].changed_paragraphs == ""
    assert got[2].base == 1 and not got[2].same
    assert (got[2].changed_paragraphs, got[2].removed_paragraphs) == ("61,122", "121,151")
    assert len(got[2].changed_sections.split(",")) < got[2].n_sections
    # A copy of an edited copy is compared with that, not with what both come from.
    assert got[5].base == 2 and got[5].same
    assert got[6].base in (1, 2) and 11 in places(got[6].changed_paragraphs)
    assert got[1].base is None and got[4].base is None
    for k, t in rows:
        leaves, sections, root = tree(t)
        assert (got[k].root, got[k].n_paragraphs, got[k].n_sections) == (root, len(leaves), len(sections))


def test_documents_of_one_paragraph(make):
    rows = [(1, "One sentence stands here. Another follows it. And a third."), (2, "One sentence stood here. Another follows it. And a third!"), (3, "something else")]
    got = {r.doc_id: r for r in M.fingerprints(make(rows)).collect()}
    assert (got[2].base, got[2].same, got[2].n_shared, got[2].changed_sections, got[2].changed_paragraphs, got[2].removed_paragraphs) == (1, False, 2, "1", "1", "1")
    assert got[3].base is None


def test_fingerprints_travel_as_bytes(make, monkeypatch):
    """Of each paragraph 16 bytes are written and shuffled; hexadecimal, which shuffles don't compress, took 32 and an offset."""
    written = {}
    real = M.Scratch.write
    monkeypatch.setattr(M.Scratch, "write", lambda self, name, df: written.setdefault(name, real(self, name, df)))
    text = "\n".join(f"paragraph {i}" for i in range(50))
    M.fingerprints(make([(1, text), (2, None)]))
    got = {r["__key"]: r for r in written["trees"].collect()}
    leaves, sections, _ = tree(text)
    assert (got[1].leaves, got[1].sections) == (bytes.fromhex("".join(leaves)), bytes.fromhex("".join(sections)))
    assert (got[2].leaves, got[2].n_paragraphs) == (None, 0)


def test_a_sentence_of_all_documents(make):
    rows = [(i, f"Document number {i} of many.\nAll rights reserved.\nIts own words {i}.") for i in range(3000)]
    got = {r.doc_id: r for r in M.fingerprints(make(rows)).collect()}
    assert len(got) == 3000 and all(r.base == 0 and r.changed_paragraphs == "1,3" for k, r in got.items() if k)


def test_edges(make):
    df = make(EDGES, clash=True)
    rows = M.fingerprints(df).collect()
    assert len(rows) == len(EDGES)
    assert [(r.root, r.n_paragraphs, r.n_sections, r.base) for r in rows if r.doc_id == 2] == [(None, 0, 0, None)]
    assert [(r.root, r.n_paragraphs) for r in rows if r.doc_id == 1] == [(tree("")[2], 1)]
    assert sorted((r.base is None, r.same) for r in rows if r.doc_id == 5) == [(False, True), (True, None)]
    assert M.fingerprints(df.limit(0)).count() == 0
