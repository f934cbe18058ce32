"""Encoding against the library that the model is made for, and the round trip."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from fathom.llm import spm as S

from .conftest import EDGES


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S._load(S.MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "hello world", "  two  spaces ", "line\nbreak\n\n", " \n x", "\t tab", "ünïcödé 漢字 😀", "▁", "a▁b ▁ c", "<s> </s> <unk>", "<0x41>", "x" * 5000, "é" * 300, "\x00\x01", "aaaa bbbb " * 50, "!?!?" * 100, "don't  stop\n\n\tnow"]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(codec, library, text):
    assert codec.encode(text).tolist() == library.encode(text)


def test_equals_the_library_on_random_texts(codec, library):
    rng = random.Random(1)
    pieces = [p.text.replace("▁", " ") for p in codec.pieces if p.kind == 1]
    for _ in range(400):
        text = "".join(rng.choice(pieces if rng.random() < 0.7 else [" ", "a", "é", "\n", "1"]) for _ in range(rng.randint(1, 40)))
        assert codec.encode(text).tolist() == library.encode(text)
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text))


def test_backtracking_equals_merging(codec):
    rng = random.Random(2)
    letters = [c for c in codec.chars if c.isascii() and c.isalpha()]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert codec.backtrack(text) == codec.merge(text)


def message(*fields):
    """A protocol buffer of (number, value)."""
    out = b""
    for k, v in fields:
        out += bytes([k << 3 | (0 if isinstance(v, int) else 5 if isinstance(v, float) else 2)])
        if isinstance(v, float):
            out += np.float32(v).tobytes()
        else:
            out += bytes([v]) if isinstance(v, int) else bytes([len(v)]) + v
    return out


def model(*pieces):
    """A model of the merge type of pieces (text, kind), earlier ones with the better score."""
    parts = [(1, message((1, "<unk>".encode()), (2, 0.0), (3, 2)))] + [(1, message((1, p.encode()), (2, -float(i)), (3, k))) for i, (p, k) in enumerate(pieces)]
    return message(*parts, (2, message((3, 2))), (3, message((1, b"identity"), (3, 1), (4, 0))))


def test_pieces_with_inner_spaces():
    codec = S.Codec(model(("▁a▁b", 1), ("▁a", 1), ("▁b", 1), ("b▁", 1), ("▁", 1), ("a", 1), ("b", 1), ("▁▁", 1)))
    assert not codec.by_words
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab  ") for _ in range(rng.randint(1, 12)))
        assert codec.encode(text).tolist() == codec.merge("▁" + text.replace(" ", "▁"))
    assert [codec.pieces[i].text for i in codec.encode("a b")] == ["▁a▁b"]
    assert S.Words(codec, pa.array(["a b", "a"])).fast.tolist() == [False, False]


@pytest.mark.parametrize("kind", [4, 5])
def test_other_kinds_of_pieces_are_refused(kind):
    with pytest.raises(ValueError):
        S.read_model(model(("▁", 1), ("a", 1), ("x", kind)))


def test_words_in_bulk(codec):
    texts = [*TEXTS, None, "plain words only", "some\nlines of\ntext", "x" * 100 + " " + "y" * 100]
    words = S.Words(codec, pa.array(texts))
    fast = [t for t, f in zip(texts, words.fast, strict=True) if f]
    assert "plain words only" in fast and "line\nbreak\n\n" in fast and "a  b" not in fast
    whole = [codec.encode(t).tolist() for t in fast]
    assert words.size.tolist() == [len(x) for x in whole] and words.ids().tolist() == [i for x in whole for i in x]
    assert words.exact.tolist() == [codec.decode(codec.encode(t)) == t for t in fast]


def test_counts(make):
    df = make([*EDGES, *((100 + i, t) for i, t in enumerate([*TEXTS, "a b ", "x ", "\nz", "a\nb "]))], clash=True)
    counted = sorted((r.doc_id or -1, r.n_tokens) for r in S.count(df.select("doc_id", "text")).collect())
    assert counted == sorted((r.doc_id or -1, r.n_tokens) for r in S.encode(df).collect())


def test_query(spark, sf, documents, library):
    got = {r.doc_id: r for r in S.op9_sentencepiece(spark, sf).collect()}
    for r in documents.collect():
        assert got[r.doc_id].ids == library.encode(r.text)
        assert got[r.doc_id].n_tokens == len(got[r.doc_id].ids) and got[r.doc_id].exact
    back = {r.doc_id: r.text for r in S.decode(spark.createDataFrame([(k, r.ids) for k, r in got.items()], "doc_id long, ids array<int>")).collect()}
    assert back == {r.doc_id: r.text for r in documents.collect()}


def test_edges(make, spark):
    df = make(EDGES, clash=True)
    rows = S.encode(df).collect()
    assert len(rows) == len(EDGES)
    assert [(r.ids, r.n_tokens, r.exact) for r in rows if r.doc_id == 2] == [(None, 0, None)]
    assert [(r.ids, r.n_tokens, r.exact) for r in rows if r.doc_id == 1] == [([], 0, True)]
    assert all(r.exact for r in rows if r.ids is not None)
    assert S.encode(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [5, None, 9]), (1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text is None for r in S.decode(odd).collect()] == [False, True, False]
    assert S.decode(odd.limit(0)).count() == 0
