import pytest

SF = "/root/testdata/sf0.001"
#: Names that operators use themselves, as further columns of an input.
CLASHING = ["key", "__key", "root", "group_id", "label", "line", "gone", "want", "band", "regs", "kind", "size", "bin", "at", "h1", "leaves", "sections", "base", "host", "on", "a.b"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """A table of (doc_id, text) rows, with clashing columns if asked for."""

    def f(rows, clash=False):
        names = ["doc_id", "text", "lang", "source", "n_chars", *(CLASHING if clash else [])]
        schema = ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names)
        data = [(k, t, None, "s", len(t) if t is not None else None, *(f"{c}!" for c in names[5:])) for k, t in rows]
        return spark.createDataFrame(data, schema)

    return f


LONG = " ".join(f"word{i % 5000} and{i % 7}" for i in range(60_000))
#: Null and empty texts, null ids, repeated ids and rows, a very long text, texts without words.
EDGES = [(None, None), (None, "orphan text with some seven words here"), (1, ""), (2, None), (3, LONG), (3, LONG), (4, "same line with five words\nsame line with five words"), (4, "another text under an id that repeats"), (5, "... !!! ---\n\n\n"), (5, "... !!! ---\n\n\n"), (6, "\n"), (7, "ünï cödé wörds ärè hëre töö 漢字 かな")]
