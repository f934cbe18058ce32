"""Each stage of the pipeline against a brute-force version of it, on what the stage before kept."""

import corpus_pipeline
from fathom.llm import hyperminhash, langid, packing, spm

from . import test_hyperminhash, test_linededup, test_packing, test_secrets
from .conftest import EDGES


def test_stages(spark, sf, documents, tmp_path):
    docs = documents
    columns = docs.columns
    inputs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    rows = [[(r.doc_id, r.text) for r in x.collect()] for x in inputs]

    # Language: one document at a time, by the same network.
    model = langid.train(*langid.sample(documents))
    import pyarrow as pa

    from fathom.llm.common import raw

    kept = set()
    for k, t in rows[0]:
        sums, _ = langid.predict(model[1], *raw(pa.array([t])))
        prob = sums[0] / max(1, len(t.encode()))
        if t and (model[0][int(prob.argmax())] != langid.NONE or prob.max() < langid.MIN_NONE):
            kept.add(k)
    assert {k for k, _ in rows[1]} == kept

    # Lines.
    want = [(k, t) for (k, t), (_, old) in zip(sorted(test_linededup.brute(rows[1])), sorted(rows[1]), strict=True) if t == old or t.strip()]
    assert sorted(rows[2]) == want

    # Near-duplicates, by the texts that came and then by what line dedup left: no two
    # that are kept belong together, but for a tenth that may be missed.
    came = dict(rows[0])
    ids = [k for k, _ in sorted(rows[2])]
    left = {k for k, _ in rows[3]}
    assert left <= set(ids) and all((k, t) in rows[2] for k, t in rows[3])
    near = test_hyperminhash.pairs([came[k] for k in ids], hyperminhash.THRESHOLD)
    root = test_hyperminhash.groups(len(ids), near)
    firsts = [k for k, r in zip(ids, root, strict=True) if ids[r] == k]
    now = dict(rows[2])
    again = test_hyperminhash.groups(len(firsts), test_hyperminhash.pairs([now[k] for k in firsts], hyperminhash.THRESHOLD))
    want = {firsts[r] for r in again}
    assert want <= left and len(left - want) <= 0.1 * (len(ids) - len(want)) + 1

    # Secrets.
    for k, t in rows[3]:
        for name, a, b, _ in reversed(test_secrets.brute(t) if any(x in t.lower() for d in test_secrets.S.DETECTORS for x in d.keywords) else []):
            t = f"{t[:a]}[{name}]{t[b:]}"
        assert (k, t) in rows[4]

    codec = spm.Codec(spm._load(spm.MODEL))
    test_packing.holds(docs.collect(), test_packing.totals(codec, rows[4]), packing.CAPACITY)


def test_run_is_the_stages(spark, sf, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda r: (r.doc_id, r.piece, r.size)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, docs.collect()))


def test_edges(spark, make, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, clashing names, and an empty table go through all stages."""
    secret = test_secrets.token("ghp", 5)
    rows = [*EDGES, (8, f"a text with {secret} in it"), (8, f"a text with {secret} in it"), (9, "one more line of plain words\nand another line of plain words")]
    docs = make(rows, clash=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for some in (docs, docs.limit(0)):
        now = some
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            assert i == len(corpus_pipeline.STAGES) - 1 or (now.columns == docs.columns and now.count() <= some.count())
        out = now.collect()
        assert len(out) > 0 if some is docs else out == []
    plain = make(rows).drop("n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, plain, str(tmp_path))
        assert plain.columns == ["doc_id", "text", "lang", "source"]
    texts = [r.text for r in plain.collect()]
    assert not any(secret in t for t in texts) and sum("[github_token]" in t for t in texts) == 1
