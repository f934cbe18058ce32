"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, packed, raw, slices, table

HIDDEN = 12
WINDOW = 128
#: The classifier is fitted on so many labelled documents of each language at most, all their windows being drawn from.
TRAIN_DOCS = 200
#: Of a text of more characters than this, so many windows, drawn where the text is, stand for all of them: the driver holds so many bytes of a document at most.
WHOLE, TRAIN_WINDOWS = 64 * 1024, 1024
#: Languages of fewer labelled documents than this can't be learned; their documents are classed with the others.
MIN_DOCS = 5
STEPS, BATCH, RATE = 240, 128, 0.02
#: A document is rejected if it is of no language to this degree, as a mean over its bytes: numbers and names within prose don't make it none.
MIN_NONE = 0.75
#: The class of what is no language: digits, symbols, random letters and bytes.
NONE = "und"

Params = dict[str, np.ndarray]


def init(classes: int, hidden: int = HIDDEN, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        p[f"x{d}"][: 2 * hidden] += np.float32(0.5)
        p[f"u{d}"] = rng.normal(0, 0.5 * hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        p[f"c{d}"] = np.zeros((hidden, 1), np.float32)
        p[f"v{d}"] = rng.normal(0, hidden**-0.5, (classes, hidden)).astype(np.float32)
    p["o"] = np.zeros((classes, 1), np.float32)
    return p


def _direction(p: Params, d: str, x: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States of one direction, time by hidden by window.  x: time by window.  keep: gets what backpropagation needs.

    The gates are piecewise linear, clipped to 0 and 1, and the candidate state is
    m / (1 + |m|): these cost a tenth of exponentials.
    """
    steps, n = x.shape
    hid = p[f"u{d}"].shape[1]
    u, c, emb = p[f"u{d}"], p[f"c{d}"], p[f"x{d}"]
    h = np.zeros((hid, n), np.float32)
    e = np.empty((3 * hid, n), np.float32)
    out = np.empty((steps, hid, n), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        emb.take(x[t], axis=1, out=e, mode="clip")
        a = u @ h
        g = a[: 2 * hid]
        g += e[: 2 * hid]
        np.maximum(g, np.float32(0), out=g)
        np.minimum(g, np.float32(1), out=g)
        z, r = g[:hid], g[hid:]
        q = a[2 * hid :]
        q += c
        m = r * q
        m += e[2 * hid :]
        s = np.abs(m)
        s += np.float32(1)
        m /= s
        new = h - m
        new *= z
        new += m
        if mask is not None:
            new *= mask[t]
        if keep is not None:
            keep.append((t, h, z, r, q, m))
        h = new
        out[t] = h
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=-2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-2, keepdims=True)
    return logits


def forward(p: Params, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Probabilities, time by class by window."""
    return _softmax(p["vf"] @ _direction(p, "f", x, mask) + p["vb"] @ _direction(p, "b", x, mask) + p["o"])


def gradient(p: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: _direction(p, d, x, mask, kept[d]) for d in "fb"}
    prob = _softmax(p["vf"] @ states["f"] + p["vb"] @ states["b"] + p["o"])
    total = mask.sum()
    at = np.arange(x.shape[1])
    loss = float(-(np.log(prob[:, y, at] + 1e-9) * mask).sum() / total)
    dl = prob.copy()
    dl[:, y, at] -= 1
    dl *= mask[:, None, :] / total
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"] = dl.sum(axis=(0, 2))[:, None]
    for d in "fb":
        hid = p[f"u{d}"].shape[1]
        g[f"v{d}"] = np.einsum("tcn,thn->ch", dl, states[d])
        dh = np.zeros((hid, x.shape[1]), np.float32)
        das, xs = [], []
        for t, h, z, r, q, m in reversed(kept[d]):
            dh = (dh + p[f"v{d}"].T @ dl[t]) * mask[t]
            dm = dh * (1 - z) * (1 - np.abs(m)) ** 2
            dz = dh * (h - m) * ((z > 0) & (z < 1))
            dq = dm * r
            dr = dm * q * ((r > 0) & (r < 1))
            du = np.concatenate([dz, dr, dq])
            g[f"u{d}"] += du @ h.T
            g[f"c{d}"] += dq.sum(axis=1, keepdims=True)
            das.append(np.concatenate([dz, dr, dm]))
            xs.append(x[t])
            dh = dh * z + p[f"u{d}"].T @ du
        da, ids = np.concatenate(das, axis=1), np.concatenate(xs)
        order = np.argsort(ids, kind="stable")
        begin = np.flatnonzero(np.diff(ids[order], prepend=-1))
        g[f"x{d}"][:, ids[order][begin]] = np.add.reduceat(da[:, order], begin, axis=1)
    return loss, g


def windows(data: np.ndarray, off: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the windows of all texts; each byte lies in exactly one."""
    size = np.diff(off)
    n = -(-size // width)
    text = np.repeat(np.arange(len(size)), n)
    ends = np.cumsum(n)
    nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
    return off[text] + nth * width, np.minimum(width, size[text] - nth * width), text


def _noise(rng: np.random.Generator, n: int) -> list[bytes]:
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz      ", np.uint8)
    signs = np.frombuffer(b"0123456789 .,;:!?#$%&*+-/<=>@[]^_{|}~()\"'\\\n", np.uint8)
    out = []
    for i in range(n):
        size = int(rng.integers(WINDOW // 2, WINDOW + 1))
        kind = i % 4
        if kind == 0:
            w = rng.choice(signs, size)
        elif kind == 1:
            w = rng.integers(0, 256, size).astype(np.uint8)
        elif kind == 2:
            w = rng.choice(letters, size)
        else:
            w = rng.integers(33, 127, size).astype(np.uint8)
        out.append(w.astype(np.uint8).tobytes())
    return out


def _cut(b: bytes) -> list[bytes]:
    """All windows of a text."""
    return [b[i : i + WINDOW] for i in range(0, len(b), WINDOW)]


def _draw(b: bytes, rng: np.random.Generator) -> list[bytes]:
    """TRAIN_WINDOWS windows of a text, wherever they lie in it."""
    return [b[k * WINDOW : (k + 1) * WINDOW] for k in rng.permutation(-(-len(b) // WINDOW))[:TRAIN_WINDOWS]]


def train(texts: list[str | list[bytes]], labels: list[str], *, steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> tuple[list[str], Params]:
    """(classes, parameters), fitted with Adam to windows of the texts (or those that sample drew of each), some cut short, some in capitals, and to noise.

    Each example is any window of any document of a class, documents being as likely as each other.
    """
    rng = np.random.default_rng(seed)
    classes = [*sorted(set(labels)), NONE]
    pool: dict[str, list[list[bytes]]] = {c: [] for c in classes}
    for text, label in zip(texts, labels, strict=True):
        pool[label].append(_cut(text.encode()) if isinstance(text, str) else text)
    pool[NONE] = [_noise(rng, 2048)]
    p = init(len(classes), hidden, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(classes), BATCH)
        x = np.zeros((WINDOW, BATCH), np.intp)
        mask = np.zeros((WINDOW, BATCH), np.float32)
        for i, c in enumerate(y):
            doc = pool[classes[c]][int(rng.integers(len(pool[classes[c]])))]
            b = doc[int(rng.integers(len(doc)))]
            u = rng.random()
            if u < 0.1:
                b = b.decode(errors="ignore").upper().encode()[:WINDOW]
            elif u < 0.3 and classes[c] != NONE:
                b = b[: int(rng.integers(min(8, len(b)), len(b) + 1))] if len(b) else b
            x[: len(b), i] = np.frombuffer(b, np.uint8)
            mask[: len(b), i] = 1
        if not mask.sum():
            continue
        _, g = gradient(p, x, mask, y)
        norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
        rate = RATE * min(1, step / 20) * (0.1 if step > 0.8 * steps else 1)
        for k, v in g.items():
            v = v * np.float32(min(1, 1 / max(norm, 1e-6)))
            m1, m2 = moments[k]
            m1 += np.float32(0.1) * (v - m1)
            m2 += np.float32(0.01) * (v * v - m2)
            p[k] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return classes, p


def predict(p: Params, data: np.ndarray, off: np.ndarray, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the probabilities over the positions, positions labelled so), text by class; of classes that tie the first has the position."""
    k, n = p["o"].shape[0], len(off) - 1
    sums, votes = np.zeros((n, k)), np.zeros((n, k), np.int64)
    start, size, text = windows(data, off)
    data = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    for full in (True, False):
        which = np.flatnonzero((size == WINDOW) == full)
        for i in range(0, len(which), at_once):
            w = which[i : i + at_once]
            x = data[start[w][None, :] + np.arange(WINDOW)[:, None]].astype(np.intp)
            mask = None if full else (np.arange(WINDOW)[:, None] < size[w][None, :]).astype(np.float32)
            prob = forward(p, x, mask)
            hit = prob.argmax(axis=1)[:, None, :] == np.arange(k)[None, :, None]
            if mask is not None:
                prob *= mask[:, None, :]
                hit &= mask[:, None, :] > 0
            np.add.at(sums, text[w], prob.sum(axis=0).T)
            np.add.at(votes, text[w], hit.sum(axis=0).T)
    return sums, votes


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of WHOLE characters at most, and windows of each longer one, drawn by its hash."""
    for b in batches:
        texts, drawn, seeds = b.column("text").to_pylist(), [], []
        for i, text in enumerate(texts):
            whole = text.encode()
            seeds.append(hashlib.blake2b(whole, digest_size=8).digest())
            drawn.append([])
            if len(text) > WHOLE:
                texts[i] = None
                drawn[i] = _draw(whole, np.random.default_rng(int.from_bytes(seeds[i], "big")))
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("u"), pa.array(seeds, pa.binary()), pa.array(texts, pa.string()), pa.array(drawn, pa.list_(pa.binary()))], ["lang", "u", "hash", "text", "windows"])


def sample(docs: DataFrame, *, per_language: int = TRAIN_DOCS) -> tuple[list[str | list[bytes]], list[str]]:
    """At most per_language labelled texts of each language, drawn by a hash of their id, whole; of those of more than WHOLE characters TRAIN_WINDOWS windows, drawn where the text is."""
    counts = {r[0]: r[1] for r in docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).groupBy("lang").count().collect() if r[1] >= MIN_DOCS and r[0] != NONE}
    if not counts:
        return [], []
    drawn = (F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
    bound = F.lit(0.0)
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_language / n))).otherwise(bound)
    some = docs.select("lang", "text", drawn.alias("u")).filter((F.col("u") < bound) & (F.octet_length("text") > 0))
    got = some.mapInArrow(_windows, "lang string, u double, hash binary, text string, windows array<binary>").collect()
    out: dict[str, list[str | list[bytes]]] = {}
    for r in sorted(got, key=lambda r: (r["u"], bytes(r["hash"]))):
        if len(mine := out.setdefault(r["lang"], [])) < per_language:
            mine.append(r["text"] if r["text"] is not None else [bytes(w) for w in r["windows"]])
    return [t for ts in out.values() for t in ts], [c for c, ts in out.items() for _ in ts]


def _label(classes: list[str], p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                data, off = raw(s.column("text"))
                sums, votes = predict(p, data, off)
                size = np.diff(off)
                prob = sums / np.maximum(size, 1)[:, None]
                best = prob.argmax(axis=1)
                names = [classes[k] if n else None for k, n in zip(best, size, strict=True)]
                counts = pa.ListArray.from_arrays(np.arange(0, votes.size + 1, len(classes), dtype=np.int32), pa.array(votes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in s.schema.names), pa.array(names, pa.string()), pa.array(prob.max(axis=1) * (size > 0)), counts], [*s.schema.names, "predicted", "prob", "positions"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], Params] | None = None, *, min_none: float = MIN_NONE) -> DataFrame:
    """docs with `predicted`, `prob`, `positions` and `keep`.

    The network reads each text as windows of WINDOW bytes, every byte in exactly one
    of them, and gives each byte a probability for each language it was trained on and
    for none ("und").  prob is the mean over all bytes of the whole text of the best
    class, predicted; positions counts the bytes by best class, each byte once, classes
    in alphabetical order with "und" last.  Of classes that tie, for a byte or for a
    text, the first has it.  keep is false for documents predicted to be of no language
    with a prob of min_none or more; prose whose language is in doubt, as that of a
    single word may be, is kept.

    The model, unless given, is trained on at most TRAIN_DOCS documents of each
    language in the column lang that has MIN_DOCS of them at least, whole (of those of
    more than WHOLE characters, on TRAIN_WINDOWS windows wherever they lie); rarer
    languages are not among the classes.  Null and empty texts have null predicted,
    prob 0 and aren't kept; texts may be of any length.  If no language has MIN_DOCS
    labelled documents, as in an empty table, nothing can be told: predicted is null,
    prob 0, positions empty, and all that have text are kept.  Rows aren't dropped,
    repeated or merged; columns named like the four new ones are replaced.
    """
    base, back = packed(docs, "predicted", "prob", "positions", "keep")
    if model is None:
        texts, labels = sample(docs)
        model = train(texts, labels) if texts else None
    if model is None:
        none = base.select(*back()).withColumns({"predicted": F.lit(None).cast("string"), "prob": F.lit(0.0), "positions": F.array().cast("array<long>")})
        return none.withColumn("keep", F.coalesce(F.octet_length("text") > 0, F.lit(False)))
    schema = T.StructType([*base.schema, T.StructField("predicted", T.StringType()), T.StructField("prob", T.DoubleType()), T.StructField("positions", T.ArrayType(T.LongType()))])
    out = base.mapInArrow(_label(*model), schema).select(*back(), "predicted", "prob", "positions")
    return out.withColumn("keep", F.col("predicted").isNotNull() & ((F.col("predicted") != NONE) | (F.col("prob") < min_none)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs).select("doc_id", "lang", "predicted", F.round("prob", 4).alias("prob"), "positions", "keep")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are of no language to MIN_NONE or more, and null and empty texts; repeated rows are treated alike, an empty table stays one."""
    base, back = packed(docs.withColumn("__lang", F.col("lang")))
    return identify(base.withColumn("lang", F.col("__rest")["__lang"])).filter("keep").select(*back()).drop("__lang")
