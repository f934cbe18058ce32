"""Removal of near-equal lines by an exact set-similarity join."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, checked, grouped, jaccard, keyed, mix, packed, recounted, slices, unique_in, word_hashes

THRESHOLD = 0.9
MIN_WORDS = 1
SKETCH_BITS = 20
_CHUNK = 1 << 16
#: Rows of a word of the prefixes that one task compares; the rows of a hotter word are dealt to several.
HOT = 1 << 17


def least_overlap(total, t: float):
    """The least overlap of two sets with `total` words together and Jaccard similarity t, on integers: rounded first, as t is binary."""
    return np.ceil(np.round(total * (t / (1 + t)), 9)).astype(np.int64)


def least_joined(t: float) -> int:
    """The least size of a set that a larger one can resemble: s of its s + 1 words are common at best."""
    s = 1
    while s < t * (s + 1) - 1e-9 and t < 1:
        s += 1
    return s


def _count(bits: int):
    """Counts of words by the high bits of their hash, a compressed row for each chunk of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for s in slices(b, "text"):
                h = word_hashes(s.column("text"))[0]
                np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        parts = [(i, c) for i, c in enumerate(counts.reshape(-1, min(_CHUNK, 1 << bits))) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for _, c in parts], pa.binary())], ["chunk", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the chunks and keeps a byte for each bucket: 8 times the binary logarithm of its count."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
            now = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
            total[i] = total[i] + now if i in total else now
    out = [np.minimum(255, np.round(8 * np.log2(c + np.uint64(1)))).astype(np.uint8).tobytes() for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], ["chunk", "counts"])


def rarity(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How frequent the words of each bucket of hashes are over all documents, as a byte.

    Any order of words that is the same everywhere makes the join exact, so a table
    of fixed size (2**bits bytes, however large the corpus) serves: rare words come
    out rare unless they share a bucket with a frequent one.
    """
    parts = docs.select("text").mapInArrow(_count(bits), "chunk int, counts binary")
    rows = parts.repartition("chunk").mapInArrow(_add, "chunk int, counts binary").collect()
    out = np.zeros((1 << bits) // min(_CHUNK, 1 << bits) * min(_CHUNK, 1 << bits), np.uint8).reshape(-1, min(_CHUNK, 1 << bits))
    for i, c in rows:
        out[i] = np.frombuffer(c, np.uint8)
    return out.reshape(-1)


_LINES = "key long, line int, h1 long, h2 long, again boolean, size int, bits long, prefix array<int>"


def _sets(rare: np.ndarray, t: float, least: int):
    """A row for each line of `least` distinct words or more: a 128-bit hash of its set of words, its prefix in order of rarity, and a bitmap.

    again is true where the same set occurred before in these rows, so that of a line
    that all documents have few rows go on.  Lines too short to resemble any but their
    equals have no prefix.
    """
    shift = np.uint64(64 - int(len(rare)).bit_length() + 1)
    joined = least_joined(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                h, where, counts = word_hashes(s.column("text"), lines=True)
                w, h = unique_in(where, h)
                if not len(h):
                    continue
                begin = np.flatnonzero(np.diff(w, prepend=-1))
                size = np.diff(begin, append=len(w))
                h1, h2 = np.add.reduceat(mix(h + np.uint64(1)), begin), np.add.reduceat(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), begin)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), begin)
                line = w[begin]
                first = np.concatenate([[0], np.cumsum(counts)])
                doc = np.searchsorted(first, line, "right") - 1
                key, nth = s.column("__key").to_numpy()[doc], line - first[doc]
                order = np.lexsort((nth, key, h2, h1))
                same = np.zeros(len(order), bool)
                same[1:] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
                again = np.zeros(len(order), bool)
                again[order] = same
                # Only what may be joined needs its words in order.
                wide = ~again & (size >= joined)
                keep = np.repeat(wide, size)
                w, h, size_ = w[keep], h[keep], size[wide]
                r = rare[(h >> shift).astype(np.int64)]
                order = np.argsort((np.repeat(np.arange(len(size_), dtype=np.uint64), size_) << np.uint64(40)) | (r.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))) if len(size_) < 1 << 24 else np.lexsort((h, r, w))
                w, h, r = w[order], h[order], r[order]
                tie = (w[1:] == w[:-1]) & (r[1:] == r[:-1]) & (h[1:] >> np.uint64(32) == h[:-1] >> np.uint64(32))
                if tie.any():
                    order = np.lexsort((h, r, w))
                    h = h[order]
                p = np.zeros(len(size), np.int64)
                p[wide] = size_ - np.ceil(np.round(size_ * t, 9)).astype(np.int64) + 1
                q = p[wide]
                begin = np.cumsum(size_) - size_
                ends = np.cumsum(q)
                at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - q, q) + np.repeat(begin, q)
                on = size >= least
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[on]),
                        pa.array(nth[on].astype(np.int32)),
                        *(pa.array(x[on].view(np.int64)) for x in (h1, h2)),
                        pa.array(again[on]),
                        pa.array(size[on].astype(np.int32)),
                        pa.array(bits[on].view(np.int64)),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(p)]).astype(np.int32), pa.array((h[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))).filter(pa.array(on)),
                    ],
                    ["key", "line", "h1", "h2", "again", "size", "bits", "prefix"],
                )

    return run


_PAIRS = "key long, line int, key0 long, line0 int"


def _candidates(t: float, at_once: int = 1 << 21):
    """Pairs of lines that share a word of their prefixes and pass the filters by length, position and bitmap.

    Rows come sorted by word, cell, size, key and line.  The later of a pair in this
    order must have the word in its prefix, the earlier one in a shorter prefix, as a
    set that is no larger shows itself sooner (index).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["word", "cell"]):
            word, cell, size, pos, key, line = (g.column(c).to_numpy().astype(np.int64) for c in ("word", "cell", "size", "pos", "key", "line"))
            probe, index = (g.column(c).to_numpy() for c in ("probe", "index"))
            bits = g.column("bits").to_numpy().view(np.uint64)
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (cell[1:] != cell[:-1])
            group = np.cumsum(new) - 1
            top = int(size.max()) + 1
            held = np.flatnonzero(index)
            place = group[held] * top + size[held]
            i = np.flatnonzero(probe)
            lo = np.searchsorted(place, group[i] * top + np.ceil(np.round(size[i] * t, 9)).astype(np.int64), "left")
            n = np.maximum(np.searchsorted(held, i, "left") - lo, 0)
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
                for x, y in _expand(i[at:to], lo[at:to], n[at:to], at_once):
                    y = held[y]
                    total = size[x] + size[y]
                    need = least_overlap(total, t)
                    ok = np.minimum(size[x] - pos[x], size[y] - pos[y]) >= need
                    ok &= (key[x] != key[y]) | (line[x] != line[y])
                    x, y, total, need = x[ok], y[ok], total[ok], need[ok]
                    ok = np.bitwise_count(bits[x] ^ bits[y]) <= total - 2 * need
                    x, y = x[ok], y[ok]
                    later = (key[x] > key[y]) | (key[x] == key[y]) & (line[x] > line[y])
                    a, b = np.where(later, x, y), np.where(later, y, x)
                    yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(line[a].astype(np.int32)), pa.array(key[b]), pa.array(line[b].astype(np.int32))], ["key", "line", "key0", "line0"])
                at = to

    return run


def _words(sets: DataFrame, t: float, scratch: Scratch, hot: int) -> DataFrame:
    """A row for each word of each prefix, in the cells where it is compared.

    Most words have one cell.  Of a hot one the rows are dealt to k parts as probes
    and to k as index, and each of the k * k cells has one part of each.
    """
    shorter = F.col("size") - F.ceil(F.round(F.col("size") * F.lit(2 * t / (1 + t)), 9)).cast("int") + 1
    words = sets.select("key", "line", "size", "bits", F.posexplode("prefix").alias("pos", "word"))
    words = words.withColumn("index", F.col("pos") < shorter)
    many = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("index").alias("some")).filter((F.col("n") > hot) & F.col("some"))
    many = scratch.write("hot", many.select("word", F.ceil(F.col("n") / hot).cast("int").alias("k")))
    n = many.count()
    if not n:
        return words.withColumns({"cell": F.lit(0), "probe": F.lit(True)})
    words = words.join(checked(many, n, 16), "word", "left")
    part = F.pmod(F.xxhash64("key", "line"), F.col("k")).cast("int")
    others = F.sequence(F.lit(0), F.col("k") - 1)
    cells = lambda c, probe: F.transform(others, lambda j: F.struct(c(j).alias("cell"), F.lit(probe).alias("probe"), F.lit(not probe).alias("index")))
    as_probe, as_index = cells(lambda j: part * F.col("k") + j, True), cells(lambda j: j * F.col("k") + part, False)
    one = F.array(F.struct(F.lit(0).alias("cell"), F.lit(True).alias("probe"), F.col("index").alias("index")))
    dealt = F.when(F.col("k").isNull(), one).when(F.col("index"), F.concat(as_probe, as_index)).otherwise(as_probe)
    return words.select("key", "line", "size", "bits", "pos", "word", F.explode(dealt).alias("c")).select("key", "line", "size", "bits", "pos", "word", "c.cell", "c.probe", "c.index")


def _expand(i: np.ndarray, lo: np.ndarray, n: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(i) == 1 and n[0] > at_once:
        for k in range(0, int(n[0]), at_once):
            y = np.arange(lo[0] + k, lo[0] + min(k + at_once, n[0]))
            yield np.full(len(y), i[0]), y
    else:
        ends = np.cumsum(n)
        yield np.repeat(i, n), np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(lo, n)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the lines whose numbers come with each document."""
    for b in batches:
        for s in slices(b, "text"):
            key, line, text = [], [], []
            for k, x, want in zip(*(s.column(c).to_pylist() for c in ("__key", "text", "want")), strict=True):
                parts = (x or "").split("\n")
                for i in want:
                    key.append(k)
                    line.append(i)
                    text.append(parts[i])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(line, pa.int32()), pa.array(text, pa.string())], ["key", "line", "text"])


def _verify(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                j = jaccard(s.column("text"), s.column("text0"), 1)
                yield s.filter(pa.array(j >= t - 1e-12)).select(["key", "line"])

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the lines in `gone`, and how many lines each had and lost."""
    for b in batches:
        for s in slices(b, "text", 8 << 20):
            text, lines, lost = [], [], []
            for x, gone in zip(s.column("text").to_pylist(), s.column("gone").to_pylist(), strict=True):
                lines.append(x.count("\n") + 1 if x is not None else 0)
                lost.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    x = "\n".join(p for i, p in enumerate(x.split("\n")) if i not in out)
                text.append(x)
            keep = [c for c in s.schema.names if c not in ("text", "gone")]
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(text, pa.string()), pa.array(lines, pa.int32()), pa.array(lost, pa.int32())], [*keep, "text", "n_lines", "n_removed"])


def removed_lines(docs: DataFrame, scratch: Scratch, *, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, sketch_bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """(key, line) of the lines to remove from docs (__key, text)."""
    t = threshold
    docs = docs.select("__key", "text")
    rare = rarity(docs, sketch_bits)
    sets = scratch.write("sets", docs.mapInArrow(_sets(rare, t, min_words), _LINES))
    # Of equal sets the first stays: its document is the least, and within a document, or a slice of several, it was told before.
    new = sets.filter("not again")
    first = new.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    repeats = scratch.write("repeats", new.select("h1", "h2", "key", "line").join(first, ["h1", "h2"]).filter("key <> first").select("key", "line"))
    again = sets.filter("again").select("key", "line").unionByName(repeats)
    single = new.filter(F.size("prefix") > 0).join(checked(repeats, repeats.count(), 24), ["key", "line"], "left_anti")
    words = _words(single, t, scratch, hot).repartition("word", "cell").sortWithinPartitions("word", "cell", "size", "key", "line")
    pairs = scratch.write("pairs", words.mapInArrow(_candidates(t), _PAIRS).distinct())
    n = pairs.count()
    want = pairs.select("key", "line").unionByName(pairs.select(F.col("key0").alias("key"), F.col("line0").alias("line"))).groupBy("key").agg(F.array_sort(F.collect_set("line")).alias("want"))
    want = want.withColumnRenamed("key", "__key")
    texts = scratch.write("texts", docs.join(checked(want, 2 * n, 24), "__key").mapInArrow(_pick, "key long, line int, text string"))
    old = texts.select(F.col("key").alias("key0"), F.col("line").alias("line0"), F.col("text").alias("text0"))
    found = pairs.join(texts, ["key", "line"]).join(old, ["key0", "line0"]).select("key", "line", "text", "text0")
    found = found.mapInArrow(_verify(t), "key long, line int")
    gone = again.unionByName(found).distinct()
    return scratch.write("gone", gone.groupBy("key").agg(F.collect_list("line").alias("gone")))


def dedup_lines(docs: DataFrame, *, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, sketch_bits: int = SKETCH_BITS, hot: int = HOT) -> DataFrame:
    """docs without lines that match an earlier line, with n_lines and n_removed.

    Lines are the pieces of `text` between newlines, as sets of lower-case words,
    in the order (doc_id, line number).  A line goes if any earlier line, kept or not,
    has a Jaccard similarity of at least `threshold` with it; lines without a word,
    and those of fewer than min_words distinct words if more than 1 are asked for,
    always stay.  The join is exact: lines with equal sets are found by a 128-bit
    hash; the others must share one of the rarest words of both (prefix filter), agree
    in length, leave room for enough common words after it (positional filter), and
    not differ in too many bits of a bitmap; what remains is verified on the texts.
    Rows of a word that has more than `hot` are compared by several tasks.

    A null text stays null, with no lines; an empty text is one empty line; a text of
    any length is read whole; an empty table gives an empty one.  Rows
    with the same doc_id are ordered by text, a null doc_id comes first, so the
    later ones of repeated rows lose their lines.  No rows are dropped here; other
    columns pass through, and the two counts replace columns of their name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base, back = packed(docs, "n_lines", "n_removed")
    rows = keyed(base, scratch)
    gone = removed_lines(rows, scratch, threshold=threshold, min_words=min_words, sketch_bits=sketch_bits, hot=hot)
    for name in ("pairs", "texts", "sets", "repeats"):
        scratch.drop(name)
    size = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    rows = rows.join(checked(gone, 1, 40 * size[0] + 4 * size[1]), rows["__key"] == gone["key"], "left").drop("key", "__key")
    others = [f for f in rows.schema if f.name not in ("text", "gone")]
    counts = [T.StructField(c, T.IntegerType()) for c in ("n_lines", "n_removed")]
    out = rows.select(*(f.name for f in others), "text", "gone").mapInArrow(_strip, T.StructType([*others, T.StructField("text", T.StringType()), *counts]))
    return out.select(*back(), "n_lines", "n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, and the documents of which nothing is left; n_chars, where there is one, follows the text.

    Null and empty texts, which have lost nothing, stay; an empty table stays one.
    """
    base, back = packed(docs)
    out = dedup_lines(base)
    left = (F.col("n_removed") == 0) | (F.col("text").rlike(r"\S"))
    return recounted(out.filter(left), F.col("n_removed") > 0, docs, back)


_WORDS = r"list_distinct(regexp_extract_all(lower(line), '[a-z0-9\x{80}-\x{10FFFF}]+'))"
OP2_SQL = rf"""
WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT doc_id, i, list_sort({_WORDS}) AS words FROM l),
lines AS MATERIALIZED (SELECT doc_id, i, words, len(words) AS size, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS nth FROM w WHERE len(words) >= {MIN_WORDS}),
sets AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, i) AS id, doc_id, i, words, size FROM lines WHERE nth = 1),
tokens AS MATERIALIZED (SELECT id, size, unnest(words) AS word FROM sets),
rarity AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
prefix AS MATERIALIZED (SELECT id, size, word FROM tokens JOIN rarity USING (word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n, word) <= size - ceil(round(size * {THRESHOLD}, 9)) + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.id AS later, b.id AS earlier FROM prefix a JOIN prefix b USING (word) WHERE a.id > b.id AND least(a.size, b.size) >= greatest(a.size, b.size) * {THRESHOLD} - 1e-9),
close AS (SELECT DISTINCT later FROM (SELECT later, a.size + b.size AS total, len(list_intersect(a.words, b.words)) AS common FROM pairs JOIN sets a ON a.id = later JOIN sets b ON b.id = earlier) WHERE common >= {THRESHOLD} * (total - common) - 1e-9),
gone AS (SELECT doc_id, i FROM lines WHERE nth > 1 UNION SELECT doc_id, i FROM sets JOIN close ON later = id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
