"""Near-duplicate documents by banded HyperMinHash registers, verified on the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checked, columns, components, grouped, jaccard, keyed, mix, packed, shingles, slices, table, unique_in

THRESHOLD = 0.5
SHINGLE = 3
REGISTERS = 160
ROWS_PER_BAND = 4
#: Bits of mantissa that a register keeps beside its count of leading zeros.
MANTISSA = 10
#: Documents of a band that one task compares, where they are in several components; a band of more is dealt to several.
HOT = 1 << 13
EMPTY = 0xFFFF


def registers(where: np.ndarray, h: np.ndarray, texts: int, k: int = REGISTERS) -> np.ndarray:
    """A row of k registers for each text: of the least hash in each bucket, the leading zeros (6 bits) and the bits after the first one (10)."""
    bucket = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    least = np.full(texts * k, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, where * k + bucket.astype(np.int64), mix(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(1))
    empty = least == np.uint64(0xFFFFFFFFFFFFFFFF)
    v = np.maximum(least, np.uint64(1)) << np.uint64(1)
    zeros = 64 - np.frexp((v >> np.uint64(11)).astype(np.float64))[1] - 11
    zeros = np.minimum(zeros, 52).astype(np.uint64)
    after = (v << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | after).astype(np.uint16)
    out[empty] = EMPTY
    return out.reshape(texts, k)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with the empty ones filled from others, which ones being drawn by the empty one's place (densification)."""
    k = regs.shape[1]
    out = regs.copy()
    rows, cols = np.nonzero(regs == EMPTY)
    some = (regs != EMPTY).any(axis=1)
    rows, cols = rows[some[rows]], cols[some[rows]]
    tries = 0
    while len(rows):
        tries += 1
        donor = (mix(cols.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(tries)) % np.uint64(k)).astype(np.int64)
        got = regs[rows, donor]
        ok = got != EMPTY
        out[rows[ok], cols[ok]] = got[ok]
        rows, cols = rows[~ok], cols[~ok]
    return out


def band_hashes(regs: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """A hash for each band of so many filled registers."""
    four = filled(regs).astype(np.uint64).reshape(len(regs), -1, rows)
    h = np.arange(four.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + four[:, :, i])
    return h


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard similarity corrected for collisions of registers, its number of buckets) of rows of registers of sets of na and nb members."""
    k = a.shape[1]
    either = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    la, lb = na[:, None] / k, nb[:, None] / k
    i = np.arange(53)[None, :]
    hi, lo = 2.0**-i, 2.0 ** -(i + 1)
    chance = (hi - lo) / (1 << MANTISSA) * la * lb / np.maximum(la + lb, 1e-9) * (np.exp(-(la + lb) * lo) - np.exp(-(la + lb) * hi))
    expected = k * chance.sum(axis=1)
    return np.clip((equal - expected) / np.maximum(either - expected, 1), 0, 1), either


def _sign(k: int, words: int):
    """The registers of each text, and a 128-bit hash of its set of shingles; n is 0 for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                n = s.num_rows
                where, h = unique_in(*shingles(s.column("text"), words))
                count = np.bincount(where, minlength=n)
                sums = []
                for salt in (np.uint64(1), np.uint64(0xE7037ED1A0B428DB)):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, where, mix(h ^ salt))
                    sums.append(pa.array(total.view(np.int64)))
                regs = registers(where, h, n, k)
                yield pa.RecordBatch.from_arrays([s.column("__key"), pa.array(count.astype(np.int64)), *sums, pa.array([r.tobytes() for r in regs], pa.binary())], ["key", "n", "h1", "h2", "regs"])

    return run


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = band_hashes(_matrix(b.column("regs")), rows)
                label = [np.repeat(b.column(c).to_numpy(), h.shape[1]) for c in b.schema.names if c != "regs"]
                yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), *map(pa.array, label)], ["band", *(c for c in b.schema.names if c != "regs")])

    return run


def _crosses(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """All pairs of a cell that lie in different components; of two parts of a hot band only pairs of one with the other.  Rows come sorted by band and cell."""
    for g in grouped(batches, ["band", "cell"]):
        band, cell, part, key, label = (g.column(c).to_numpy() for c in ("band", "cell", "part", "key", "label"))
        apart = g.column("apart").to_numpy()
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (cell[1:] != cell[:-1])
        begin = np.flatnonzero(new)
        start = np.repeat(begin, np.diff(begin, append=len(band)))
        i = np.flatnonzero(np.arange(len(band)) > start)
        n = i - start[i]
        ends = np.cumsum(n)
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
            m, e = n[at:to], np.cumsum(n[at:to])
            x, y = np.repeat(i[at:to], m), np.arange(int(e[-1])) - np.repeat(e - m, m) + np.repeat(start[i[at:to]], m)
            ok = (label[x] != label[y]) & (~apart[x] | (part[x] != part[y]))
            x, y = x[ok], y[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[x], key[y])), pa.array(np.maximum(key[x], key[y]))], ["a", "b"])
            at = to


def _cells(labelled: DataFrame, scratch: Scratch, hot: int) -> DataFrame:
    """labelled (band, key, first, label) in the cells where its rows are compared.

    Bands all of whose documents are in one component are done; this is told by an
    aggregate, so they aren't gathered.  Of the others, one of more than `hot`
    documents is dealt to k parts, and each two parts meet in a cell.
    """
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    mixed = scratch.write("mixed", mixed.select("band", F.ceil(F.col("n") / hot).cast("int").alias("k")))
    some = labelled.filter("key <> first").join(checked(mixed, mixed.count(), 24), "band").withColumn("part", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
    with_each = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct((F.least("part", j) * F.col("k") + F.greatest("part", j)).alias("cell"), (j != F.col("part")).alias("apart")))
    return some.select("band", "key", "label", "part", F.explode(with_each).alias("c")).select("band", "key", "label", "part", "c.cell", "c.apart")


def _likely(t: float):
    """Keeps pairs whose estimate comes within three standard errors of the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):
                s = b.slice(at, 1 << 14)
                j, of = estimate(_matrix(s.column("regs_a")), _matrix(s.column("regs_b")), s.column("n_a").to_numpy(), s.column("n_b").to_numpy())
                keep = j >= t - 3 * np.sqrt(0.25 / np.maximum(of, 1))
                yield s.filter(pa.array(keep)).select(["a", "b"])

    return run


def _same(t: float, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text_a"):
                for r in slices(s, "text_b"):
                    j = jaccard(r.column("text_a"), r.column("text_b"), words)
                    yield r.filter(pa.array(j >= t - 1e-12)).select(["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = SHINGLE, k: int = REGISTERS, rows: int = ROWS_PER_BAND, hot: int = HOT) -> DataFrame:
    """docs with `group`, the least doc_id of the near-duplicates it belongs to, group_size, and `keep`, true for one document of each group.

    Two documents are near-duplicates if the sets of their shingles of `words` words
    have a Jaccard similarity of at least `threshold`; groups are the connected
    components.  Equal sets are found by a 128-bit hash.  Of the others, each has k
    HyperMinHash registers; documents that agree in all registers of a band are
    candidates, whose similarity is estimated from the registers, less the matches
    expected by chance, and then verified on the texts.  A band's group is compared
    with its first document, and after components are known, all pairs that still
    lie in different ones are compared too, so no candidate is left out, and groups
    of thousands don't cost their square in verified pairs.  A band of more than `hot`
    documents is compared by several tasks.

    Texts without words (null, empty, punctuation) match nothing and are kept; texts of
    any length are signed whole; an empty table gives an empty one.  Rows
    that repeat a doc_id, and null ones, are ordered by text; `group` is then the
    least doc_id of the group, null if that row has a null one.  Other columns pass
    through; columns named group, group_size or keep are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base, back = packed(docs, "group", "group_size", "keep")
    rows_ = keyed(base, scratch)
    groups = _groups(rows_, scratch, threshold, words, k, rows, hot)
    size = groups.count()
    roots = rows_.select(F.col("__key").alias("root"), F.col("doc_id").alias("group"))
    named = groups.join(roots, "root").select(F.col("key"), "root", "group", "group_size")
    named = scratch.write("named", named)
    out = rows_.join(checked(named, size, 48), rows_["__key"] == named["key"], "left")
    alone = F.col("root").isNull()
    return out.select(
        *back(),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group")).alias("group"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("root") == F.col("__key"))).alias("keep"),
    )


def _groups(docs: DataFrame, scratch: Scratch, t: float, words: int, k: int, rows: int, hot: int) -> DataFrame:
    """(key, root, group_size) for the documents in groups of two or more."""
    docs = docs.select("__key", "text")
    signed = scratch.write("signed", docs.mapInArrow(_sign(k, words), "key long, n long, h1 long, h2 long, regs binary").filter("n > 0"))
    equal = signed.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    equal = signed.select("key", "h1", "h2").join(equal.filter("n > 1"), ["h1", "h2"]).filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    equal = scratch.write("equal", equal)
    n_equal = equal.count()
    signed = signed.join(checked(equal.select(F.col("b").alias("key")), n_equal, 24), "key", "left_anti").select("key", "n", "regs")

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = (signed.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").mapInArrow(_likely(t), "a long, b long")

    def verified(pairs: DataFrame, name: str) -> tuple[DataFrame, int]:
        pairs = scratch.write(f"likely_{name}", likely(pairs))
        n = pairs.count()
        ids = pairs.select(F.col("a").alias("__key")).unionByName(pairs.select(F.col("b").alias("__key"))).distinct()
        texts = docs.join(checked(ids, 2 * n, 24), "__key", "left_semi")
        a, b = (texts.select(F.col("__key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        edges = scratch.write(f"edges_{name}", pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_same(t, words), "a long, b long"))
        return edges, n

    bands = signed.select("key", "regs").mapInArrow(_bands(rows), "band long, key long")
    # The first document of each band is an aggregate that combines before its shuffle; only bands of two or more go on.
    first = scratch.write("first", bands.groupBy("band").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "first"))
    multi = scratch.write("multi", bands.join(checked(first, first.count(), 24), "band"))
    stars = multi.filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")).distinct()
    edges, _ = verified(stars, "stars")
    roots = components(edges)
    labelled = multi.join(checked(roots, roots.count(), 32), multi["key"] == roots["node"], "left").select("band", "key", "first", F.coalesce("root", "key").alias("label"))
    cells = _cells(labelled, scratch, hot).repartition("band", "cell").sortWithinPartitions("band", "cell")
    crosses = cells.mapInArrow(_crosses, "a long, b long").distinct()
    more, n_more = verified(crosses, "crosses")
    if n_more:
        edges = edges.unionByName(more)
    roots = components(edges.unionByName(equal))
    w = roots.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"))
    out = scratch.write("groups", roots.join(w, "root").select(F.col("node").alias("key"), "root", "group_size"))
    for name in ("signed", "equal", "first", "multi", "mixed", "likely_stars", "likely_crosses", "edges_stars", "edges_crosses"):
        scratch.drop(name)
    return out


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "group", "group_size", "keep")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the least doc_id.

    Line dedup takes from a copy the lines that it shares, so what is left of it may
    resemble nothing.  Therefore documents are compared twice: those that are still
    there by their texts in the table of documents, then the ones kept by their texts
    as they are.  Rows whose doc_id is null or repeated are compared as they are only.
    Texts without words, null and empty ones stay; an empty table stays one.
    """
    base, back = packed(docs)
    scratch = Scratch(spark)
    once = lambda df: df.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("doc_id")
    came = table(spark, sf_dir, "documents").select("doc_id", "text")
    came = came.join(once(base), "doc_id", "left_semi").join(once(came), "doc_id", "left_semi")
    copies = scratch.write("copies", near_duplicates(came).filter("not keep").select("doc_id"))
    kept = base.join(checked(copies, copies.count(), 16), "doc_id", "left_anti")
    return near_duplicates(kept).filter("keep").select(*back())
