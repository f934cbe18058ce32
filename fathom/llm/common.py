"""What the operators share: hashing of words in bulk, shared tables, joins of a checked size."""

from __future__ import annotations

import atexit
import bisect
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes, by count of its rows times an estimate of a row's size.
BROADCAST_BYTES = 64 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
#: Bytes that make up words: ASCII letters and digits, and whatever isn't ASCII.
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_WORD[128:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one of our own if all of Spark runs on this machine."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="fathom-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small table by a reliable checkpoint."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that one run of an operator writes to the shared folder.

    They outlive the operator, because what it returns is lazy and still reads
    them; drop() deletes those that nothing lazy reads any more, and the rest go
    when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark).rstrip('/')}/fathom-{uuid.uuid4().hex}"
        _scratch(spark, self.at)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.at}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


# ---------------------------------------------------------------- keys and joins


def packed(docs: DataFrame, *replaced: str) -> tuple[DataFrame, Callable[[], list[Column]]]:
    """(doc_id, text and all other columns but the replaced ones as one, what to select to have them back).

    So no name of a column of docs clashes with one that an operator uses.
    """
    base = docs.drop(*replaced)
    rest = [c for c in base.columns if c not in ("doc_id", "text")]
    whole = [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__rest")] if rest else []
    return base.select("doc_id", "text", *whole), lambda: [F.col("__rest").getField(c).alias(c) if c in rest else F.col(c) for c in base.columns]


def recounted(out: DataFrame, changed: Column, docs: DataFrame, back: Callable[[], list[Column]]) -> DataFrame:
    """The columns of docs out of their packed form; n_chars, where there is one, follows a text that changed."""
    cols = back()
    if "n_chars" in docs.columns:
        i = docs.columns.index("n_chars")
        cols[i] = F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(cols[i]).alias("n_chars")
    return out.select(*cols)


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def keyed(docs: DataFrame, scratch: Scratch, *, key: str = "__key") -> DataFrame:
    """docs with a column of unique longs that follow (doc_id, text).

    doc_id is a whole number of any width, or null.  Where it is unique and never null it is that key.  Otherwise the rows are
    sorted by (doc_id with nulls first, text) and numbered, so repeated rows are
    ordered too; the numbered table is written once, which makes the numbers stable.
    """
    bad = docs.groupBy(F.col("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    bad = bad.filter((F.col("n") > 1) | F.col("doc_id").isNull()).limit(1)
    if not bad.take(1):
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    by = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.write("keyed", by.withColumn(key, F.monotonically_increasing_id()))


def checked(small: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """small, with a broadcast hint if its rows fit BROADCAST_BYTES; else a plain side that Spark shuffles."""
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


class Taken:
    """Spans of a text that don't overlap."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """Takes a span unless it overlaps one that was taken before."""
        i = bisect.bisect_right(self.ends, a)
        if i < len(self.begins) and self.begins[i] < b:
            return False
        self.begins.insert(i, a)
        self.ends.insert(i, b)
        return True


# ---------------------------------------------------------------- words in bulk


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POW = np.multiply.accumulate(np.full(256, _MULT, np.uint64))


def _powers(n: int) -> np.ndarray:
    return _POW if n <= len(_POW) else np.multiply.accumulate(np.full(n, _MULT, np.uint64))


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each, one row at least."""
    lens = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = lens[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(lens, base + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings, and where each begins (one more offset than strings); null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(texts: pa.Array, lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of the text or line each is in, lines a text has).

    Words are maximal runs of ASCII letters, digits and non-ASCII bytes, after
    lowering case.  With lines, the second array counts lines over all texts.
    """
    data, off = raw(pc.utf8_lower(texts))
    n, k = len(data), len(off) - 1
    first = off[:-1][off[:-1] < off[1:]]
    if lines:
        begins = np.zeros(n + 1, bool)
        begins[1:] = data == 10
        per = np.add.reduceat(np.concatenate([begins[1:], [False]]), off[:-1], dtype=np.int64) if n else np.zeros(k, np.int64)
        per[off[:-1] == off[1:]] = 0
        counts = per + 1
    else:
        counts = np.ones(k, np.int64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    isw = _WORD[data]
    flag = isw.copy()
    flag[1:] &= ~isw[:-1]
    flag[first] = isw[first]
    starts = np.flatnonzero(flag)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    gaps = np.diff(starts, append=n)
    k_in = np.arange(starts[0], n) - np.repeat(starts, gaps)
    vals = _powers(int(gaps.max()))[k_in]
    part = data[starts[0] :]
    vals *= np.where(isw[starts[0] :], part, 0).astype(np.uint64) + np.uint64(0)
    h = mix(np.add.reduceat(vals, starts - starts[0]))
    if lines:
        nl = np.cumsum(data == 10)
        doc = np.searchsorted(off, starts, "right") - 1
        where = np.concatenate([[0], np.cumsum(counts)])[doc] + nl[starts] - np.where(off[doc] > 0, nl[off[doc] - 1], 0)
    else:
        where = np.searchsorted(off, starts, "right") - 1
    return h, where, counts


def unique_in(where: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (where, h), sorted by both."""
    if not len(h):
        return where, h
    short = (where.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    order = np.argsort(short) if int(where.max()) < 1 << 24 else np.lexsort((h, where))
    w, x = where[order], h[order]
    same = (w[1:] == w[:-1]) & (x[1:] >> np.uint64(24) == x[:-1] >> np.uint64(24))
    if np.any(same & (x[1:] != x[:-1])):  # two words agree in 40 bits: sort by all of them
        order = np.lexsort((h, where))
        w, x = where[order], h[order]
    keep = np.ones(len(w), bool)
    keep[1:] = (w[1:] != w[:-1]) | (x[1:] != x[:-1])
    return w[keep], x[keep]


def jaccard(a: pa.Array, b: pa.Array, words: int) -> np.ndarray:
    """Exact Jaccard similarity, pair by pair, of the sets of shingles of so many words of two arrays of texts; a text that comes in several pairs is cut once."""
    n = len(a)
    coded = pa.concat_arrays([a, b]).dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy()
    w, h = unique_in(*shingles(coded.dictionary, words))
    size = np.bincount(w, minlength=len(coded.dictionary)).astype(np.int64)
    begin, m = (np.cumsum(size) - size)[code], size[code]
    h = h[np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin, m)]
    w = np.repeat(np.tile(np.arange(n), 2), m)
    # Each shingle is there once for each text of a pair; those of both are gone after unique_in.
    both = m[:n] + m[n:] - np.bincount(unique_in(w, h)[0], minlength=n)
    return both / np.maximum(m[:n] + m[n:] - both, 1)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all runs of so many words; a text of fewer words has one shingle of all its words."""
    h, where, _ = word_hashes(texts)
    if words == 1 or not len(h):
        return where, h
    out = np.zeros(len(h), np.uint64)
    ok = np.ones(len(h), bool)
    begins = np.flatnonzero(np.diff(where, prepend=-1))
    first = np.zeros(len(h), bool)
    first[begins] = True
    for k in range(words):
        out *= np.uint64(_MULT)
        if k:
            same = np.zeros(len(h), bool)
            same[:-k] = where[k:] == where[:-k]
            moved = np.zeros(len(h), np.uint64)
            moved[:-k] = h[k:]
            out += np.where(same, moved, np.uint64(0))
            ok &= same
        else:
            out += h
    keep = ok | first & ~ok
    return where[keep], mix(out[keep])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of whole groups, out of batches that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        least = max(1 << 18, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node that is connected with it.

    Alternating large-star and small-star steps.  The least neighbour of each node is
    an aggregate that combines before its shuffle, joined back to the edges, a join
    that Spark can split where a node has most of them; so no task holds all
    neighbours of a node.  A round is checkpointed, since the loop would else grow
    the lineage.
    """
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m"))
        large = sym.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(least.select("u", F.col("m").alias("v")).unionByName(links).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
