"""Best-fit packing of documents into training sequences, in bulk-synchronous rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spm
from .common import Scratch, keyed, table

#: Tokens of a sequence.
CAPACITY = 4096
#: Rows that one task sorts and sweeps.
SWEEP_ROWS = 1 << 17
#: Pieces of at most half this share of a sequence are strung together, equal sizes with each other, up to this share.
STRING = 1 / 16
#: Strings are made of so many pieces at once; more of one size are dealt to several tasks.
STRING_ROWS = 1 << 16

_STATE = "kind int, id string, bin long, size int, at int, part int, rank long"
_NAMES = ["kind", "id", "bin", "size", "at", "part", "rank"]
#: Of _STATE: a piece waiting for a bin, a bin with a gap, a piece in its bin.
WAITING, GAP, PLACED = 0, 1, 2


def matched(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, their gaps, pieces left, gaps left) of a sweep over sorted rows, as places.

    From the smallest up, each gap takes the last piece before it that has none yet.
    That gives each piece, from the longest down, its successor among the gaps that
    longer pieces left: of pieces with the same successor the last in rank has it, and
    the others go on to the next gaps.  Pieces left lie after all gaps that could take
    them, and gaps left before all such pieces.
    """
    n = len(kind)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    begin = np.flatnonzero(np.diff(kind, prepend=kind[0] ^ 1))
    ends = np.append(begin[1:], n)
    stack: list[tuple[int, int]] = []
    took, gave, free = [], [], []
    for a, z, k in zip(begin.tolist(), ends.tolist(), kind[begin].tolist(), strict=True):
        if k == WAITING:
            stack.append((a, z))
            continue
        while a < z and stack:
            lo, hi = stack.pop()
            m = min(hi - lo, z - a)
            took.append(np.arange(hi - 1, hi - 1 - m, -1))
            gave.append(np.arange(a, a + m))
            a += m
            if hi - m > lo:
                stack.append((lo, hi - m))
        if a < z:
            free.append(np.arange(a, z))
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return cat(took), cat(gave), cat([np.arange(a, z) for a, z in stack]), cat(free)


def _sweep(capacity: int):
    """Matches within each range; what is left is numbered: pieces from the last, gaps from the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        g = pa.Table.from_batches(held).combine_chunks()
        kind, size, bins, part = (pc.fill_null(g.column(c), 0).to_numpy() for c in ("kind", "size", "bin", "part"))
        ids = g.column("id")
        p, q, left, free = matched(kind)
        null = lambda n, t: pa.nulls(n, t)
        rest = size[q] - size[p]
        more = rest > 0
        yield _rows(np.full(len(p), PLACED), ids.take(pa.array(p)), bins[q], size[p], capacity - size[q], null(len(p), pa.int32()), null(len(p), pa.int64()))
        yield _rows(np.full(int(more.sum()), GAP), null(int(more.sum()), pa.string()), bins[q][more], rest[more], null(int(more.sum()), pa.int32()), null(int(more.sum()), pa.int32()), null(int(more.sum()), pa.int64()))
        yield _rows(np.full(len(left), WAITING), ids.take(pa.array(left)), null(len(left), pa.int64()), size[left], null(len(left), pa.int32()), part[left], np.arange(len(left) - 1, -1, -1))
        yield _rows(np.full(len(free), GAP), null(len(free), pa.string()), bins[free], size[free], null(len(free), pa.int32()), part[free], np.arange(len(free)))

    return run


def _rows(*cols) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    made = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(k) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made, _NAMES)


def across(left: dict[int, int], free: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(range of pieces, first rank, range of gaps, first rank, how many): the same sweep over what ranges have left, by their counts alone."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[list[int]] = []
    for part in sorted({*left, *free}):
        at, n = 0, free.get(part, 0)
        # Gaps left in a range come before its pieces left, and take pieces of the ranges before.
        while at < n and stack:
            top = stack[-1]
            m = min(top[2], n - at)
            out.append((top[0], top[1], part, at, m))
            at, top[1], top[2] = at + m, top[1] + m, top[2] - m
            if not top[2]:
                stack.pop()
        if left.get(part):
            stack.append([part, 0, left[part]])
    return out


def _aim(steps: list[tuple[int, int, int, int, int]]):
    """Gives each piece that is left the range and rank of the gap that it gets, if any."""
    order = sorted(steps)
    parts, firsts = np.array([s[0] for s in order]), np.array([s[1] for s in order])
    to, at, n = (np.array([s[k] for s in order]) for k in (2, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, rank = b.column("part").to_numpy(), b.column("rank").to_numpy()
            # The last step of this range that begins at this rank or before.
            top = int(max(rank.max(initial=0), firsts.max(initial=0))) + 1
            i = np.searchsorted(parts.astype(np.int64) * top + firsts, part.astype(np.int64) * top + rank, "right") - 1
            j = np.maximum(i, 0)
            ok = (i >= 0) & (parts[j] == part) & (rank - firsts[j] < n[j])
            gap = np.where(ok, to[j], -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), pa.array(gap.astype(np.int32)), pa.array((at[j] + rank - firsts[j]).astype(np.int64))], ["id", "size", "gap_part", "gap_rank"])

    return run


def _round(open_: DataFrame, rows: int, capacity: int, sweep_rows: int, name: str, scratch: Scratch) -> DataFrame:
    """One superstep over pieces that wait and bins with gaps: what is placed, what waits, and the gaps after it."""
    ranges = -(-rows // sweep_rows)
    order = ["size", "kind", "tie", "id", "bin"]
    ranked = open_.select("kind", "id", "bin", "size").withColumn("tie", F.xxhash64("id", "bin"))
    by_size = ranked.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    swept = by_size.withColumn("part", F.spark_partition_id()).select("kind", "id", "bin", "size", "part").mapInArrow(_sweep(capacity), _STATE)
    swept = scratch.write(f"{name}_swept", swept)
    counts = swept.filter("rank IS NOT NULL").groupBy("part", "kind").count().collect()
    steps = across({r["part"]: r["count"] for r in counts if r["kind"] == WAITING}, {r["part"]: r["count"] for r in counts if r["kind"] == GAP})
    if not steps:
        return swept
    aimed = swept.filter(f"kind = {WAITING}").select("id", "size", "part", "rank").mapInArrow(_aim(steps), "id string, size int, gap_part int, gap_rank long")
    gaps = swept.filter(f"kind = {GAP} AND rank IS NOT NULL").select("bin", F.col("size").alias("gap"), F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"))
    both = scratch.write(f"{name}_both", aimed.join(gaps, ["gap_part", "gap_rank"], "full"))
    none = lambda kind: F.lit(None).cast(kind)
    met = both.filter("id IS NOT NULL AND bin IS NOT NULL")
    out = swept.filter("rank IS NULL").select("kind", "id", "bin", "size", "at")
    out = out.unionByName(met.select(F.lit(PLACED).alias("kind"), "id", "bin", "size", (F.lit(capacity) - F.col("gap")).alias("at")))
    out = out.unionByName(met.filter("gap > size").select(F.lit(GAP).alias("kind"), none("string").alias("id"), "bin", (F.col("gap") - F.col("size")).alias("size"), none("int").alias("at")))
    return out.unionByName(both.filter("id IS NULL OR bin IS NULL").select(F.when(F.col("id").isNull(), GAP).otherwise(WAITING).alias("kind"), "id", "bin", F.coalesce("size", "gap").alias("size"), none("int").alias("at")))


def _tie(bins: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(null, bin)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = (np.uint64(42 + 8) + p5) ^ (turn(bins.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _rest(capacity: int, next_bin: int):
    """All rounds that are left, where one task holds all that is open: what each round of pack does, on arrays, until no piece waits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        g = pa.Table.from_batches(held).combine_chunks()
        kind, size, bins, tie = (pc.fill_null(g.column(c), 0).to_numpy() for c in ("kind", "size", "bin", "tie"))
        ids, row, fresh_bin = g.column("id"), np.arange(g.num_rows), next_bin
        while (waits := kind == WAITING).any():
            hist = lambda on: {int(s): int(n) for s, n in zip(*np.unique(size[on], return_counts=True), strict=True)}  # noqa: B023, E731
            fresh = new_bins(hist(waits), hist(~waits), capacity)
            keep = waits | (size >= size[waits].min())
            opened = np.arange(fresh_bin, fresh_bin + fresh)
            fresh_bin += fresh
            kind = np.concatenate([kind[keep], np.full(fresh, GAP, kind.dtype)])
            size = np.concatenate([size[keep], np.full(fresh, capacity, size.dtype)])
            bins, tie, row = np.concatenate([bins[keep], opened]), np.concatenate([tie[keep], _tie(opened)]), np.concatenate([row[keep], np.full(fresh, -1)])
            order = np.lexsort((tie, kind, size))  # stable, and pieces came in order of their ids
            kind, size, bins, tie, row = (x[order] for x in (kind, size, bins, tie, row))
            p, q, _, _ = matched(kind)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[p])).combine_chunks(), pa.array(bins[q]), pa.array((capacity - size[q]).astype(np.int32))], ["id", "bin", "at"])
            size[q] -= size[p]
            left = np.ones(len(kind), bool)
            left[p] = False
            left[q] = size[q] > 0
            kind, size, bins, tie, row = (x[left] for x in (kind, size, bins, tie, row))

    return run


def _strings(pieces: DataFrame, capacity: int, string_rows: int) -> DataFrame:
    """pieces (id, size) with `string`, the id of what a small one is strung to, and `offset` in it; null for the others.

    Pieces of a size are ranked within parts by hash, whose number follows from how
    many there are, and each run of as many as fit is a string.
    """
    most = int(capacity * STRING)
    small = pieces.filter(F.col("size") <= most // 2)
    counts = {r["size"]: r["count"] for r in small.groupBy("size").count().collect()}
    if not counts:
        return pieces.withColumns({"string": F.lit(None).cast("string"), "offset": F.lit(0)})
    parts = F.element_at(F.create_map(*(F.lit(x) for s, n in sorted(counts.items()) for x in (s, max(1, -(-n // string_rows))))), F.col("size"))
    part = F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int")
    nth = F.row_number().over(Window.partitionBy("size", "part").orderBy(F.xxhash64("id"), "id")) - 1
    each = F.floor(F.lit(most) / F.col("size")).cast("int")
    small = small.withColumn("part", part).withColumn("nth", nth)
    name = F.format_string("s%d.%d.%d", F.col("size"), F.col("part"), F.floor(F.col("nth") / each).cast("int"))
    small = small.select("id", "size", name.alias("string"), (F.pmod(F.col("nth"), each) * F.col("size")).cast("int").alias("offset"))
    return small.unionByName(pieces.filter(F.col("size") > most // 2).withColumns({"string": F.lit(None).cast("string"), "offset": F.lit(0)}))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, model: str = spm.MODEL, sweep_rows: int = SWEEP_ROWS, string_rows: int = STRING_ROWS) -> DataFrame:
    """(doc_id, piece, bin, at, size) for every piece of docs (doc_id, text).

    A document has the tokens that the model gives for its text, and one more that
    ends it, so a null or empty text has one.  What is longer than capacity is cut
    into pieces of just that size, each a bin of its own, and a rest.  `at` is where
    the piece begins in its bin; no bin exceeds capacity, no piece is left out, and
    texts may be of any length.

    Each round is a superstep.  Pieces without a bin and bins with a gap are sorted
    together into ranges of sizes, equal sizes too being dealt to several ranges where
    they are many; a sweep over each range gives pieces, from the longest down, their
    successors among the gaps; what ranges have left, pieces behind and gaps in front,
    is matched across their borders by the same sweep over counts, and joined by rank.
    Of pieces that want the same gap the last in rank (size, then a hash of the piece)
    has it; each gap takes one piece, is updated, and the next round follows.  Pieces
    longer than any gap get as many new bins as their sizes need.  Once all that is open
    fits one range, one task runs the rounds that are left.  Pieces of at most capacity / 32 are strung together first, equal sizes with
    each other, up to capacity / 16.  The result is the same for any number of ranges
    and partitions.

    What travels between rounds is sizes and ids, never text; the driver sees counts by
    size, at most `capacity` rows, and by range.  Null doc_ids and repeated rows are
    packed like any other row, repeated ones in any order among each other; other
    columns are ignored; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows_ = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    sized = spm.count(rows_, model=model).select("doc_id", "__key", (F.col("n_tokens") + 1).alias("n"))
    full = (F.col("n") / capacity).cast("int")
    rest = (F.col("n") % capacity).cast("int")
    sizes = F.concat(F.array_repeat(F.lit(capacity), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    pieces = sized.select("doc_id", "__key", F.posexplode(sizes).alias("piece", "size"))
    pieces = scratch.write("pieces", pieces.select("doc_id", "piece", "size", F.concat_ws(".", F.col("__key").cast("string"), F.col("piece").cast("string")).alias("id")))
    whole = pieces.filter(F.col("size") == capacity)
    strung = scratch.write("strung", _strings(pieces.filter(F.col("size") < capacity).select("id", "size"), capacity, string_rows))
    state = strung.groupBy(F.coalesce("string", "id").alias("id")).agg(F.sum("size").cast("int").alias("size"))
    none = lambda kind: F.lit(None).cast(kind)
    state = state.select(F.lit(WAITING).alias("kind"), "id", none("long").alias("bin"), "size", none("int").alias("at"))
    done: list[DataFrame] = []
    next_bin = round_ = 0
    state = scratch.write("r0", state)
    while True:
        hist = state.filter(F.col("kind") != PLACED).groupBy("kind", "size").count().collect()
        waiting = {r["size"]: r["count"] for r in hist if r["kind"] == WAITING}
        gaps = {r["size"]: r["count"] for r in hist if r["kind"] == GAP}
        if not waiting:
            break
        fresh = new_bins(waiting, gaps, capacity)
        open_ = state.filter(F.col("kind") != PLACED).select("kind", "id", "bin", "size", "at")
        # A gap that no piece can use any more waits no longer.
        least = min(waiting)
        open_ = open_.filter((F.col("kind") == WAITING) | (F.col("size") >= least))
        rows = sum(waiting.values()) + fresh + sum(n for s, n in gaps.items() if s >= least)
        if rows <= sweep_rows:
            # From here on a round is one task, so all that are left are one job; the driver keeps no plan for each.
            ranked = open_.select("kind", "id", "bin", "size", F.xxhash64("id", "bin").alias("tie")).coalesce(1).sortWithinPartitions("size", "kind", "tie", "id", "bin")
            done.append(scratch.write("rest", ranked.mapInArrow(_rest(capacity, next_bin), "id string, bin long, at int")))
            # No piece opens more than one bin.
            next_bin += sum(waiting.values())
            break
        if fresh:
            opened = spark.range(next_bin, next_bin + fresh).select(F.lit(GAP).alias("kind"), none("string").alias("id"), F.col("id").alias("bin"), F.lit(capacity).alias("size"), none("int").alias("at"))
            open_ = open_.unionByName(opened)
            next_bin += fresh
        round_ += 1
        state = _round(open_, rows, capacity, sweep_rows, f"r{round_}", scratch)
        done.append(state.filter(F.col("kind") == PLACED).select("id", "bin", "at"))
    ended = whole.select("doc_id", "piece", (next_bin + F.monotonically_increasing_id()).alias("bin"), F.lit(0).alias("at"), "size")
    if not done:
        return ended
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    placed = placed.withColumnsRenamed({"id": "string", "at": "string_at"})
    names = strung.select("id", F.coalesce("string", "id").alias("string"), "offset")
    found = names.join(placed, "string").select("id", "bin", (F.col("string_at") + F.col("offset")).alias("at"))
    return pieces.filter(F.col("size") < capacity).join(found, "id").select("doc_id", "piece", "bin", "at", "size").unionByName(ended)


def new_bins(waiting: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """How many bins to open: none while a gap can take the longest piece; else as many as the pieces longer than all gaps need, and no fewer than all need together."""
    top = max(gaps, default=0)
    stranded = {s: n for s, n in waiting.items() if s > top}
    if not stranded:
        return 0
    total = sum(s * n for s, n in stranded.items())
    free = sum(s * n for s, n in gaps.items())
    rest = sum(s * n for s, n in waiting.items()) - total
    return max(1, -(-total // capacity), -(-(total + rest - free) // capacity))


def sequences(places: DataFrame, docs: DataFrame, *, capacity: int = CAPACITY, model: str = spm.MODEL, end: int = spm.END) -> DataFrame:
    """(bin, ids): the token ids of each sequence that pack(docs) laid out, each document ended by `end`.

    Documents must have unique ids here.  A sequence is gathered by one task, which
    capacity bounds.
    """
    ids = spm.encode(docs, model=model).select(F.col("doc_id"), F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(end))).alias("ids"))
    cut = places.join(ids, "doc_id").select("bin", F.struct("at", F.slice("ids", F.col("piece") * capacity + 1, F.col("size")).alias("ids")).alias("p"))
    return cut.groupBy("bin").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(docs)
