"""Exact membership of URLs in a list, by cascades of Bloom filters over all keys of the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, checked, mix, table

#: Share of the members of a later level that slip through it.
LATER_RATE = 0.5
#: Levels of a cascade; keys that are still confused after them, as those of equal hashes, are listed one by one.
MAX_LEVELS = 64
#: Keys that one cascade is built over; a larger universe has a cascade for each part of its hashes.
SHARD_KEYS = 1 << 20
#: Pages of one shard that a task tests, where cascades come to the pages; a shard of more is dealt to several.
SHARD_PAGES = 1 << 20
#: A key is on the list of the query if any of its pages has so many paragraphs at least.
MANY_PARAGRAPHS = 8
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)"

_SALT = 0x51ED270B


class Level(NamedTuple):
    bits: int
    hashes: int
    filter: np.ndarray


def url_key(url: Column) -> Column:
    """Host and path of a URL: the host in lower case, without user, port and "www.", the path without a slash at its end; null where there is no host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")))


def _shape(members: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(members * math.log(1 / rate) / math.log(2) ** 2))
    return bits, max(1, round(math.log2(1 / rate)))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Places in the filter, key by hash; each level draws its own."""
    a = mix(h1.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    b = mix(h2.view(np.uint64) ^ np.uint64(level * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)) | np.uint64(1)
    return (mix(a[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)).astype(np.int64)


def _hit(h1: np.ndarray, h2: np.ndarray, level: int, f: Level) -> np.ndarray:
    at = _places(h1, h2, level, f.bits, f.hashes)
    return ((f.filter[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def contains(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: the level at which a key is first missed tells, listed if it is an even one."""
    out = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for k, f in enumerate(levels):
        hit = _hit(h1[left], h2[left], k, f)
        out[left[~hit]] = k % 2 == 1
        left = left[hit]
    out[left] = len(levels) % 2 == 1
    return out


def cascade(h1: np.ndarray, h2: np.ndarray, on: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """The levels that tell keys that are on from the others, and which keys they leave confused.

    Level 0 holds the listed keys; level 1 those of the others that level 0 lets
    through, level 2 the listed ones that level 1 lets through, and so on until none
    are.  Keys outside of these would not be told exactly.
    """
    members, rest = np.flatnonzero(on), np.flatnonzero(~on)
    levels: list[Level] = []
    m = len(rest)
    while len(members) and len(levels) < MAX_LEVELS:
        k = len(levels)
        rate = min(0.5, max(2.0**-32, math.sqrt(0.5) * len(members) / max(m, 1))) if k == 0 else LATER_RATE
        bits, hashes = _shape(len(members), rate)
        whole = np.zeros(-(-bits // 8) * 8, bool)
        for i in range(0, len(members), 1 << 16):
            part = members[i : i + (1 << 16)]
            whole[_places(h1[part], h2[part], k, bits, hashes)] = True
        levels.append(Level(bits, hashes, np.packbits(whole)))
        passed = [part[_hit(h1[part], h2[part], k, levels[-1])] for part in np.split(rest, range(1 << 16, len(rest), 1 << 16))]
        members, rest, m = np.concatenate(passed), members, len(members)
    return levels, np.concatenate([members, rest]) if len(members) else members


_CASCADES = "shard int, level int, bits long, hashes int, filter binary, h1 long, h2 long"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of each shard's cascade, and rows of level -1 with the hashes that it leaves confused; rows come sorted by shard."""
    names = ["shard", "level", "bits", "hashes", "filter", "h1", "h2"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        shard = t.column("shard")[0].as_py()
        h1, h2, on = (t.column(c).to_numpy() for c in ("h1", "h2", "on"))
        levels, confused = cascade(h1, h2, on)
        rows = [(shard, k, f.bits, f.hashes, f.filter.tobytes(), None, None) for k, f in enumerate(levels)]
        rows += [(shard, -1, None, None, None, int(a), int(b)) for a, b in zip(h1[confused], h2[confused], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names)

    held: list[pa.RecordBatch] = []
    for b in batches:
        at = 0
        shard = b.column("shard").to_numpy()
        for end in [*(np.flatnonzero(np.diff(shard)) + 1), len(shard)]:
            if held and held[-1].column("shard")[0].as_py() != shard[at]:
                yield made(held)
                held = []
            if end > at:
                held.append(b.slice(at, end - at))
            at = end
    if held:
        yield made(held)


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def build(universe: DataFrame, shards: int) -> DataFrame:
    """The cascades of a universe (h1, h2, on), one for each of so many shards."""
    some = universe.select(shard_of(shards).alias("shard"), "h1", "h2", "on").repartition(shards, "shard").sortWithinPartitions("shard")
    return some.mapInArrow(_build, _CASCADES)


def _levels(rows) -> dict[int, list[Level]]:
    out: dict[int, list[Level]] = {}
    for r in sorted((r for r in rows if r["level"] >= 0), key=lambda r: (r["shard"], r["level"])):
        out.setdefault(r["shard"], []).append(Level(r["bits"], r["hashes"], np.frombuffer(r["filter"], np.uint8)))
    return out


def _told(b: pa.RecordBatch, known: dict[int, list[Level]]) -> pa.RecordBatch:
    h1, h2, shard = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "shard"))
    ok = np.zeros(b.num_rows, bool)
    for k in np.unique(shard):
        if k in known:
            mine = np.flatnonzero(shard == k)
            ok[mine] = contains(known[k], h1[mine], h2[mine])
    ok &= b.column("key").is_valid().to_numpy(zero_copy_only=False)
    keep = ["page_id", "url", "key", "h1", "h2"]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ok)], [*keep, "listed"])


def _test(known: dict[int, list[Level]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _told(b, known)

    return run


def _test_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a shard come after the levels of its cascade."""
    known: dict[int, dict[int, Level]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        now = b.column("shard")[0].as_py()
        known = {k: v for k, v in known.items() if k >= now}
        is_level = b.column("level").is_valid().to_numpy(zero_copy_only=False)
        for r in b.filter(pa.array(is_level)).to_pylist():
            known.setdefault(r["shard"], {})[r["level"]] = Level(r["bits"], r["hashes"], np.frombuffer(r["filter"], np.uint8))
        pages = b.filter(pa.array(~is_level))
        if pages.num_rows:
            yield _told(pages, {k: [v[i] for i in sorted(v)] for k, v in known.items()})


def filter_urls(pages: DataFrame, listed: DataFrame, *, shard_keys: int = SHARD_KEYS, shard_pages: int = SHARD_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, key, listed) for each of pages (page_id, url): whether its key is among those of listed (key).

    The universe is all keys of the pages (host and path, by url_key); listed keys that
    no page has are irrelevant.  It is cut by hash into shards of about shard_keys keys, and a cascade
    of Bloom filters is built over each, exact for its keys; keys that two independent
    64-bit hashes don't tell apart are carried in an explicit list.  Where all
    cascades together are less than broadcast_bytes they are sent to the tasks, and
    pages are neither joined nor shuffled; else the pages of a shard come to its
    cascade, dealt to several tasks if there are more than shard_pages.  The method
    and the result are the same at any size.

    A null URL, or one without a host, has a null key and isn't listed.  Repeated
    pages stay; null page_ids stay; null or repeated keys in the list and other
    columns are ignored; an empty list lists nothing; URLs may be of any length; no
    pages give no rows.
    """
    scratch = Scratch(pages.sparkSession)
    h1, h2 = F.xxhash64("key"), F.xxhash64(F.lit(_SALT), "key")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("key")).withColumns({"h1": h1, "h2": h2})
    keys = base.filter(F.col("key").isNotNull()).select("key").distinct()
    wanted = listed.select(F.col("key").cast("string").alias("key")).filter(F.col("key").isNotNull()).distinct().withColumn("on", F.lit(True))
    universe = scratch.write("universe", keys.join(wanted, "key", "left").select("key", h1.alias("h1"), h2.alias("h2"), F.coalesce("on", F.lit(False)).alias("on")))
    shards = max(1, -(-universe.count() // shard_keys))
    cascades = scratch.write("cascades", build(universe, shards))
    size, confused = cascades.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0)), F.count(F.when(F.col("level") < 0, 1))).first()
    base = base.withColumn("shard", shard_of(shards))
    names = "page_id long, url string, key string, h1 long, h2 long, listed boolean"
    if size <= broadcast_bytes:
        out = base.mapInArrow(_test(_levels(cascades.filter("level >= 0").collect())), names)
    else:
        many = base.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_pages).cast("int").alias("parts"))
        many = scratch.write("many", many)
        parts = F.coalesce("parts", F.lit(1))
        dealt = base.join(checked(many, shards, 16), "shard", "left").withColumn("part", F.pmod(F.xxhash64("url", "page_id"), parts).cast("int")).drop("parts")
        copies = cascades.filter("level >= 0").join(checked(many, shards, 16), "shard").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "level", "bits", "hashes", "filter")
        both = dealt.unionByName(copies, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("level").asc_nulls_last())
        out = both.mapInArrow(_test_sorted, names)
    if confused:
        wrong = cascades.filter("level < 0").select("h1", "h2").distinct().join(universe, ["h1", "h2"]).select(F.col("key").alias("known"), F.col("on").alias("so"))
        out = out.join(checked(wrong, confused, 128), out["key"] == wrong["known"], "left").withColumn("listed", F.coalesce("so", "listed"))
    return out.select("page_id", "url", "key", "listed")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds a list, so it is made of what pages hold: the keys of which any page has MANY_PARAGRAPHS paragraphs."""
    pages = table(spark, sf_dir, "pages")
    long = F.regexp_count("html", F.lit("<p>")) >= MANY_PARAGRAPHS
    return filter_urls(pages.select("page_id", "url"), pages.filter(long).select(url_key(F.col("url")).alias("key")))


OP7_SQL = rf"""
WITH h AS (SELECT page_id, url, html, regexp_replace(lower(regexp_extract(url, '{_URL}', 1)), '^www\.', '') AS host FROM pages),
p AS (SELECT page_id, url, html, CASE WHEN host <> '' THEN concat(host, regexp_replace(regexp_extract(url, '{_URL}', 2), '/+$', '')) END AS key FROM h),
list AS (SELECT DISTINCT key FROM p WHERE key IS NOT NULL AND len(regexp_extract_all(html, '<p>')) >= {MANY_PARAGRAPHS})
SELECT page_id, url, key, key IS NOT NULL AND key IN (SELECT key FROM list) AS listed
FROM p
"""
