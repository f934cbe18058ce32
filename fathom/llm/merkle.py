"""Fingerprints of documents: Merkle trees over paragraphs and sections, and where versions differ."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed, table

#: A paragraph whose fingerprint is less begins a section: one in 4 is, wherever it stands, so an insertion leaves other sections alone.
MARK = "4"


def _slices(leaves: Column, starts: Column) -> Column:
    """The leaves of each section."""
    return F.transform(starts, lambda s, j: F.slice(leaves, s, F.coalesce(F.get(starts, j + 1), F.size(leaves) + 1) - s))


def trees(docs: DataFrame) -> DataFrame:
    """docs with `leaves`, `starts`, `sections` and `root`.

    Paragraphs are what newlines separate; a leaf is the MD5 of one.  A section
    begins at the first paragraph and at each whose leaf is less than MARK (starts
    counts from 1); its fingerprint is the MD5 of its leaves, and the root that of
    the sections', each in hexadecimal, concatenated.  Equal roots mean equal texts.
    A null text has nulls; an empty one is one empty paragraph.
    """
    base = docs.withColumn("leaves", F.transform(F.split("text", "\n"), lambda p: F.md5(p.cast("binary"))))
    marks = F.transform("leaves", lambda x, i: F.when((i == 0) | (x < MARK), i + 1))
    base = base.withColumn("starts", F.array_compact(marks))
    base = base.withColumn("sections", F.transform(_slices(F.col("leaves"), F.col("starts")), lambda s: F.md5(F.array_join(s, "").cast("binary"))))
    return base.withColumn("root", F.md5(F.array_join("sections", "").cast("binary")))


def sentences(text: Column) -> Column:
    """Hashes of the sentences of a text, each once: what full stops, marks and newlines end, as lower-case words."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.!?\n]+", " ")
    return F.array_distinct(F.transform(F.filter(F.split(words, r" ?[.!?\n][ .!?\n]*"), lambda s: F.trim(s) != ""), lambda s: F.xxhash64(F.trim(s))))


def _bytes(fingerprints: Column) -> Column:
    """Fingerprints in hexadecimal as one binary of 16 bytes each: all of an MD5 at half its width, without an offset for each."""
    return F.unhex(F.array_join(fingerprints, ""))


def _split(b: bytes) -> list[bytes]:
    return [b[i : i + 16] for i in range(0, len(b), 16)]


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Descends two trees: sections that the other lacks, and in these the paragraphs that it lacks, both ways."""
    for b in batches:
        out: list[tuple[int, str, str, str]] = []
        for row in b.to_pylist():
            row |= {c: _split(row[c]) for c in ("leaves", "leaves0", "sections", "sections0")}
            spans = list(zip(row["starts"], [*row["starts"][1:], len(row["leaves"]) + 1], row["sections"], strict=True))
            spans0 = list(zip(row["starts0"], [*row["starts0"][1:], len(row["leaves0"]) + 1], row["sections0"], strict=True))
            known, known0, has, has0 = set(row["sections"]), set(row["sections0"]), set(row["leaves"]), set(row["leaves0"])
            changed = [i for i, (_, _, h) in enumerate(spans, 1) if h not in known0]
            new = [p for i in changed for p in range(*spans[i - 1][:2]) if row["leaves"][p - 1] not in has0]
            gone = [p for a, z, h in spans0 if h not in known for p in range(a, z) if row["leaves0"][p - 1] not in has]
            out.append((row["__key"], *(",".join(map(str, x)) for x in (changed, new, gone))))
        names = ["__key", "changed_sections", "changed_paragraphs", "removed_paragraphs"]
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, root, n_paragraphs, n_sections, base, same, n_shared, changed_sections, changed_paragraphs, removed_paragraphs) for each of docs (doc_id, text).

    base is the earlier document that this one may be a version of: the first with an
    equal root, else, of the documents that come first with any of its sentences (as
    lower-case words), the one with most of them, n_shared, the least of equals; null
    if none of its sentences came before.  same says whether both roots are equal.
    Else the trees are descended: changed_sections has the places (from 1) of sections
    that base lacks, changed_paragraphs those of the paragraphs in them that base
    lacks, and removed_paragraphs the places, in base, of paragraphs that this one
    lacks, comma-separated.  So what was edited is in both lists, what was added or
    deleted in one of them; what only changed its place is in none.

    Null texts have a null root and 0 paragraphs, and are no one's base; texts without
    a word have a base only by an equal root; texts may be of any length; an empty
    table gives an empty one.  Rows that repeat a doc_id, and null ones, are ordered
    by text, so a repeated row has the first as its base.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    t = trees(rows).withColumns({"n_paragraphs": F.coalesce(F.size("leaves"), F.lit(0)), "n_sections": F.coalesce(F.size("sections"), F.lit(0))})
    t = t.withColumns({"leaves": _bytes(F.col("leaves")), "sections": _bytes(F.col("sections")), "sentences": sentences(F.col("text"))})
    t = scratch.write("trees", t.drop("text"))
    # Who comes first is an aggregate that combines before its shuffle, and the joins with it are split where a key is hot.
    equal = t.groupBy("root").agg(F.min("__key").alias("first"), F.count("root").alias("n")).filter("n > 1").select("root", "first")
    equal = scratch.write("equal", t.select("__key", "root").join(equal, "root").filter("first < __key").select("__key", F.col("first").alias("owner")))
    parts = t.select("__key", F.explode("sentences").alias("part"))
    owners = parts.groupBy("part").agg(F.min("__key").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("part", "owner")
    shared = parts.join(owners, "part").filter("owner < __key").groupBy("__key", "owner").agg(F.count(F.lit(1)).alias("n"))
    shared = shared.join(equal.select("__key"), "__key", "left_anti")
    most = shared.groupBy("__key").agg(F.max("n").alias("n"))
    best = scratch.write("best", shared.join(most, ["__key", "n"]).groupBy("__key").agg(F.min("owner").alias("owner"), F.max("n").alias("n_shared")))
    old = t.select(F.col("__key").alias("owner"), *(F.col(c).alias(f"{c}0") for c in ("leaves", "starts", "sections")))
    differing = best.join(t.select("__key", "leaves", "starts", "sections"), "__key").join(old, "owner").select("__key", "leaves", "starts", "sections", "leaves0", "starts0", "sections0")
    found = differing.mapInArrow(_differences, "__key long, changed_sections string, changed_paragraphs string, removed_paragraphs string")
    chosen = best.join(found, "__key").withColumn("same", F.lit(False))
    none = F.lit("")
    chosen = chosen.unionByName(equal.select("__key", "owner", F.lit(None).cast("long").alias("n_shared"), none.alias("changed_sections"), none.alias("changed_paragraphs"), none.alias("removed_paragraphs"), F.lit(True).alias("same")))
    chosen = chosen.join(t.select(F.col("__key").alias("owner"), F.col("doc_id").alias("base")), "owner")
    out = t.select("__key", "doc_id", "root", "n_paragraphs", "n_sections", F.size("sentences").cast("long").alias("n_sentences"))
    shares = F.when(F.col("same"), F.col("n_sentences")).otherwise(F.col("n_shared")).alias("n_shared")
    return out.join(chosen, "__key", "left").select("doc_id", "root", "n_paragraphs", "n_sections", "base", "same", shares, "changed_sections", "changed_paragraphs", "removed_paragraphs")


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, md5(para) AS leaf FROM p),
s AS (SELECT *, sum(CASE WHEN i = 1 OR leaf < '{MARK}' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l),
sections AS (SELECT doc_id, sec, md5(string_agg(leaf, '' ORDER BY i)) AS hash FROM s GROUP BY ALL),
roots AS (SELECT doc_id, md5(string_agg(hash, '' ORDER BY sec)) AS root, count(*) AS n_sections FROM sections GROUP BY doc_id),
sentences AS (SELECT DISTINCT doc_id, trim(x) AS sentence FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}.!?\n]+', ' ', 'g'), ' ?[.!?\n][ .!?\n]*')) AS x FROM documents) WHERE trim(x) <> ''),
sizes AS (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id),
equal AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS owner FROM roots QUALIFY owner < doc_id),
owners AS (SELECT sentence, min(doc_id) AS owner FROM sentences GROUP BY sentence),
shared AS (SELECT doc_id, owner, count(*) AS n FROM sentences JOIN owners USING (sentence) WHERE owner < doc_id AND doc_id NOT IN (SELECT doc_id FROM equal) GROUP BY ALL),
best AS (SELECT doc_id, owner, n FROM shared QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, owner) = 1),
changed AS (SELECT doc_id, sec FROM sections JOIN best USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM sections q WHERE q.doc_id = best.owner AND q.hash = sections.hash)),
new AS (SELECT s.doc_id, s.i FROM s JOIN changed USING (doc_id, sec) JOIN best USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM l q WHERE q.doc_id = best.owner AND q.leaf = s.leaf)),
lost AS (SELECT best.doc_id, s.i FROM best JOIN s ON s.doc_id = best.owner WHERE NOT EXISTS (SELECT 1 FROM l q WHERE q.doc_id = best.doc_id AND q.leaf = s.leaf)),
cs AS (SELECT doc_id, string_agg(sec::VARCHAR, ',' ORDER BY sec) AS x FROM changed GROUP BY doc_id),
cp AS (SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS x FROM new GROUP BY doc_id),
rp AS (SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS x FROM lost GROUP BY doc_id)
SELECT d.doc_id, r.root, coalesce(len(string_split(d.text, chr(10))), 0)::INTEGER AS n_paragraphs, coalesce(r.n_sections, 0)::INTEGER AS n_sections,
  coalesce(e.owner, b.owner) AS base, CASE WHEN e.owner IS NOT NULL THEN true WHEN b.owner IS NOT NULL THEN false END AS same,
  CASE WHEN e.owner IS NOT NULL THEN coalesce(z.n, 0) ELSE b.n END AS n_shared,
  CASE WHEN e.owner IS NOT NULL THEN '' WHEN b.owner IS NOT NULL THEN coalesce(cs.x, '') END AS changed_sections,
  CASE WHEN e.owner IS NOT NULL THEN '' WHEN b.owner IS NOT NULL THEN coalesce(cp.x, '') END AS changed_paragraphs,
  CASE WHEN e.owner IS NOT NULL THEN '' WHEN b.owner IS NOT NULL THEN coalesce(rp.x, '') END AS removed_paragraphs
FROM documents d LEFT JOIN roots r USING (doc_id) LEFT JOIN equal e USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN sizes z USING (doc_id)
LEFT JOIN cs ON cs.doc_id = d.doc_id LEFT JOIN cp ON cp.doc_id = d.doc_id LEFT JOIN rp ON rp.doc_id = d.doc_id
"""
