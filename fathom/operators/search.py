"""Search in text fields: substrings, edit distance, BM25, highlights."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..sources.shared import checked, written

K1, B = 1.2, 0.75
#: Idf never falls below this.
LEAST_IDF = 0.1
#: Words that carry no meaning of their own; callers may give others.
STOP_WORDS = frozenset("a i be he me we of am an in on do go to or as is us at it by my had add led did and see she the die are use ask him can ran win won run her for our has was his its sat get met set sit got not but cut put you saw pay say try buy lead read need died used paid said held hold told send find made make take came name come were lose gave have give live love move with walk took work feel call fall fell tell kill will seem them from been open turn stop hear your does goes this sets cuts puts that meet left wait felt sent went lost knew grew show know grow play stay they added tried asked lived loved moved build could would stand spend found stood heard spoke these those write wrote leave serve being bring reach watch speak think learn offer their reads built spent start allow needed walked worked called killed seemed opened turned waited served showed played stayed should change became become create happen remain appear expect bought follow changed reached watched learned stopped offered created started allowed provide include believe thought brought content provided included happened remained appeared expected believed followed continue remember consider articles products continued remembered considered understand understood".split())


def text_fields(df: DataFrame, fields: list[str] | None) -> list[str]:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if fields is None:
        return names
    if missing := [f for f in fields if f not in names]:
        raise ValidationError(f"no text field {missing[0]}")
    return list(fields)


def substring(df: DataFrame, query: str, fields: list[str] | None = None) -> DataFrame:
    """Rows with the query in a text field, in any case; an empty query finds all."""
    out = F.lit(query == "")
    for f in text_fields(df, fields):
        out = out | F.coalesce(F.contains(F.lower(F.col(f"`{f}`")), F.lit(query.lower())), F.lit(False))
    return df.filter(out)


def fuzzy(df: DataFrame, query: str, distance: int, fields: list[str] | None = None, score: str = "_score") -> DataFrame:
    """Rows with words within an edit distance of the query's, and their score.

    Each pair of a word of the query and one of a text field that are at most
    `distance` apart adds 1 / (1 + 0.3 times their distance).
    """
    terms = query.lower().split()
    total = F.lit(0.0)
    for f in text_fields(df, fields):
        words = F.filter(F.split(F.lower(F.coalesce(F.col(f"`{f}`"), F.lit(""))), r"\s+"), lambda w: w != "")
        for t in terms:
            near = F.filter(F.transform(F.filter(words, lambda w: F.abs(F.char_length(w) - len(t)) <= distance), lambda w: F.levenshtein(w, F.lit(t), distance)), lambda d: d >= 0)
            total = total + F.aggregate(near, F.lit(0.0), lambda a, d: a + 1 / (1 + 0.3 * d))
    return df.withColumn(score, total).filter(F.col(score) > 0)


def words_of(text: Column, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """The words of a text: runs of letters, digits and underscores in lower case, of two bytes or more, that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*sorted(stop_words)) if stop_words else F.octet_length(w) > 1)


def _word_pattern(stop_words: frozenset[str]) -> str:
    """An expression that matches once for each word that words_of gives."""
    by: dict[str, list[str]] = {}
    for w in sorted(stop_words):
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    stops = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by.items())
    none = rf"(?!(?:{stops})(?![\p{{L}}\p{{N}}_]))" if stops else ""
    return rf"(?<![\p{{L}}\p{{N}}_]){none}(?:[\p{{L}}\p{{N}}_]{{2,}}+|[\p{{L}}\p{{N}}&&[^\x00-\x7F]])"


def count_of(text: Column, word: str) -> Column:
    """How often a word stands in a text in lower case."""
    return F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(word)}(?![\p{{L}}\p{{N}}_])"))


def query_words(query: str, stop_words: frozenset[str] = STOP_WORDS) -> list[str]:
    return [w for w in re.findall(r"\w+", query.lower()) if len(w.encode()) > 1 and w not in stop_words]


def bm25(df: DataFrame, field: str, query: str, *, key: Column | None = None, distance: int = 0, k1: float = K1, b: float = B, stop_words: frozenset[str] = STOP_WORDS, score: str = "_score") -> DataFrame:
    """Rows with words of the query in a text field, scored by BM25; a word that the query repeats counts as often.

    With a distance, each word of the texts within it of a word of the query counts,
    divided by 1 + 0.3 times its distance.  Statistics are of all rows of df.  The
    one row of totals and document frequencies is all that leaves the scan: its size
    is that of the query, or of the query's neighbours in the vocabulary.  With a key,
    texts are read once, and what was counted is joined back by it, unless some rows
    have the same key or none.
    """
    text_fields(df, [field])
    terms = query_words(query, stop_words)
    if not terms:
        return df.withColumn(score, F.lit(0.0)).limit(0)
    if distance:
        return _bm25_fuzzy(df, words_of(F.coalesce(F.col(f"`{field}`"), F.lit("")), stop_words), terms, key, distance, k1, b, score)
    # Expressions count in compiled code what a list of words would be made for.
    text = F.lower(F.coalesce(F.col(f"`{field}`"), F.lit("")))
    each = list(dict.fromkeys(terms))
    tf = {f"__tf{i}": F.when(F.contains(text, F.lit(t)), count_of(text, t)).otherwise(0) for i, t in enumerate(each)}
    counted, once = _counted(df, {"__n": F.regexp_count(text, F.lit(_word_pattern(stop_words))), **tf}, key)
    stats = counted.agg(F.count(F.lit(1)).alias("__docs"), F.avg("__n").alias("__mean"), *(F.count_if(F.col(c) > 0).alias(f"__df{i}") for i, c in enumerate(tf)))
    found = counted.filter(F.greatest(*tf, F.lit(0)) > 0)
    total = F.lit(0.0)
    for i, t in enumerate(each):
        total = total + terms.count(t) * _weight(F.col(f"__tf{i}"), F.col("__n"), F.col("__mean"), k1, b) * _idf(F.col(f"__df{i}"), F.col("__docs"))
    return _back(df, found.crossJoin(F.broadcast(stats)).withColumn(score, total).filter(F.col(score) > 0), key if once else None, score)


def _counted(df: DataFrame, counts: dict[str, Column], key: Column | None) -> tuple[DataFrame, bool]:
    """Counts of each row with its key as __sid, written by one pass over df, and True; df with the counts, and False, where keys don't tell its rows apart."""
    if key is not None:
        once = written(df.select(key.alias("__sid"), *(c.alias(n) for n, c in counts.items())))
        if not once.groupBy("__sid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR __sid IS NULL").take(1):
            return once, True
    return df.withColumns(counts), False


def _back(df: DataFrame, scored: DataFrame, key: Column | None, score: str) -> DataFrame:
    """The columns of df with the score, out of rows that are scored by the key if there is one, else whole."""
    if key is not None:
        scored = scored.select("__sid", score)
        scored = df.withColumn("__sid", key).join(checked(scored, scored.count(), 64), "__sid")
    return scored.select(*df.columns, score)


def _idf(df: Column, docs: Column) -> Column:
    return F.when(df >= docs, F.lit(LEAST_IDF)).otherwise(F.greatest(F.log((docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF)))


def _weight(tf: Column, n: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / F.when(mean > 0, mean).otherwise(1.0)))


def _bm25_fuzzy(df: DataFrame, words: Column, terms: list[str], key: Column | None, distance: int, k1: float, b: float, score: str) -> DataFrame:
    near = lambda w: [F.levenshtein(w, F.lit(t), distance) for t in terms]
    any_near = lambda w: F.array_max(F.array(*near(w))) >= 0
    counted, once = _counted(df, {"__n": F.size(words), "__w": F.filter(words, any_near)}, key)
    totals = counted.agg(F.count(F.lit(1)).alias("__docs"), F.avg("__n").alias("__mean"))
    frequencies = counted.select(F.explode(F.array_distinct("__w")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # One row that grows with the query's neighbours in the vocabulary, so whether it is broadcast is left to its measured size.
    table = frequencies.agg(F.map_from_entries(F.collect_list(F.struct("w", "df"))).alias("__df"))
    joined = counted.filter(F.size("__w") > 0).crossJoin(F.broadcast(totals)).crossJoin(table)

    def of(w: Column) -> Column:
        tf = F.size(F.filter("__w", lambda x: x == w))
        closeness = sum((F.when(d >= 0, 1 / (1 + 0.3 * d)).otherwise(0.0) for d in near(w)), F.lit(0.0))
        return _weight(tf, F.col("__n"), F.col("__mean"), k1, b) * _idf(F.element_at("__df", w), F.col("__docs")) * closeness

    total = F.aggregate(F.transform(F.array_distinct("__w"), of), F.lit(0.0), lambda a, x: a + x)
    return _back(df, joined.withColumn(score, total).filter(F.col(score) > 0), key if once else None, score)


def inverted_index(df: DataFrame, field: str, sid: Column, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(word, sid, n): the words of a text field with the rows that hold them, and how often."""
    text_fields(df, [field])
    words = df.select(sid.alias("sid"), F.explode(words_of(F.col(f"`{field}`"), stop_words)).alias("word"))
    return words.groupBy("word", "sid").agg(F.count(F.lit(1)).alias("n"))


def highlight(text: Column, query: str) -> Column:
    """The text with each occurrence of a word of the query, in any case, within <mark>."""
    terms = sorted(set(query.split()), key=lambda t: (-len(t), t))
    if not terms:
        return text
    quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in terms)
    return F.regexp_replace(text, f"(?i)({quoted})", "<mark>$1</mark>")


# ---------------------------------------------------------------- a stored index

#: A row for each time that a word stands in a row, with that row's number of words.
POSTINGS = "word string, sid string, length int"
#: Stands in the index for the whole of a row; no word is empty.
WHOLE = ""


def postings(df: DataFrame, field: str, sid: Column, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """POSTINGS of a text field, and one of WHOLE for each row, also of a null text, which has no words.

    Each row gives its own, so nothing is shuffled; equal ones lie together once they
    are sorted by word, and are counted where a query asks for them.
    """
    text_fields(df, [field])
    words = words_of(F.coalesce(F.col(f"`{field}`"), F.lit("")), stop_words)
    counted = df.select(sid.alias("sid"), words.alias("words")).withColumn("length", F.size("words"))
    return counted.select(F.explode(F.concat(F.array(F.lit(WHOLE)), "words")).alias("word"), "sid", "length")


def scored(index: DataFrame, query: str, docs: int, mean: float, *, k1: float = K1, b: float = B, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame | None:
    """(sid, _score) by BM25 for the rows with words of the query; None if it has none."""
    terms = query_words(query, stop_words)
    if not terms:
        return None
    mine = index.filter(F.col("word").isin(sorted(set(terms)))).groupBy("word", "sid", "length").agg(F.count(F.lit(1)).alias("n"))
    df = {r["word"]: r["n"] for r in mine.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of the query
    share = F.lit(0.0)
    for w, n in df.items():
        share = F.when(F.col("word") == w, F.lit(float(terms.count(w))) * _idf(F.lit(n), F.lit(docs))).otherwise(share)
    weight = _weight(F.col("n"), F.col("length"), F.lit(mean), k1, b)
    return mine.groupBy("sid").agg(F.sum(weight * share).alias("_score")).filter("_score > 0")
