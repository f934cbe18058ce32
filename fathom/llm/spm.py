"""SentencePiece encoding of the merge type, by backtracking, and decoding."""

from __future__ import annotations

import heapq
import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The id that ends a document.
END = 2
#: Words and pairs of pieces that a worker remembers; it forgets all when there are more.
REMEMBER = 1 << 19
#: Longer words aren't remembered.
LONG = 48


class Piece(NamedTuple):
    text: str
    score: float
    #: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte.
    kind: int


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 0x7F) << shift
        at += 1
        if b[at - 1] < 0x80:
            return n, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        if tag & 7 == 0:
            v, at = _varint(b, at)
        elif tag & 7 == 2:
            n, at = _varint(b, at)
            v, at = b[at : at + n], at + n
        else:
            n = 8 if tag & 7 == 1 else 4
            v, at = b[at : at + n], at + n
        yield tag >> 3, v


def read_model(b: bytes) -> list[Piece]:
    """The pieces of a model; it must be of the merge type, without normalization, put a space before the text, and have no pieces that are user-defined or unused, which merging treats apart, and 65,536 at most."""
    pieces, kind, name, dummy, extra = [], 1, b"", True, True
    for k, v in _fields(b):
        if k == 1:
            f = dict(_fields(v))
            pieces.append(Piece(f.get(1, b"").decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, 1)))
        elif k == 2:
            kind = dict(_fields(v)).get(3, 1)
        elif k == 3:
            f = dict(_fields(v))
            name, dummy, extra = f.get(1, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
    if kind != 2 or name not in (b"", b"identity") or not dummy or extra:
        raise ValueError("only models of the merge type, without normalization and with a dummy prefix, are supported")
    if bad := [p.text for p in pieces if p.kind in (4, 5)]:
        raise ValueError(f"user-defined and unused pieces aren't supported: {bad[0]!r}")
    if len(pieces) > 1 << 16:
        raise ValueError("pieces must fit 16 bits")
    return pieces


class Codec:
    """Encodes and decodes as the model's library does."""

    def __init__(self, model: bytes):
        self.pieces = read_model(model)
        self.ids = {p.text: i for i, p in enumerate(self.pieces) if p.kind == 1}
        self.scores = [p.score for p in self.pieces]
        self.unknown = next(i for i, p in enumerate(self.pieces) if p.kind == 2)
        self.bytes_ = {int(p.text[3:5], 16): i for i, p in enumerate(self.pieces) if p.kind == 6}
        self.out = [bytes([int(p.text[3:5], 16)]) if p.kind == 6 else b"" if p.kind == 3 else " ⁇ ".encode() if p.kind == 2 else p.text.replace(SPACE, " ").encode() for p in self.pieces]
        self.compatible: dict[int, bool] = {}
        self.words = _Words(self)
        #: Whether no piece reaches from one word into the next, so that words can be encoded one by one.
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.runs: dict[int, list[int]] = {}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            # What merging never makes of its own text can't occur in an encoding.
            if (SPACE * 2 not in p or not self.by_words) and self.merge(p) == [i]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[int]:
        """The definition: again and again, of all neighbours that make a piece, merge those with the best score, the leftmost of equals."""
        n = len(text)
        ends, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap: list[tuple[float, int, int]] = []

        def propose(a: int) -> None:
            if a >= 0 and (b := right[a]) >= 0 and (i := self.ids.get(text[a : ends[b]])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, ends[b]))

        for a in range(n - 1):
            propose(a)
        while heap:
            _, a, end = heapq.heappop(heap)
            if not alive[a] or (b := right[a]) < 0 or ends[b] != end or ends[a] == end:
                continue
            alive[b] = False
            ends[a], right[a] = end, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            propose(left[a])
            propose(a)
        out: list[int] = []
        for a in range(n):
            if alive[a]:
                out.extend(self._piece(text[a : ends[a]]))
        return out

    def _piece(self, text: str) -> list[int]:
        i = self.ids.get(text)
        if i is not None:
            return [i]
        return [self.bytes_[b] for b in text.encode(errors="replace")] if self.bytes_ else [self.unknown]

    def fits(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are side by side: their text, merged anew, must give them back."""
        key = a << 16 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= REMEMBER:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(self.pieces[a].text + self.pieces[b].text) == [a, b]
        return known

    def backtrack(self, text: str) -> list[int]:
        """The encoding of a text whose characters are all pieces, as a path of compatible neighbours.

        From each place the longest piece that the automaton found there is tried,
        then shorter ones; a piece is taken if it fits the one before it and its end
        isn't known to lead nowhere; if none can be, this place is marked as failed in
        the bitfield and the piece before gives way to a shorter one.  Where no path is
        found, which can't be unless scores contradict the order of merges, the text is
        merged by the definition.
        """
        n = len(text)
        at_place: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.automaton.iter(text):
            at_place[end - size + 1].append((size, i))
        failed = bytearray((n >> 3) + 1)
        path: list[int] = []
        ways: list[Iterator[tuple[int, int]]] = []
        sizes: list[int] = []
        at = 0
        way = reversed(at_place[0])
        while at < n:
            last = path[-1] if path else -1
            for size, i in way:
                if not failed[(at + size) >> 3] >> ((at + size) & 7) & 1 and (last < 0 or self.fits(last, i)):
                    path.append(i)
                    sizes.append(size)
                    ways.append(way)
                    at += size
                    if at < n:
                        way = reversed(at_place[at])
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not path:
                    return self.merge(text)
                path.pop()
                at -= sizes.pop()
                way = ways.pop()
        return path

    def word(self, text: str) -> list[int]:
        """The encoding of a text without spaces but for one that may come first."""
        out: list[int] = []
        at = 0
        for k, c in enumerate(text):
            if c not in self.chars:
                if at < k:
                    out += self.backtrack(text[at:k])
                out += self._piece(c)
                at = k + 1
        if at < len(text):
            out += self.backtrack(text[at:])
        return out

    def spaced(self, spaces: int, body: str) -> list[int]:
        """The encoding of a run of spaces and the word after it."""
        if spaces < 2:
            return self.word(SPACE * spaces + body)
        rest = self.word(SPACE + body)
        n = spaces - 1
        if rest[0] == self.ids.get(SPACE):
            n, rest = spaces, rest[1:]
        if n not in self.runs:
            self.runs[n] = self.merge(SPACE * n)
        return self.runs[n] + rest

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; they are 16 bits wide."""
        if not text:
            return np.zeros(0, np.uint16)
        if not self.by_words:
            return np.array(self.word(SPACE + text.replace(" ", SPACE)), np.uint16)
        if "  " not in text and SPACE not in text and " \n" not in text and not text.startswith((" ", "\n")):
            # Neither a word nor a line break merges with what comes before it, so each is encoded once and remembered.
            return np.frombuffer(b"".join(self.words[w][0] for w in text.replace("\n", " \n").split(" ")), np.uint16)
        out: list[int] = []
        spaces = 1
        for k, body in enumerate(text.replace(SPACE, " ").split(" ")):
            if k:
                spaces += 1
            if body:
                out += self.spaced(spaces, body)
                spaces = 0
        if spaces:
            out += self.merge(SPACE * spaces)
        return np.array(out, np.uint16)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


class _Words(dict):
    """(encoding as bytes, whether it decodes to the word) by word.  A word comes after a space, unless it begins with a line break."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[bytes, bool]:
        spaced = word if word[:1] == "\n" else " " + word
        ids = self.codec.word(spaced.replace(" ", SPACE))
        out = np.array(ids, np.uint16).tobytes(), b"".join(map(self.codec.out.__getitem__, ids)) == spaced.encode()
        if len(word) <= LONG:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = out
        return out


def _split(texts: pa.Array, by_words: bool) -> tuple[np.ndarray, pa.Array]:
    """Which texts are made of words alone, and their words: what stands after a space, or begins with a line break."""
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.match_substring(texts, " \n"), pc.match_substring_regex(texts, "^[ \n]")))
    fast = pc.fill_null(pc.and_(pc.invert(odd), pc.not_equal(texts, "")), False).to_numpy(zero_copy_only=False) & by_words
    return fast, pc.split_pattern(pc.replace_substring(texts.filter(pa.array(fast)), "\n", " \n"), " ")


class Words:
    """The words of many texts at once: each distinct one is looked up once.

    fast: which texts are made of words alone; size, exact: tokens, and whether they
    decode to the text, of each of these.
    """

    def __init__(self, codec: Codec, texts: pa.Array):
        self.fast, words = _split(texts, codec.by_words)
        coded = words.flatten().dictionary_encode()
        known = [codec.words[w] for w in coded.dictionary.to_pylist()]
        self.codes = coded.indices.to_numpy()
        self.each = np.array([len(x) // 2 for x, _ in known], np.int64)
        self.flat = np.frombuffer(b"".join(x for x, _ in known), np.uint16)
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)[:-1]
        ok = np.array([x for _, x in known], bool)
        self.size = np.add.reduceat(self.each[self.codes], begin) if len(begin) else np.zeros(0, np.int64)
        self.exact = np.logical_and.reduceat(ok[self.codes], begin) if len(begin) else np.zeros(0, bool)

    def ids(self) -> np.ndarray:
        """The tokens of all these texts."""
        n = self.each[self.codes]
        ends = np.cumsum(n)
        begin = np.cumsum(self.each) - self.each
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[self.codes] - (ends - n), n)]


def _codec(model: bytes) -> Codec:
    """A worker keeps its codec, with what it remembers, from task to task."""
    kept = sys.modules.setdefault("fathom_kept", types.ModuleType("fathom_kept"))
    if getattr(kept, "model", None) != model:
        kept.model, kept.codec = model, Codec(model)
    return kept.codec


def _encode(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            for s in slices(b, "text", 4 << 20):
                words = Words(codec, s.column("text"))
                n, same = np.zeros(s.num_rows, np.int64), np.zeros(s.num_rows, bool)
                n[words.fast], same[words.fast] = words.size, words.exact
                parts = np.split(words.ids(), np.cumsum(words.size)[:-1]) if len(words.size) else []
                null = ~s.column("text").is_valid().to_numpy(zero_copy_only=False)
                if not (words.fast & same).all():
                    by = dict(zip(np.flatnonzero(words.fast).tolist(), parts, strict=True))
                    for i in np.flatnonzero(~(words.fast & same) & ~null).tolist():
                        text = s.column("text")[i].as_py()
                        ids = by[i] if i in by else codec.encode(text)
                        by[i], n[i], same[i] = ids, len(ids), codec.decode(ids) == text
                    parts = [by[i] for i in sorted(by)]
                flat = pa.array(np.concatenate([*parts, np.zeros(0, np.uint16)]).astype(np.int32))
                off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(null, False))
                others = [c for c in s.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in others), pa.ListArray.from_arrays(off, flat), pa.array(n), pa.array(same, mask=null)], [*others, "ids", "n_tokens", "exact"])

    return run


def _count(model: bytes, by_words: bool):
    """Counts by the model's own library, which is fast where only numbers are asked for; each distinct word is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # A word that begins with a line break has no space before it, which the library puts there.
        known: dict[str, int] = {"": len(library.encode("a ")) - len(library.encode("a"))}
        for b in batches:
            for s in slices(b, "text", 4 << 20):
                fast, words = _split(s.column("text"), by_words)
                coded = words.flatten().dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(known) > REMEMBER:
                    known = {"": known[""]}
                new = [w for w in distinct if w not in known]
                known.update((w, len(x) - (w[0] == "\n")) for w, x in zip(new, library.encode(new, num_threads=1), strict=True))
                each = np.array([known[w] for w in distinct], np.int64)
                begin = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)[:-1]
                n = np.zeros(s.num_rows, np.int64)
                n[fast] = np.add.reduceat(each[coded.indices.to_numpy()], begin) if len(begin) else 0
                for i in np.flatnonzero(~fast).tolist():
                    n[i] = len(library.encode(s.column("text")[i].as_py() or ""))
                others = [c for c in s.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in others), pa.array(n)], [*others, "n_tokens"])

    return run


def _decode(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            texts = pa.array([None if i is None else codec.decode([x for x in i if x is not None]) for i in b.column("ids").to_pylist()], pa.string())
            others = [c for c in b.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), texts], [*others, "text"])

    return run


def _load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) of docs (doc_id, text): the ids that the model's library gives.

    Whole texts are encoded, however long.  exact says whether decoding gives the
    text back; it doesn't where the text holds U+2581, which the model takes for a
    space.  A null text has null ids and exact and 0 tokens, an empty one no ids.
    Null doc_ids and repeated rows stay; other columns are ignored; an empty table
    gives no rows.  The model is read on the driver and sent to the executors; one
    that isn't of the merge type, normalizes texts, or has pieces that are
    user-defined, unused or more than 65,536 is refused.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(_load(model)), "doc_id long, ids array<int>, n_tokens long, exact boolean")


def count(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """docs (text and other columns) with n_tokens, the number of ids that encode gives, in the place of text; 0 for null."""
    b = _load(model)
    by_words = not any(SPACE in p.text.lstrip(SPACE) for p in read_model(b) if p.kind == 1)
    rest = [f for f in docs.schema if f.name != "text"]
    return docs.select(*(f"`{f.name}`" for f in rest), "text").mapInArrow(_count(b, by_words), T.StructType([*rest, T.StructField("n_tokens", T.LongType())]))


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of encoded (doc_id, ids); null ids give null, no ids an empty text, null among ids is passed over."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decode(_load(model)), "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
