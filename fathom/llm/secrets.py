"""Secrets in texts: keywords by Aho-Corasick, anchored regular expressions near them, then the checksum that a secret holds."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Taken, packed, recounted, slices, table

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: A generic value must have so many bits of entropy a character.
MIN_ENTROPY = 3.0
#: Or so many characters at its beginning.
BEGINNING = 256


def base62_crc32(body: str) -> str:
    """The six base-62 digits of the CRC-32 of body, most significant first."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _B62[d] + out
    return out


def _crc(m: re.Match) -> bool | None:
    body = m["v"].rpartition("_")[2]
    return base62_crc32(body[:-6]) == body[-6:]


def _random(counts: Counter, size: int) -> bool:
    bits = -sum(n / size * math.log2(n / size) for n in sorted(counts.values()))
    return bits >= MIN_ENTROPY and any(c.isdigit() for c in counts)


def _entropy(m: re.Match) -> bool | None:
    """Of the value or its beginning: what follows a secret without a blank, as a line of dashes, doesn't hide it."""
    v = m["v"]
    return None if _random(Counter(v), len(v)) or _random(Counter(v[:BEGINNING]), min(len(v), BEGINNING)) else False


def _jwt(m: re.Match) -> bool | None:
    head = m["v"].split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def _pem(m: re.Match) -> bool | None:
    """Whether the body is base64 of one DER sequence of just the length that it states; encrypted bodies can't be told."""
    body = m["body"]
    if ":" in body:
        return None
    try:
        der = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if b"openssh-key-v1" in der[:16]:
        return True
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == der[1] + 2
    k = der[1] & 0x7F
    return len(der) == int.from_bytes(der[2 : 2 + k], "big") + 2 + k


def _wif(m: re.Match) -> bool | None:
    """Base58Check: the last four bytes are the start of the double SHA-256 of those before."""
    n = 0
    for c in m["v"]:
        n = n * 58 + "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz".index(c)
    b = n.to_bytes(40, "big").lstrip(b"\0")
    return hashlib.sha256(hashlib.sha256(b[:-4]).digest()).digest()[:4] == b[-4:]


def _unchecked(m: re.Match) -> bool | None:
    return None


class Detector(NamedTuple):
    name: str
    #: In lower case.  A hit is where one of them begins.
    keywords: tuple[str, ...]
    #: Matched where a keyword begins; the group v is the secret.
    pattern: str
    #: True: confirmed, False: no secret, None: it holds nothing to check.
    check: Callable[[re.Match], bool | None]


_GENERIC = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "accesskey", "auth_key", "private_key", "client_key")
#: In order of precedence where they overlap.
DETECTORS = (
    Detector("pem_private_key", ("-----begin",), r"(?P<v>-----BEGIN (?P<kind>[A-Z ]*)PRIVATE KEY-----(?P<body>[A-Za-z0-9+/=\s:,-]{16,}?)-----END (?P=kind)PRIVATE KEY-----)", _pem),
    Detector("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9])(?P<v>gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc),
    Detector("github_pat", ("github_pat_",), r"(?P<v>github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59})(?![A-Za-z0-9])", _unchecked),
    Detector("npm_token", ("npm_",), r"(?<![A-Za-z0-9])(?P<v>npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc),
    Detector("aws_access_key", ("akia", "asia"), r"(?<![A-Za-z0-9])(?P<v>A[KS]IA[A-Z2-7]{16})(?![A-Za-z0-9])", _unchecked),
    Detector("google_api_key", ("aiza",), r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", _unchecked),
    Detector("gitlab_pat", ("glpat-",), r"(?<![A-Za-z0-9])(?P<v>glpat-[A-Za-z0-9_-]{20})(?![A-Za-z0-9_-])", _unchecked),
    Detector("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(?P<v>xox[abprs]-[0-9]{6,}+-[A-Za-z0-9-]{10,}+)", _unchecked),
    Detector("stripe_key", ("sk_live_", "rk_live_"), r"(?P<v>[sr]k_live_[A-Za-z0-9]{16,}+)", _unchecked),
    Detector("jwt", ("eyj",), r"(?<![A-Za-z0-9_-])(?P<v>eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+)", _jwt),
    Detector("wif_key", ("wif", "bitcoin"), r"(?i:wif|bitcoin)[\s:=\"'a-zA-Z]{1,24}?(?<![A-Za-z0-9])(?P<v>[5KL][1-9A-HJ-NP-Za-km-z]{50,51})(?![A-Za-z0-9])", _wif),
    Detector("assignment", _GENERIC, r"(?i:%s)[A-Za-z0-9_]{0,16}[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}[\"']?(?P<v>[A-Za-z0-9+/_.=~-]{16,}+)" % "|".join(map(re.escape, _GENERIC)), _entropy),
)


class Finding(NamedTuple):
    detector: str
    begin: int
    end: int
    verified: bool


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


class Scanner:
    def __init__(self, detectors: tuple[Detector, ...] = DETECTORS):
        self.detectors = [(d, re.compile(d.pattern)) for d in detectors]
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, d in enumerate(detectors):
            for k in d.keywords:
                by.setdefault(k, []).append(i)
        for k, which in by.items():
            self.automaton.add_word(k, (len(k), which))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> list[Finding]:
        found: list[tuple[int, int, int, bool]] = []
        if not text:
            return []
        #: Values judged by entropy, by where they end.
        runs: dict[tuple[int, int], set[int]] = {}
        for end, (size, which) in self.automaton.iter(_lower(text)):
            at = end - size + 1
            for i in which:
                d, pattern = self.detectors[i]
                if not (m := pattern.match(text, at)):
                    continue
                if d.check is _entropy:
                    runs.setdefault((i, m.end("v")), set()).add(m.start("v"))
                elif (ok := d.check(m)) is not False:
                    found.append((i, m.start("v"), m.end("v"), bool(ok)))
        for (i, end), starts in runs.items():
            # A long value may hold many keywords, each with the rest of it as its value: its characters are counted once, from the end.
            counts: Counter = Counter()
            upto = end
            for at in sorted(starts, reverse=True):
                counts.update(text[at:upto])
                upto = at
                first = text[at : min(end, at + BEGINNING)]
                if _random(counts, end - at) or _random(Counter(first), len(first)):
                    found.append((i, at, end, False))
        out: list[Finding] = []
        taken = Taken()
        for i, a, b, ok in sorted(set(found)):
            if taken.add(a, b):
                out.append(Finding(self.detectors[i][0].name, a, b, ok))
        return sorted(out, key=lambda f: f.begin)


def redacted(text: str, found: list[Finding]) -> str:
    """text with each finding, which come in order, replaced by its detector's name in brackets."""
    out, at = [], 0
    for f in found:
        out += (text[at : f.begin], f"[{f.detector}]")
        at = f.end
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for b in batches:
        rows = [(k, f, text) for k, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for f in scanner.scan(text)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in rows], pa.int64()),
                pa.array([f.detector for _, f, _ in rows], pa.string()),
                pa.array([f.begin for _, f, _ in rows], pa.int64()),
                pa.array([f.end for _, f, _ in rows], pa.int64()),
                pa.array([f.verified for _, f, _ in rows], pa.bool_()),
                pa.array([hashlib.sha256(t[f.begin : f.end].encode(errors="surrogatepass")).hexdigest() for _, f, t in rows], pa.string()),
            ],
            ["doc_id", "detector", "begin", "end", "verified", "digest"],
        )


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for b in batches:
        for s in slices(b, "text", 8 << 20):
            texts = s.column("text").to_pylist()
            n = []
            for i, text in enumerate(texts):
                found = scanner.scan(text)
                if found:
                    texts[i] = redacted(text, found)
                n.append(len(found))
            keep = [c for c in s.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(n, pa.int32())], [*keep, "text", "n_secrets"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, detector, begin, end, verified, digest) for each secret in docs (doc_id, text).

    One Aho-Corasick pass over each whole text finds keywords; only there is the
    detector's regular expression tried, anchored; a match whose checksum or
    structure (CRC-32 of tokens, DER lengths, JWT headers, Base58Check, entropy of
    generic values) is wrong is no secret.  verified says that there was one and it
    was right.  Where findings overlap, the detector that comes first in DETECTORS
    wins.  begin and end count characters; digest is the SHA-256 of the secret,
    which isn't shown.

    Null and empty texts have no secrets; texts and secrets may be of any length; a
    null doc_id is kept as such; repeated rows give repeated findings; other columns
    are ignored; an empty table has no findings.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, detector string, begin long, end long, verified boolean, digest string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by its detector's name in brackets, and n_secrets.

    Rows and other columns stay, a column n_secrets is replaced.  Null and empty texts
    stay as they are, with 0 secrets; of a text of any length each secret goes to its
    last character; repeated rows are treated alike; an empty table stays one.
    """
    base, back = packed(docs, "n_secrets")
    others = [f for f in base.schema if f.name != "text"]
    schema = T.StructType([*others, T.StructField("text", T.StringType()), T.StructField("n_secrets", T.IntegerType())])
    return base.mapInArrow(_redact, schema).select(*back(), "n_secrets")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts secrets; n_chars, where there is one, follows the text.  No row is dropped: null and empty texts, repeated rows and an empty table stay."""
    base, back = packed(docs)
    return recounted(redact_secrets(base), F.col("n_secrets") > 0, docs, back)
