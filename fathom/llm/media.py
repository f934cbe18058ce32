"""AVI files of motion JPEG: chunks by the RIFF index, frames decoded here, shots by adaptive histogram differences."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Grey levels of a histogram are grouped into so many bins, and a frame into so many cells a side.
BINS, CELLS = 16, 2
#: A cut: the difference exceeds the mean of those of its shot so far by so many standard deviations, and this least value.
SIGMAS, LEAST = 5.0, 0.2
#: A shorter shot is joined with the next; the last of a file may be shorter.
MIN_SHOT = 3


class BadMedia(ValueError):
    """Bytes that are no AVI file of motion JPEG, or a frame that can't be decoded."""


class Video(NamedTuple):
    #: Seconds of a frame.
    duration: float
    width: int
    height: int
    #: (offset, size) of each frame's bytes; size 0 repeats the frame before.
    frames: list[tuple[int, int]]


# ---------------------------------------------------------------- RIFF


def _chunks(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        size = min(size, end - at - 8)
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def parse(b: bytes) -> Video:
    """The video stream of an AVI file.

    Frames are those of the index idx1, or of OpenDML's super index; without either
    the chunks of movi are walked.
    """
    if len(b) < 12 or b[:4] != b"RIFF" or b[8:12] != b"AVI ":
        raise BadMedia("no AVI file")
    duration, width, height, stream, streams = 0.0, 0, 0, -1, -1
    movi: list[tuple[int, int]] = []
    index: tuple[int, int] | None = None
    super_index: list[tuple[int, int]] = []
    at = 0
    while at + 12 <= len(b) and b[at : at + 4] == b"RIFF":
        size = min(struct.unpack_from("<I", b, at + 4)[0], len(b) - at - 8)
        for name, start, n in _chunks(b, at + 12, at + 8 + size):
            if name == b"LIST" and b[start : start + 4] == b"movi":
                movi.append((start, n))
            elif name == b"idx1" and index is None:
                index = (start, n)
            elif name == b"LIST" and b[start : start + 4] == b"hdrl":
                for inner, s, m in _chunks(b, start + 4, start + n):
                    if inner == b"avih" and m >= 40:
                        duration = struct.unpack_from("<I", b, s)[0] / 1e6
                        width, height = struct.unpack_from("<II", b, s + 32)
                    elif inner == b"LIST" and b[s : s + 4] == b"strl":
                        streams += 1
                        mine = False
                        for part, p, k in _chunks(b, s + 4, s + m):
                            if part == b"strh" and k >= 32 and stream < 0 and b[p : p + 4] == b"vids":
                                stream, mine = streams, True
                                if b[p + 4 : p + 8].upper() not in (b"MJPG", b"\0\0\0\0"):
                                    raise BadMedia("no motion JPEG")
                                scale, rate = struct.unpack_from("<II", b, p + 20)
                                if scale and rate:
                                    duration = scale / rate
                            elif part == b"indx" and mine and k >= 24:
                                super_index = _super(b, p, k)
        at += 8 + size + (size & 1)
    if stream < 0 or not movi:
        raise BadMedia("no video stream")
    if duration <= 0:
        raise BadMedia("no frame rate")
    ids = (b"%02ddc" % stream, b"%02ddb" % stream)
    frames: list[tuple[int, int]] = []
    if super_index:
        for where, size in super_index:
            frames += _standard(b, where, size)
    elif index is not None:
        entries = [struct.unpack_from("<4sIII", b, index[0] + 16 * i) for i in range(index[1] // 16)]
        mine = [e for e in entries if e[0] in ids]
        if mine:
            # Offsets count from the start of movi's list type, or of the file.
            first = mine[0][2]
            base = movi[0][0] if b[movi[0][0] + first : movi[0][0] + first + 4] in ids else 0
            frames = [(base + o + 8, n) for _, _, o, n in mine]
    if not frames:
        frames = [(s, n) for start, size in movi for s, n in _walk(b, start + 4, start + size, ids)]
    if any(o < 0 or o + n > len(b) for o, n in frames):
        raise BadMedia("a frame lies outside the file")
    return Video(duration, width, height, frames)


def _walk(b: bytes, at: int, end: int, ids: tuple[bytes, ...]) -> Iterator[tuple[int, int]]:
    for name, start, n in _chunks(b, at, end):
        if name == b"LIST" and b[start : start + 4] == b"rec ":
            yield from _walk(b, start + 4, start + n, ids)
        elif name in ids:
            yield start, n


def _super(b: bytes, at: int, size: int) -> list[tuple[int, int]]:
    longs, _, kind, n = struct.unpack_from("<HBBI", b, at)
    if kind != 0 or longs != 4:
        return []
    return [struct.unpack_from("<QI", b, at + 24 + 16 * i) for i in range(min(n, (size - 24) // 16))]  # type: ignore[misc]


def _standard(b: bytes, at: int, size: int) -> list[tuple[int, int]]:
    if at + 32 > len(b):
        raise BadMedia("an index lies outside the file")
    n, base = struct.unpack_from("<I", b, at + 12)[0], struct.unpack_from("<Q", b, at + 20)[0]
    n = min(n, (len(b) - at - 32) // 8)
    return [(base + o, s & 0x7FFFFFFF) for o, s in (struct.unpack_from("<II", b, at + 32 + 8 * i) for i in range(n))]


# ---------------------------------------------------------------- JPEG

_ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_COS = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])

#: The tables of the standard, which motion JPEG may leave out: codes by length, then values.
_DC = ((bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))), (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))))
_AC = (
    (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]),
        bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    ),
    (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 0x77]),
        bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")),
    ),
)


#: What a task has made so far; functools' caches would be looked up by name, in a package that executors needn't have.
_TABLES: dict[tuple[bytes, bytes], list[int]] = {}
_FRAMES: dict[bytes, bytes] = {}


def _huffman(counts: bytes, values: bytes) -> list[int]:
    """By the next 16 bits: length of the code times 256, and its value; 0 for none."""
    if (counts, values) in _TABLES:
        return _TABLES[counts, values]
    table = [0] * 65536
    code = k = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if k >= len(values):
                raise BadMedia("bad Huffman table")
            low = code << (16 - length)
            for x in range(low, min(65536, low + (1 << (16 - length)))):
                table[x] = length << 8 | values[k]
            code, k = code + 1, k + 1
        code <<= 1
    if len(_TABLES) >= 64:
        _TABLES.clear()
    _TABLES[counts, values] = table
    return table


class _Component(NamedTuple):
    id: int
    h: int
    v: int
    quant: int


def decode(b: bytes) -> np.ndarray:
    """A baseline JPEG image: height by width of grey levels, or by 3 of red, green and blue.

    Restart intervals, any sampling and images without Huffman tables, as motion
    JPEG has them, are supported; progressive ones aren't intra frames of it.
    """
    if b[:2] != b"\xff\xd8":
        raise BadMedia("no JPEG image")
    quant: dict[int, np.ndarray] = {}
    dc, ac = dict(enumerate(_DC)), dict(enumerate(_AC))
    parts: list[_Component] = []
    width = height = interval = 0
    at = 2
    try:
        while True:
            while b[at] != 0xFF:
                at += 1
            while b[at] == 0xFF:
                at += 1
            mark, at = b[at], at + 1
            if mark in (0x01, *range(0xD0, 0xD8)):
                continue
            if mark == 0xD9:
                raise BadMedia("no scan")
            n = struct.unpack_from(">H", b, at)[0]
            s, at = b[at + 2 : at + n], at + n
            if mark == 0xDB:
                k = 0
                while k < len(s):
                    wide, which = s[k] >> 4, s[k] & 15
                    size = 128 if wide else 64
                    quant[which] = np.frombuffer(s[k + 1 : k + 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
                    k += 1 + size
            elif mark == 0xC4:
                k = 0
                while k < len(s):
                    total = sum(s[k + 1 : k + 17])
                    (ac if s[k] >> 4 else dc)[s[k] & 15] = (bytes(s[k + 1 : k + 17]), bytes(s[k + 17 : k + 17 + total]))
                    k += 17 + total
            elif mark in (0xC0, 0xC1):
                if s[0] != 8:
                    raise BadMedia("not 8 bits a sample")
                height, width = struct.unpack_from(">HH", s, 1)
                parts = [_Component(s[6 + 3 * i], s[7 + 3 * i] >> 4, s[7 + 3 * i] & 15, s[8 + 3 * i]) for i in range(s[5])]
            elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and mark != 0xCC:
                raise BadMedia("no baseline image")
            elif mark == 0xDD:
                interval = struct.unpack_from(">H", s)[0]
            elif mark == 0xDA:
                return _scan(b, at, s, parts, width, height, quant, dc, ac, interval)
    except (IndexError, struct.error, KeyError, ValueError) as e:
        raise BadMedia(str(e) or "broken image") from None


def _scan(b: bytes, at: int, head: bytes, parts: list[_Component], width: int, height: int, quant: dict, dc: dict, ac: dict, interval: int) -> np.ndarray:
    if not parts or not width or not height or head[0] != len(parts) or any(not 1 <= x <= 4 for p in parts for x in (p.h, p.v)):
        raise BadMedia("unsupported scan")
    tables = {head[1 + 2 * i]: (_huffman(*dc[head[2 + 2 * i] >> 4]), _huffman(*ac[head[2 + 2 * i] & 15])) for i in range(head[0])}
    most_h, most_v = max(p.h for p in parts), max(p.v for p in parts)
    if len(parts) == 1:
        parts, most_h, most_v = [parts[0]._replace(h=1, v=1)], 1, 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    blocks = {p.id: np.zeros((down * p.v, across * p.h, 64), np.int32) for p in parts}
    flat = {p.id: x.reshape(-1) for p, x in zip(parts, blocks.values(), strict=True)}
    plan = [(flat[p.id], *tables[p.id], p, across * p.h, i) for i, p in enumerate(parts)]
    zigzag = _ZIGZAG.tolist()
    last = [0] * len(parts)
    acc = bits = 0
    unit = 0
    for row in range(down):
        for col in range(across):
            if interval and unit and unit % interval == 0:
                acc = bits = 0
                last = [0] * len(parts)
                while not (b[at] == 0xFF and 0xD0 <= b[at + 1] <= 0xD7):
                    at += 1
                at += 2
            unit += 1
            for out, d, a, p, stride, which in plan:
                for v in range(p.v):
                    for h in range(p.h):
                        base = ((row * p.v + v) * stride + col * p.h + h) * 64
                        k, table = 0, d
                        while k < 64:
                            # 16 bits for a code and 16 for its value.
                            while bits < 32:
                                x = b[at] if at < len(b) else 0
                                if x == 0xFF:
                                    if at + 1 < len(b) and b[at + 1] == 0:
                                        at += 2
                                    else:
                                        x = 0  # a marker: the data ends here
                                else:
                                    at += 1
                                acc = (acc << 8 | x) & 0xFFFFFFFFFF
                                bits += 8
                            got = table[acc >> (bits - 16) & 0xFFFF]
                            if not got:
                                raise BadMedia("bad code")
                            bits -= got >> 8
                            size = got & 15
                            if k == 0:
                                size = got & 255
                                if size > 15:
                                    raise BadMedia("bad code")
                            else:
                                run = got >> 4 & 15
                                if size == 0:
                                    if run != 15:
                                        break
                                    k += 16
                                    continue
                                k += run
                                if k > 63:
                                    raise BadMedia("bad run")
                            value = 0
                            if size:
                                bits -= size
                                value = acc >> bits & ((1 << size) - 1)
                                if value < 1 << (size - 1):
                                    value -= (1 << size) - 1
                            if k == 0:
                                last[which] += value
                                value, table = last[which], a
                            out[base + zigzag[k]] = value
                            k += 1
    planes = []
    for p in parts:
        q = np.zeros(64, np.int32)
        q[_ZIGZAG] = quant[p.quant]
        f = (blocks[p.id] * q).reshape(*blocks[p.id].shape[:2], 8, 8).astype(np.float64)
        x = np.einsum("rcuv,uy,vx->rycx", f, _COS, _COS, optimize=True)
        x = x.reshape(x.shape[0] * 8, -1) + 128
        x = x.repeat(most_v // p.v, 0).repeat(most_h // p.h, 1) if most_v % p.v == 0 == most_h % p.h else x[np.arange(down * most_v * 8) * p.v // most_v][:, np.arange(across * most_h * 8) * p.h // most_h]
        planes.append(x[:height, :width])
    if len(planes) < 3:
        return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- shots


def histogram(image: np.ndarray, bins: int = BINS, cells: int = CELLS) -> np.ndarray:
    """Shares of grey levels (of each colour) in each cell of the image; each cell's sum to 1."""
    image = image if image.ndim == 3 else image[:, :, None]
    h, w, c = image.shape
    y = np.minimum(np.arange(h) * cells // max(h, 1), cells - 1)
    x = np.minimum(np.arange(w) * cells // max(w, 1), cells - 1)
    cell = (y[:, None] * cells + x[None, :])[:, :, None] * c + np.arange(c)[None, None, :]
    flat = cell * bins + (image.astype(np.int64) * bins >> 8)
    counts = np.bincount(flat.reshape(-1), minlength=cells * cells * c * bins).reshape(-1, bins)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """Half the mean absolute difference of histograms: 0 for equal ones, 1 for disjoint ones."""
    return 1.0 if a.shape != b.shape else float(np.abs(a - b).sum(axis=1).mean() / 2)


def shots(differences: list[float], *, sigmas: float = SIGMAS, least: float = LEAST, min_shot: int = MIN_SHOT) -> list[tuple[int, int]]:
    """(first frame, end) of the shots; differences[i] is that of frames i and i + 1.

    The threshold adapts: a cut must stand out of the differences of its shot so far,
    or, while these are fewer than two, of those that follow.  Cuts are found however
    short the shot is, and no cut's difference counts in the statistics; a shot of
    fewer than min_shot frames is then joined with the next.
    """
    out: list[tuple[int, int]] = []
    begin, n, mean, squares = 0, 0, 0.0, 0.0
    for i, d in enumerate(differences):
        if n < 2:
            after = sorted(differences[i + 1 : i + 6])
            usual = after[len(after) // 2] if after else 0.0
            threshold = min(2 * usual, (1 + usual) / 2)
        else:
            threshold = mean + sigmas * (squares / n) ** 0.5
        if d >= max(least, threshold):
            if i + 1 - begin >= min_shot:
                out.append((begin, i + 1))
                begin = i + 1
            n, mean, squares = 0, 0.0, 0.0
            continue
        n += 1
        step = d - mean
        mean += step / n
        squares += step * (d - mean)
    return [*out, (begin, len(differences) + 1)]


class Clip(NamedTuple):
    clip: int
    first_frame: int
    n_frames: int
    begin: float
    end: float
    width: int
    height: int
    #: The difference to the clip before.
    cut: float
    n_broken: int
    error: str | None


def clips(b: bytes | None) -> list[Clip]:
    """The clips of a file.  A frame that can't be decoded counts as like the one before; a file that can't be read gives one row with its error."""
    if b is None:
        return [Clip(0, 0, 0, 0.0, 0.0, 0, 0, 0.0, 0, "no content")]
    try:
        v = parse(b)
    except (BadMedia, struct.error) as e:
        return [Clip(0, 0, 0, 0.0, 0.0, 0, 0, 0.0, 0, str(e))]
    if not v.frames:
        return [Clip(0, 0, 0, 0.0, 0.0, v.width, v.height, 0.0, 0, "no frames")]
    before: np.ndarray | None = None
    differences: list[float] = []
    broken: list[bool] = []
    for o, n in v.frames:
        now = before
        bad = False
        if n:
            try:
                now = histogram(decode(b[o : o + n]))
            except BadMedia:
                bad = True
        if broken:
            differences.append(difference(before, now) if before is not None and now is not None and not bad else 0.0)
        broken.append(bad)
        before = now
    found = shots(differences)
    return [Clip(k, a, z - a, a * v.duration, z * v.duration, v.width, v.height, differences[a - 1] if a else 0.0, sum(broken[a:z]), None) for k, (a, z) in enumerate(found)]


_SCHEMA = "media_id long, clip int, first_frame int, n_frames int, begin double, end double, width int, height int, cut double, n_broken int, error string"


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string())
    names = ["media_id", *Clip._fields]
    for b in batches:
        for i in range(b.num_rows):
            k = b.column("media_id")[i].as_py()
            rows = [(k, *c) for c in clips(b.column("content")[i].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def detect_clips(media: DataFrame) -> DataFrame:
    """A row for each clip of media (media_id, content), content being the bytes of an AVI file of motion JPEG.

    (media_id, clip, first_frame, n_frames, begin, end, width, height, cut, n_broken,
    error): clips are numbered from 0 and cover all frames of a file in order; begin
    and end are seconds.  Frames are found by the RIFF index and decoded whole; a cut
    is where the histogram difference of two frames stands out of those of the clip
    so far.

    A null, empty or broken file, or one of another kind, gives one row with error
    and no frames; frames that can't be decoded are counted in n_broken.  Null ids
    and repeated rows stay; other columns are ignored.  A file is handled whole by
    one task, so its bytes must fit a worker.
    """
    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("content").cast("binary").alias("content")).mapInArrow(_clips, _SCHEMA)


# ---------------------------------------------------------------- encoding, for tables that hold no media


def _codes(counts: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def encode(image: np.ndarray, step: int = 8, *, tables: bool = True, restart: int = 0) -> bytes:
    """A baseline JPEG of an image, grey or of three colours without subsampling, all coefficients quantized by `step`; without tables, as motion JPEG may."""
    image = image.astype(np.float64)
    if image.ndim == 3:
        r, g, b = (image[:, :, i] for i in range(3))
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [image]
    h, w = image.shape[:2]
    coefficients = []
    for p in planes:
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        x = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8)
        f = np.einsum("rycx,uy,vx->rcuv", x, _COS, _COS, optimize=True)
        coefficients.append(np.rint(f / step).astype(np.int64).reshape(-1, 64)[:, _ZIGZAG])
    dc, ac = _codes(*_DC[0]), _codes(*_AC[0])
    out = bytearray()
    acc = bits = 0

    def put(code: int, n: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << n | code, bits + n
        while bits >= 8:
            bits -= 8
            x = acc >> bits & 255
            out.append(x)
            if x == 255:
                out.append(0)
        acc &= (1 << bits) - 1

    def value(v: int, n: int) -> None:
        put(v if v >= 0 else v + (1 << n) - 1, n)

    last = [0] * len(planes)
    for i in range(len(coefficients[0])):
        if restart and i and i % restart == 0:
            if bits:
                put((1 << (8 - bits)) - 1, 8 - bits)
            out += bytes([0xFF, 0xD0 + (i // restart - 1) % 8])
            last = [0] * len(planes)
        for k, c in enumerate(coefficients):
            row = c[i].tolist()
            d = row[0] - last[k]
            last[k] = row[0]
            n = abs(d).bit_length()
            put(*dc[n])
            value(d, n)
            run = 0
            for v in row[1 : max((j for j in range(64) if row[j]), default=0) + 1]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    put(*ac[0xF0])
                    run -= 16
                n = abs(v).bit_length()
                put(*ac[run << 4 | n])
                value(v, n)
                run = 0
            if not row[63]:
                put(*ac[0])
    if bits:
        put((1 << (8 - bits)) - 1, 8 - bits)
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([step] * 64))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(len(planes))))
    if tables:
        head += segment(0xC4, b"\x00" + _DC[0][0] + _DC[0][1] + b"\x10" + _AC[0][0] + _AC[0][1])
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    head += segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    return head + bytes(out) + b"\xff\xd9"


def mux(frames: list[bytes], width: int, height: int, rate: int = 25, *, index: bool = True) -> bytes:
    """An AVI file of one video stream with these frames."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    avih = struct.pack("<14I", 1_000_000 // rate, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, entries = bytearray(b"movi"), bytearray()
    for f in frames:
        entries += struct.pack("<4sIII", b"00dc", 0x10, len(movi), len(f))
        movi += chunk(b"00dc", f)
    body = b"AVI " + hdrl + chunk(b"LIST", bytes(movi)) + (chunk(b"idx1", bytes(entries)) if index else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


#: A task renders about so many turns: their digests are few bytes, so the size of the shuffle doesn't tell the work.
TURNS_A_TASK = 1 << 12
#: Of rendered files: frames a second, pixels a side, and the least frames of a turn, to which up to two come by its length.
RATE, SIDE, FRAMES = 25, 16, MIN_SHOT


def _frame(levels: tuple[int, ...]) -> bytes:
    """An image of four cells, each of one grey level."""
    cells = bytes(levels)
    if cells not in _FRAMES:
        if len(_FRAMES) >= 1 << 14:
            _FRAMES.clear()
        _FRAMES[cells] = encode(np.frombuffer(cells, np.uint8).reshape(2, 2).repeat(SIDE // 2, 0).repeat(SIDE // 2, 1), tables=False)
    return _FRAMES[cells]


def render(turns: list[tuple[int, str]]) -> bytes:
    """An AVI file of a conversation's turns (characters, hexadecimal digest): a turn is a shot of grey cells that its digest draws, dark and bright in turn, which flicker a little."""
    frames = []
    for i, (chars, digest) in enumerate(turns):
        bright = 144 if i % 2 else 32
        cells = [bright + 16 * (int(c, 16) % 5) + 8 for c in digest[:4]]
        for k in range(FRAMES + chars % 3):
            frames.append(_frame(tuple(c + 2 * (k % 3 - 1) for c in cells)))
    return mux(frames, SIDE, SIDE, RATE)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, turns in zip(b.column("media_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([render([(t["chars"], t["digest"]) for t in turns])], pa.binary())], ["media_id", "content"])


def rendered(conversations: DataFrame) -> DataFrame:
    """(media_id, content): a motion-JPEG file of each of conversations (conv_id, turn, role, text), with its turns in order.

    Lengths and digests are gathered by conversation, not texts.  A null text counts
    as an empty one; repeated turns are further shots; rows of a null conv_id are
    one conversation.
    """
    text = F.coalesce("text", F.lit(""))
    one = F.struct("turn", "role", F.char_length(text).alias("chars"), F.md5(text.cast("binary")).alias("digest"))
    tasks = max(1, -(-conversations.count() // TURNS_A_TASK))
    spread = conversations.select(F.col("conv_id").cast("long").alias("media_id"), one.alias("turn")).repartition(tasks, "media_id")
    turns = spread.groupBy("media_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return turns.mapInArrow(_render, "media_id long, content binary")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media, so each conversation is rendered as a file first."""
    return detect_clips(rendered(table(spark, sf_dir, "conversations")))


OP5_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER w - 1 AS clip, {FRAMES} + length(text) % 3 AS n, sum({FRAMES} + length(text) % 3) OVER w AS upto
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id AS media_id, clip::INTEGER AS clip, (upto - n)::INTEGER AS first_frame, n::INTEGER AS n_frames, (upto - n)::DOUBLE * (1::DOUBLE / {RATE}) AS "begin", upto::DOUBLE * (1::DOUBLE / {RATE}) AS "end",
  {SIDE} AS width, {SIDE} AS height, CASE WHEN clip = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS cut, 0 AS n_broken, NULL::VARCHAR AS error
FROM t
"""
