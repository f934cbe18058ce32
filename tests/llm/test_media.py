"""AVI files made here: what is decoded, and where shots are cut."""

import duckdb
import numpy as np
import pytest

from fathom.llm import media as M


def noise(rng, level, n, shape=(24, 32)):
    base = np.clip(level + 30 * np.add.outer(np.sin(np.arange(shape[0]) / 4), np.cos(np.arange(shape[1]) / 5)), 0, 255)
    return [np.clip(base + rng.normal(0, 3, shape), 0, 255).astype(np.uint8) for _ in range(n)]


@pytest.mark.parametrize("shape", [(8, 8), (17, 23), (40, 33), (16, 24, 3), (9, 31, 3)])
@pytest.mark.parametrize("kw", [{}, {"tables": False}, {"restart": 2}])
def test_decoding_undoes_encoding(shape, kw):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, shape).astype(np.uint8)
    back = M.decode(M.encode(image, 1, **kw))
    assert back.shape == image.shape
    assert np.abs(back.astype(int) - image).max() <= 3


def test_subsampled_colour():
    """Four luminance blocks to one of each colour, coded by hand: all of one colour."""
    image = np.full((16, 16, 3), (200, 60, 90), np.uint8)
    b = M.encode(image[:8, :8], 1)
    sof = b.index(b"\xff\xc0")
    flat = bytearray(b)
    flat[sof + 5 : sof + 9] = bytes([0, 16, 0, 16])
    flat[sof + 11] = 0x22
    sos = b.index(b"\xff\xda")
    # The luminance block four times: its value, then three times no difference.
    y = round((0.299 * 200 + 0.587 * 60 + 0.114 * 90 - 128) * 8)
    cb = round((-0.168736 * 200 - 0.331264 * 60 + 0.5 * 90) * 8)
    cr = round((0.5 * 200 - 0.418688 * 60 - 0.081312 * 90) * 8)
    dc, ac = M._codes(*M._DC[0]), M._codes(*M._AC[0])
    code = lambda c: format(c[0], f"0{c[1]}b")
    bits = ""
    for v in (y, 0, 0, 0, cb, cr):
        n = abs(v).bit_length()
        bits += code(dc[n]) + (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "") + code(ac[0])
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    got = M.decode(bytes(flat[: sos + 14]) + data + b"\xff\xd9")
    assert got.shape == (16, 16, 3) and np.abs(got.astype(int) - image).max() <= 2


@pytest.mark.parametrize("index", [True, False])
def test_frames_by_index_or_by_walking(index):
    rng = np.random.default_rng(0)
    images = noise(rng, 100, 7)
    b = M.mux([M.encode(i) for i in images], 32, 24, 10, index=index)
    v = M.parse(b)
    assert (v.duration, v.width, v.height, len(v.frames)) == (0.1, 32, 24, 7)
    for (o, n), image in zip(v.frames, images, strict=True):
        assert np.abs(M.decode(b[o : o + n]).astype(int) - image).max() < 30


def test_shots_are_cut_where_scenes_change():
    rng = np.random.default_rng(1)
    scenes = [(40, 9), (200, 12), (120, 5), (30, 20)]
    frames = [M.encode(f) for level, n in scenes for f in noise(rng, level, n)]
    got = M.clips(M.mux(frames, 32, 24, 25))
    assert [c.n_frames for c in got] == [n for _, n in scenes]
    assert [c.first_frame for c in got] == [0, 9, 21, 26]
    assert got[1].begin == pytest.approx(9 / 25) and got[-1].end == pytest.approx(46 / 25)


def test_threshold_adapts():
    """What would be a cut in a calm shot is none in a restless one."""
    assert M.shots([0.01] * 10 + [0.4] + [0.01] * 10) == [(0, 11), (11, 22)]
    assert M.shots([0.15, 0.05] * 6 + [0.4] + [0.1] * 4)[0] == (0, 13)
    restless = [0.19, 0.02, 0.18, 0.01] * 4
    assert M.shots([*restless, 0.4, 0.1, 0.1]) == [(0, len(restless) + 4)]
    assert M.shots([]) == [(0, 1)]
    assert M.shots([1.0, 1.0, 1.0, 1.0, 1.0]) == [(0, 3), (3, 6)]


@pytest.mark.parametrize("short", [1, 2])
@pytest.mark.parametrize("cut", [1.0, 0.5])
def test_short_shots_hide_no_later_cut(short, cut):
    """A scene, one of a frame or two, which is joined with the next, and two more scenes."""
    calm = [0.01] * 4
    got = M.shots([*calm, 1.0, *[0.01] * (short - 1), 1.0, *calm, cut, *calm])
    assert got == [(0, 5), (5, 10 + short), (10 + short, 15 + short)]
    # Several short ones in a row.
    assert M.shots([*calm, 1.0, 1.0, 1.0, *calm, cut, *calm])[-1] == (12, 17)
    # The first of a file.
    assert M.shots([*[0.01] * (short - 1), 1.0, *calm, cut, *calm])[-1] == (short + 5, short + 10)


def test_restless_from_the_start_is_no_cut():
    assert M.shots([0.25, 0.3, 0.28, 0.27, 0.26, 0.29, 0.25]) == [(0, 8)]


def test_query_equals_sql(spark, sf):
    df = M.op5_media(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cur = con.execute(M.OP5_SQL)
    names = [d[0] for d in cur.description]
    assert names == df.columns
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.collect())


def test_edges(spark):
    rng = np.random.default_rng(2)
    good = M.mux([M.encode(f) for f in noise(rng, 90, 6)], 32, 24)
    frames = [M.encode(f) for f in noise(rng, 90, 6)]
    frames[3] = b"\xff\xd8broken"
    frames[4] = b""
    rows = [(1, good), (1, good), (None, good), (2, None), (3, b""), (4, b"RIFF\x04\0\0\0AVI "), (5, good[: len(good) // 2]), (6, M.mux(frames, 32, 24)), (7, M.mux([], 32, 24)), (8, b"x" * 100_000)]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None, "c") for k, b in rows], "media_id long, content binary, clip string")
    out = M.detect_clips(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.media_id, []).append(r)
    assert len(by[1]) == 2 and [r.n_frames for r in by[1]] == [6, 6] and len(by[None]) == 1
    for k in (2, 3, 4, 7, 8):
        assert len(by[k]) == 1 and by[k][0].error and by[k][0].n_frames == 0
    assert by[5][0].error or sum(r.n_frames for r in by[5]) <= 6
    assert [(r.n_frames, r.n_broken, r.error) for r in by[6]] == [(6, 1, None)]
    assert M.detect_clips(df.limit(0)).count() == 0


def test_rendering_handles_nulls(spark):
    rows = [(1, 0, "user", "hello"), (1, 0, "user", "hello"), (1, None, None, None), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = M.detect_clips(M.rendered(df)).collect()
    assert sorted((r.media_id is None, r.clip) for r in got) == [(False, 0), (False, 1), (False, 2), (True, 0)]
