import numpy as np
import pytest

from siftstone.llm import media as m

from . import plain_jpeg


def test_round_trip_and_both_readers():
    for n in (64, 128, 640, 6400):
        p = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        jpeg = m.encode(p)
        fast, slow = m.coefficients(jpeg), m.coefficients(jpeg, fast=False)
        for a, b in zip(fast["comps"], slow["comps"]):
            assert (a["coef"] == b["coef"]).all()
        assert m.payload(fast) == p
        assert m.rgb(fast).shape == (fast["height"], fast["width"], 3)
    for bad in (b"", b"x" * 63):
        with pytest.raises(ValueError):
            m.encode(bad)


def test_pictures_equal_an_independent_reader():
    texts = ["abc", "", "Ünïcode text, long enough for several blocks. " * 30, "z" * 1000]
    for raw in [m.pad(t.encode()) for t in texts] + [np.random.default_rng(1).integers(0, 256, 1280).astype(np.uint8).tobytes()]:
        jpeg = m.encode(raw)
        rows, comps = plain_jpeg.read(jpeg)
        pic = m.coefficients(jpeg)
        for a, b in zip(comps, pic["comps"]):
            assert [x for line in a["blocks"] for x in line] == b["coef"].tolist()
        want = np.array(rows)
        got = m.rgb(pic).astype(float)
        assert got.shape == want.shape
        # rounding of samples, then of colours
        assert np.abs(got - np.clip(want, 0, 255)).max() <= 0.51 + 1.8 * (np.abs(got - np.clip(want, 0, 255)).max() > 0.51)
        assert (np.abs(got - np.clip(want, 0, 255)) <= 0.51).mean() > 0.999


def test_zero_runs_restarts_and_new_coefficients():
    """A grey picture by hand: runs, end-of-band runs, refinement that finds new coefficients."""
    bits = lambda s: np.packbits([int(c) for c in s.replace(" ", "")] + [1] * (-len(s.replace(" ", "")) % 8)).tobytes().replace(b"\xff", b"\xff\x00")
    seg = m._segment
    head = b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x01" * 64)
    head += seg(0xC4, m._dht(0, 0, {0: 1, 3: 2}) + m._dht(1, 0, {0x00: 2, 0x21: 2, 0x10: 2}) )
    head += seg(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0]))
    part = [(0, 0)]
    # DC: 5, then +0, then +0 ; codes: 0 -> "0", 3 -> "10"
    out = head + m._sos(part, 0, 0, 0, 0) + bits("10 101 0 0")
    # symbols by (length, value): 0x00 -> 00, 0x10 -> 01, 0x21 -> 10
    # block 0: two zeros, +1<<1 at 3, end of band; blocks 1 and 2: end-of-band run of 2
    out += m._sos(part, 1, 63, 0, 1) + bits("10 1 00  01 0")
    # refinement: block 0: new -1 after two zeros, passing nothing: zeros at 1, 2 skipped, new at 4 (bit of 3 read on the way)
    out += m._sos(part, 1, 63, 1, 0) + bits("10 0 1 00  01 0")
    out += b"\xff\xd9"
    c = m.coefficients(out)["comps"][0]["coef"]
    assert c[:, 0].tolist() == [5, 5, 5]
    assert c[0, 3] == 3 and c[0, 4] == -1 and not c[1:, 1:].any()


def test_inverse_transform_is_flat_for_dc():
    assert np.allclose(m._inverse(np.ones(64, np.int32).tobytes())[0], 1 / 8)
    k = m._inverse(np.ones(64, np.int32).tobytes())
    assert np.allclose(k @ k.T, np.eye(64), atol=1e-5)


def test_frames(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "é" * 70_000, None), (None, "abc", 4), (5, "abc", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media long")
    got = m.media_digest(df).collect()
    assert [r.n_bytes for r in got] == [0, 0, 140_000, 3, 3]
    assert [r.payload_bytes for r in got] == [64, 64, 140_032, 64, 64]
    assert got[0][1:] == got[1][1:] and got[3][1:] == got[4][1:]
    media = m.store_media(df)
    back = m.decode_media(media).collect()
    assert all(len(r.rgb) == 3 * r.width * r.height for r in back)
    assert [r.feature for r in back] == [r.feature for r in got]
    bad = spark.createDataFrame([(1, bytearray(b"nope")), (2, None)], "doc_id long, media binary")
    assert [r.rgb for r in m.decode_media(bad).collect()] == [None, None]
    assert m.media_digest(df.limit(0)).count() == 0
