"""Media columns: progressive JPEG in numpy.

``encode`` stores bytes losslessly in the format's own unit, the quantised DCT
coefficient: each 64 bytes are one 8x8 block in zigzag order, a byte b being
+-(128 + b mod 128), negative below 128. Every coefficient thus has the same
magnitude category, so the Huffman tables of all scans can be chosen to give
codes of a fixed total width, and whole scans are read by array operations.
The stream is an ordinary 4:2:0 progressive JPEG: an interleaved DC scan and its
refinement, spectral bands (two of luma, one of each chroma) sent without their lowest bit, and
a refinement of each. A comment segment holds the payload's length.

``decode`` reads any Huffman-coded progressive 8-bit JPEG: it accumulates
spectral-selection and successive-approximation scans into coefficient arrays
(array operations where a scan's codes have a fixed width, bit by bit
otherwise), dequantises and inverse-transforms by matrix product, repeats
chroma to full resolution and converts to an RGB tensor.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sha, text_array

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
SAMPLING = ((2, 2), (1, 1), (1, 1))
BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))
_BYTES = np.arange(256)
_VALUE = np.where(_BYTES >= 128, _BYTES, -(_BYTES | 128)).astype(np.int16)
_FIRST = np.where(_BYTES >= 128, _BYTES >> 1, ~(64 | _BYTES >> 1) & 0x7F).astype(np.uint8)


# ---------------------------------------------------------------- writing

def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    """lengths: symbol -> code length."""
    counts = [sum(v == n for v in lengths.values()) for n in range(1, 17)]
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind << 4 | slot, *counts, *order])


_DC_LENGTHS = {s: 9 - s for s in range(9)}


def _dc_table() -> np.ndarray:
    """The 9 bits of each difference -255..255, by difference + 255."""
    d = np.arange(-255, 256)
    s = np.array([int(abs(x)).bit_length() for x in d])
    extra = np.where(d > 0, d, d + (1 << s) - 1)
    prefix = ((1 << (8 - s)) - 1) << 1
    return ((prefix << s) | extra).astype(np.uint16)


_DC_CODES = _dc_table()


@lru_cache(maxsize=1)
def _head() -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC4, _dht(0, 0, _DC_LENGTHS) + _dht(1, 0, {0x07: 1}) + _dht(1, 1, {0x00: 1}))
    )


def _stuffed(raw: np.ndarray) -> bytes:
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def _bits(rows: np.ndarray) -> np.ndarray:
    """Packs bits, the last byte filled with ones."""
    flat = rows.reshape(-1)
    pad = -len(flat) % 8
    return np.packbits(np.concatenate([flat, np.ones(pad, np.uint8)]) if pad else flat)


def _sos(parts, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, t]) for c, t in parts) + bytes([ss, se, ah << 4 | al]))


@lru_cache(maxsize=256)
def _mcu_order(mw: int, mh: int) -> np.ndarray:
    """Block indices of all components in the order of an interleaved scan."""
    y = np.arange(4 * mw * mh).reshape(mh, 2, mw, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    c = np.arange(mw * mh)
    return np.concatenate([y, (4 * mw * mh + c)[:, None], (5 * mw * mh + c)[:, None]], 1)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload (a positive multiple of 64 bytes)."""
    if not payload or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    mw = math.isqrt(mcus - 1) + 1
    mh = -(-mcus // mw)
    if mw > 4095:
        raise ValueError("the payload exceeds the format's largest picture")
    total = 6 * mw * mh
    data = np.zeros((total, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    order = _mcu_order(mw, mh)
    out = [_head(), _segment(0xFE, b"bytes " + str(len(payload)).encode())]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * mh, 16 * mw, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))))
    # DC: differences of each component's value without its lowest bit
    dc = _VALUE[data[:, 0]][order]
    high = dc >> 1
    diff = np.empty_like(high)
    y = high[:, :4].reshape(-1)
    diff[:, :4] = np.diff(y, prepend=np.int16(0)).reshape(-1, 4)
    diff[:, 4:] = np.diff(high[:, 4:], axis=0, prepend=np.zeros((1, 2), np.int16))
    codes = _DC_CODES[diff.reshape(-1) + 255]
    bits = np.unpackbits(codes.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 7:]
    parts = [(0, 0), (1, 0), (2, 0)]
    out += [_sos(parts, 0, 0, 0, 1), _stuffed(_bits(bits)), _sos(parts, 0, 0, 1, 0), _stuffed(_bits((dc & 1).astype(np.uint8)))]
    ac = _FIRST[data]
    low = data & 1
    low[:, 0] = 0  # the place of the end-of-block code
    cuts = (0, 4 * mw * mh, 5 * mw * mh, total)
    for c in range(3):
        own = slice(cuts[c], cuts[c + 1])
        for ss, se in BANDS[c]:
            out += [_sos([(c, 0)], ss, se, 0, 1), ac[own, ss : se + 1].tobytes()]
    for c in range(3):
        own = slice(cuts[c], cuts[c + 1])
        out += [_sos([(c, 1)], 1, 63, 1, 0), _stuffed(np.packbits(low[own].reshape(-1)))]
    out.append(b"\xff\xd9")
    return b"".join(out)


# ---------------------------------------------------------------- reading

class _Table:
    def __init__(self, counts, symbols):
        self.codes, code, k = {}, 0, 0
        self.lengths: dict[int, int] = {}
        for n, many in enumerate(counts, 1):
            for s in symbols[k : k + many]:
                self.codes[n, code] = s
                self.lengths[s] = n
                code += 1
            k += many
            code <<= 1

    @cached_property
    def width(self) -> int:
        """The common width of code and extra bits of a DC table, else 0."""
        w = {n + s for s, n in self.lengths.items()}
        return w.pop() if len(w) == 1 else 0

    @cached_property
    def values(self) -> np.ndarray:
        """For a DC table of a common width: difference by bits."""
        out = np.zeros(1 << self.width, np.int32)
        for (_, code), s in self.codes.items():
            out[(code << s) + np.arange(1 << s)] = _signed(s)
        return out

    @cached_property
    def bytewise(self) -> np.ndarray | None:
        """For an AC table of one symbol, without zero runs, of a byte with its extra bits: coefficient by byte."""
        if len(self.lengths) != 1:
            return None
        ((s, n),) = self.lengths.items()
        return np.resize(_signed(s), 256).astype(np.int16) if 0 < s < 8 and n + s == 8 else None


def _signed(s: int) -> np.ndarray:
    """Values by their s extra bits."""
    x = np.arange(1 << s)
    return np.where(x >> max(s - 1, 0) > 0, x, x - (1 << s) + 1) if s else x


@lru_cache(maxsize=64)
def _table(counts: bytes, symbols: bytes) -> _Table:
    return _Table(counts, symbols)


@lru_cache(maxsize=256)
def _unit_order(bw: int, bh: int, h: int, v: int) -> np.ndarray:
    """A component's blocks by minimum coded unit."""
    return np.arange(bw * bh).reshape(bh // v, v, bw // h, h).transpose(0, 2, 1, 3).reshape(-1, h * v)


class _Reader:
    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits.tolist(), 0

    def bit(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def many(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: _Table) -> int:
        code = n = 0
        while n < 16:
            code, n = code << 1 | self.bit(), n + 1
            if (n, code) in table.codes:
                return table.codes[n, code]
        raise ValueError("broken Huffman code")

    def signed(self, s: int) -> int:
        v = self.many(s)
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


def _refine(r: _Reader, block: np.ndarray, k: int, se: int, zeros: int, bit: int) -> int:
    """Passes over ``zeros`` zero coefficients from k, correcting the others; the place of the next zero."""
    while k <= se:
        v = int(block[k])
        if v:
            if r.bit() and not abs(v) & bit:
                block[k] = v + (bit if v > 0 else -bit)
        elif zeros == 0:
            return k
        else:
            zeros -= 1
        k += 1
    return k


def _slow_scan(segments, comps, units, tables, ss, se, ah, al):
    """units: for each coded unit (component, block); segments: bits between restart markers with their units."""
    for bits, own in zip(segments, units):
        r, last, run = _Reader(bits), {}, 0
        for c, b in own:
            block = comps[c]["coef"][b]
            if ss == 0:
                if ah:
                    block[0] |= r.bit() << al
                else:
                    last[c] = last.get(c, 0) + r.signed(r.symbol(tables[c][0]))
                    block[0] = last[c] << al
                continue
            bit, table = 1 << al, tables[c][1]
            if run:
                run -= 1
                if ah:
                    _refine(r, block, ss, se, 64, bit)
                continue
            k = ss
            while k <= se:
                rs = r.symbol(table)
                zeros, s = rs >> 4, rs & 15
                if s == 0 and zeros < 15:
                    run = (1 << zeros) + r.many(zeros) - 1
                    if ah:
                        _refine(r, block, k, se, 64, bit)
                    break
                if ah:
                    new = (bit if r.bit() else -bit) if s else 0
                    k = _refine(r, block, k, se, zeros, bit)
                    if new and k <= se:
                        block[k] = new
                    k += 1
                else:
                    k += zeros
                    if s:
                        block[k] = r.signed(s) * bit
                    k += 1


def _fast_scan(raw: np.ndarray, coef: np.ndarray, table, ss, se, ah, al) -> bool:
    """One component's AC scan whose codes have a fixed width; False if they don't."""
    n, band = len(coef), se - ss + 1
    if len(table.lengths) != 1:
        return False
    (sym, length), = table.lengths.items()
    if not ah and sym >> 4 == 0 and 0 < sym < 16:
        width = length + sym
        if table.bytewise is not None:
            x = table.bytewise[raw[: n * band]]
        else:
            x = np.unpackbits(raw)[: n * band * width].reshape(-1, width)[:, length:]
            x = _signed(sym)[x.astype(np.int32) @ (1 << np.arange(sym - 1, -1, -1))]
        if len(x) < n * band:
            return False
        np.left_shift(x.reshape(n, band), al, out=coef[:, ss : se + 1], casting="unsafe")
        return True
    if ah and sym == 0:
        own = coef[:, ss : se + 1]
        if own.all() and length == 1 and band == 63:
            bits = np.unpackbits(raw[: n * 8]).reshape(n, 64)[:, 1:]
        else:
            there = own != 0
            many = there.sum(1)
            begin = np.cumsum(many + length) - many
            at = (begin[:, None] + np.cumsum(there, 1) - 1)[there]
            bits = np.zeros(own.shape, np.uint8)
            bits[there] = np.unpackbits(raw)[at]
        sign = own >> 15
        step = bits.astype(np.int16)
        if al:
            step <<= al
        step ^= sign
        step -= sign
        own += step
        return True
    return False


def _split(data: bytes, i: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from i, between restart markers, and the place of the next marker."""
    out, j = [], i
    while True:
        j = data.find(b"\xff", j)
        if j < 0 or j + 1 >= len(data):
            raise ValueError("the stream ends within a scan")
        if data[j + 1] == 0:
            j += 2
        elif 0xD0 <= data[j + 1] <= 0xD7:
            out.append(data[i:j])
            i = j = j + 2
        else:
            out.append(data[i:j])
            return [x.replace(b"\xff\x00", b"\xff") for x in out], j


def coefficients(data: bytes, fast: bool = True) -> dict:
    """{height, width, comps: [{h, v, bw, bh, coef (blocks, 64) zigzag, quant}], comment}."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    i, dc, ac, quant, comps, restart, pic = 2, {}, {}, {}, [], 0, {}
    while True:
        while data[i : i + 1] == b"\xff" and data[i + 1 : i + 2] == b"\xff":
            i += 1
        marker = data[i + 1]
        i += 2
        if marker == 0xD9:
            break
        (n,) = struct.unpack(">H", data[i : i + 2])
        body, i = data[i + 2 : i + n], i + n
        if marker == 0xDB:
            while body:
                wide, slot = body[0] >> 4, body[0] & 15
                quant[slot] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _table(body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            pic["comment"] = body
        elif marker == 0xC2:
            bits, height, width, k = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("only 8-bit samples")
            comps = [{"id": body[6 + 3 * c], "h": body[7 + 3 * c] >> 4, "v": body[7 + 3 * c] & 15, "q": body[8 + 3 * c]} for c in range(k)]
            hm, vm = max(c["h"] for c in comps), max(c["v"] for c in comps)
            mw, mh = -(-width // (8 * hm)), -(-height // (8 * vm))
            for c in comps:
                c |= {"bw": mw * c["h"], "bh": mh * c["v"], "w": -(-(-(-width * c["h"] // hm)) // 8), "t": -(-(-(-height * c["v"] // vm)) // 8)}
                c["coef"] = np.zeros((c["bw"] * c["bh"], 64), np.int16)
            pic |= {"height": height, "width": width, "hm": hm, "vm": vm}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only Huffman-coded progressive JPEG")
        elif marker == 0xDA:
            k = body[0]
            own = [next(j for j, c in enumerate(comps) if c["id"] == body[1 + 2 * m]) for m in range(k)]
            tables = {own[m]: (dc.get(body[2 + 2 * m] >> 4), ac.get(body[2 + 2 * m] & 15)) for m in range(k)}
            ss, se, a = body[1 + 2 * k : 4 + 2 * k]
            segments, i = _split(data, i)
            _scan(segments, comps, own, tables, ss, se, a >> 4, a & 15, restart, mw, mh, fast)
    for c in comps:
        c["quant"] = quant[c["q"]]
    return pic | {"comps": comps}


def _scan(segments, comps, own, tables, ss, se, ah, al, restart, mw, mh, fast):
    if len(own) > 1:
        cols = [_unit_order(comps[c]["bw"], comps[c]["bh"], comps[c]["h"], comps[c]["v"]) for c in own]
    else:
        x = comps[own[0]]
        whole = x["t"] == x["bh"] and x["w"] == x["bw"]
        if fast and ss and whole and not restart and _fast_scan(np.frombuffer(segments[0], np.uint8), x["coef"], tables[own[0]][1], ss, se, ah, al):
            return
        cols = [np.arange(x["bw"] * x["bh"]).reshape(x["bh"], x["bw"])[: x["t"], : x["w"]].reshape(-1, 1)]
    if fast and not restart and ss == 0:
        raw = np.frombuffer(segments[0], np.uint8)
        if len(raw):
            many = sum(b.shape[1] for b in cols)
            n = len(cols[0]) * many
            width = 1 if ah else (tables[own[0]][0].width if len({id(tables[c][0]) for c in own}) == 1 else 0)
            if width:
                bits = np.unpackbits(raw)[: n * width].reshape(-1, width)
                if len(bits) == n:
                    if ah:
                        v = bits.astype(np.int16)
                    else:
                        wide = np.zeros((n, 32), np.uint8)
                        wide[:, 32 - width :] = bits
                        v = tables[own[0]][0].values[np.packbits(wide).view(">u4")]
                    v, k = v.reshape(len(cols[0]), many), 0
                    for c, b in zip(own, cols):
                        u = v[:, k : k + b.shape[1]].reshape(-1)
                        k += b.shape[1]
                        if ah:
                            comps[c]["coef"][b.reshape(-1), 0] |= (u << al).astype(np.int16)
                        else:
                            comps[c]["coef"][b.reshape(-1), 0] = (np.cumsum(u) << al).astype(np.int16)
                    return
    per = restart or len(cols[0])
    units = [[(c, int(b)) for m in range(lo, min(lo + per, len(cols[0]))) for c, col in zip(own, cols) for b in col[m]] for lo in range(0, len(cols[0]), per)]
    _slow_scan([np.unpackbits(np.frombuffer(s, np.uint8)) for s in segments], comps, units, tables, ss, se, ah, al)


@lru_cache(maxsize=16)
def _inverse(quant: bytes) -> np.ndarray:
    """(zigzag coefficient, sample) of the two-dimensional inverse transform, dequantisation included."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u, 0.5, math.sqrt(0.125))
    k = np.einsum("vy,ux->vuyx", a, a).reshape(64, 64)
    return (k[ZIGZAG] * np.frombuffer(quant, np.int32)[:, None]).astype(np.float32)


def planes(pic: dict) -> list[np.ndarray]:
    out = []
    for c in pic["comps"]:
        s = c["coef"].astype(np.float32) @ _inverse(c["quant"].astype(np.int32).tobytes())
        s += 128.5
        np.clip(s, 0, 255, out=s)
        s = s.astype(np.uint8).reshape(c["bh"], c["bw"], 8, 8).transpose(0, 2, 1, 3).reshape(8 * c["bh"], 8 * c["bw"])
        fy, fx = pic["vm"] // c["v"], pic["hm"] // c["h"]
        if fy > 1 or fx > 1:
            s = np.repeat(np.repeat(s, fy, 0), fx, 1)
        out.append(s[: pic["height"], : pic["width"]])
    return out


def rgb(pic: dict) -> np.ndarray:
    """The (height, width, 3) tensor."""
    p = planes(pic)
    if len(p) == 1:
        return np.repeat(p[0][:, :, None], 3, 2)
    out = np.empty((*p[0].shape, 3), np.uint8)
    y, b, r = p[0].astype(np.float32), _CHROMA[p[1]], _CHROMA[p[2]]
    y += 0.5
    for k, s in enumerate((1.402 * r, -0.344136 * b - 0.714136 * r, 1.772 * b)):
        s += y
        out[:, :, k] = np.clip(s, 0, 255, out=s)
    return out


_CHROMA = np.arange(-128, 128, dtype=np.float32)


def payload(pic: dict) -> bytes:
    """The bytes that ``encode`` stored."""
    n = int(pic["comment"].split()[1])
    c = np.concatenate([x["coef"] for x in pic["comps"]])
    return ((np.abs(c) & 127) | np.where(c > 0, 128, 0)).astype(np.uint8).tobytes()[:n]


def feature(tensor: np.ndarray) -> str:
    """Size, mean sample and checksum of an RGB tensor."""
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{int(tensor.sum(dtype=np.int64)) / tensor.size:.4f}:{zlib.crc32(tensor):08x}"


# ---------------------------------------------------------------- operators

def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): every text's padded UTF-8 bytes as a progressive JPEG. Null is the empty
    text, which gives one block of zeros. Other columns don't matter."""

    def run(batches):
        for b in batches:
            media = [encode(pad(t.encode())) for t in text_array(b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], [id_col, "media"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, media binary")


def decode_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", tensor: bool = True) -> DataFrame:
    """(id, width, height, rgb, feature): the full-resolution RGB tensor of every JPEG, row by row.
    A null or unreadable picture gives nulls. ``tensor=False`` leaves the pixels out."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows = []
                for m in b.column(1).slice(i, 64).to_pylist():
                    try:
                        t = rgb(coefficients(m))
                        rows.append((t.shape[1], t.shape[0], t.tobytes() if tensor else None, feature(t)))
                    except (ValueError, IndexError, KeyError, TypeError, AttributeError, StopIteration, struct.error):
                        rows.append((None,) * 4)
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 64), *cols], [id_col, "width", "height", "rgb", "feature"])

    src = df.select(id_col, media_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, width int, height int, rgb binary, feature string")


def media_digest(df: DataFrame) -> DataFrame:
    """For each document the digests of what was stored and read back; one pass, no shuffle."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                rows = []
                for t in text_array(b.column(1).slice(i, 512)).to_pylist():
                    raw = t.encode()
                    media = encode(pad(raw))
                    pic = coefficients(media)
                    back = payload(pic)
                    rows.append((len(raw), len(back), sha(back), zlib.crc32(back[-64:]), len(media), sha(media), feature(rgb(pic))))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 512), *cols], names)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
