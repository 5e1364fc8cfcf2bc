"""Secret scans: one Aho-Corasick pass for keywords, regular expressions anchored at the
hits alone, then checks of what the secrets embed.

Kinds ``assign``, ``access`` and ``hex`` are leftmost and non-overlapping, each for itself:
a match that fails its length still consumes its text. Hexadecimal runs have no keyword;
a byte table and a substring search find the texts that hold one. The other kinds are kept
only if what they embed checks out: the CRC-32 in base 62 of ``github`` and ``npm`` tokens,
the JSON header of a ``jwt``, the end line and the embedded length of a ``pem`` block, which is
one span from its first line to its last.

Work is in proportion to the text, however often a keyword occurs: a run of letters that begins no
``jwt`` is left as a whole, as all later beginnings in it fail alike, and a block ends at the next dashes.

Null is the empty text; empty tables give no rows; further columns are left alone. Ties can't occur within a
kind; equal texts give equal spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, sha, span_columns

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[opsru]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_RUN = re.compile(r"[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]++|-(?!----))*+)-----END ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_LOWER = {i: i + 32 for i in range(65, 91)}


def crc_base62(body: str) -> str:
    """The six-digit base-62 CRC-32 that tokens of this form end with."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(6, "0")


def _header(m: re.Match) -> bool:
    part = m[1]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError):
        return False


def _block(m: re.Match) -> bool:
    """Whether the lines between are base64 of one object of the length that it states, of an OpenSSH key, or,
    where header lines say so, of whole encrypted blocks."""
    if m[1] != m[3]:
        return False
    lines = m[2].strip().splitlines()
    head = [x for x in lines if ":" in x]
    try:
        raw = base64.b64decode("".join("".join(x.split()) for x in lines if ":" not in x), validate=True)
    except ValueError:
        return False
    if any("ENCRYPTED" in x for x in head):
        return len(raw) > 0 and len(raw) % 8 == 0
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    more = raw[1] & 0x7F if raw[1] & 0x80 else 0  # bytes of a long length
    return len(raw) == 2 + more + (int.from_bytes(raw[2 : 2 + more], "big") if more else raw[1])


_RULES = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), (0, _ASSIGN, lambda m: len(m[2]) >= 8)),
    "akia": (1, _ACCESS, lambda m: len(m[0]) >= 16),
    **dict.fromkeys(("gho_", "ghp_", "ghs_", "ghr_", "ghu_"), (3, _GITHUB, lambda m: crc_base62(m[1]) == m[2])),
    "npm_": (4, _NPM, lambda m: crc_base62(m[1]) == m[2]),
    "eyj": (5, _JWT, _header),
    "-----begin": (6, _PEM, _block),
}


@lru_cache(maxsize=1)
def _automaton():
    a = ahocorasick.Automaton()
    for word, rule in _RULES.items():
        a.add_word(word, (len(word), *rule))
    a.make_automaton()
    return a


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every secret, by start."""
    low = text.lower()
    if len(low) != len(text):  # some letters lower to several code points
        low = text.translate(_LOWER)
    hits = sorted(((end - v[0] + 1, *v[1:]) for end, v in _automaton().iter(low)), key=lambda h: h[:2]) if low else []
    out, ends = [], [0] * len(KINDS)
    for start, kind, rule, good in hits:
        if start < ends[kind]:
            continue
        if m := rule.match(text, start):
            ends[kind] = m.end()
            if good(m):
                out.append((start, kind, m.end()))
        elif kind == 5:
            ends[kind] = _RUN.match(text, start).end() if text[start] == "e" else start + 1
    if b"x" * 32 in text.encode().translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per secret: (id, kind, start, end, value). Rows without secrets give none."""

    def run(batches):
        for b, texts, _, _ in chunks(batches, text_col):
            at, rows = [], []
            for i, t in enumerate(texts.to_pylist()):
                for s, k, e in secrets(t):
                    at.append(i)
                    rows.append((KINDS[k], s, e, t[s:e]))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], [id_col, "kind", "start", "end", "value"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, kind string, start long, end long, value string")


def secret_digest(df: DataFrame) -> DataFrame:
    """For each document the counts and digests of its secrets; one pass, no shuffle."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches):
        for b, texts, _, _ in chunks(batches):
            rows = []
            for t in texts.to_pylist():
                found = secrets(t)
                base = [(s, k, e) for s, k, e in found if k < 3]
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, sha(span_columns(base, KINDS).encode()), span_columns(found, KINDS)))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, (pa.int64(),) * 3 + (pa.string(),) * 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
