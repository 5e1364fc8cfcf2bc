"""Language identification by hyperdimensional profiles.

Each letter has a random vector of -1 and 1, drawn from a hash of its code point; an n-gram is
the product of its letters' vectors, each rotated by its place; a text is the sum of its n-grams
(letters in lower case, other runs as one blank). A language's prototype is the sum of its
training texts at equal length. A text gets the language of the largest cosine, ties by name.

Texts of a slice are summed by one matrix product of n-gram counts and n-gram vectors. Training
is one pass that leaves each partition's sums per language and dimension, in integers, so the
result doesn't depend on their order; what reaches the driver is languages x dimensions.

Null text, and text without a letter, is ``und`` with score 0. If nothing can be learned, all is. Texts are seen whole; repeated rows
count as often as they occur and get the same language; an empty table gives no rows and further columns of any name
are left alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, mix

DIM, N, SCALE = 1024, 3, 1 << 24
_BLOCK = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


@lru_cache(maxsize=100_000)
def _rotations(letter: int) -> np.ndarray:
    """The letter's vector as DIM packed bits, rotated by 0 .. N - 1 places."""
    bits = np.unpackbits(mix(np.arange(DIM // 64, dtype=U64) + U64(letter * 1_000_003 + 7)).view(np.uint8))
    return np.stack([np.packbits(np.roll(bits, k)) for k in range(N)])


def _vectors(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), DIM // 8), np.uint8)
    for k in range(N):
        own, at = np.unique(codes >> 21 * k & 0x1FFFFF, return_inverse=True)
        out ^= np.stack([_rotations(int(c))[k] for c in own])[at]
    return 1.0 - 2.0 * np.unpackbits(out, axis=1).astype(np.float32)


def text_vectors(texts: list[str]) -> np.ndarray:
    """(texts, DIM): the bundled n-grams; zero for texts without letters."""
    out = np.zeros((len(texts), DIM), np.float32)
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    sym = _letters()[points]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 32) | (sym[:-1] != 32)
    keep[off[:-1]] = True
    doc = np.repeat(np.arange(len(texts)), np.diff(off))[keep]
    sym = sym[keep].astype(np.int64)
    begin = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    # a text is seen between blanks
    places = np.flatnonzero(begin & (sym != 32))
    sym, doc = np.insert(sym, places, 32), np.insert(doc, places, doc[places])
    if len(sym) < N:
        return out
    code = sum(sym[N - 1 - k : len(sym) - k] << 21 * k for k in range(N))
    own = doc[N - 1 :] == doc[: len(doc) - N + 1]
    code, doc = code[own], doc[N - 1 :][own]
    codes, at = np.unique(code, return_inverse=True)
    pair, count = np.unique(at * len(texts) + doc, return_counts=True)
    which, doc = np.divmod(pair, len(texts))
    for lo in range(0, len(codes), _BLOCK):
        i, j = np.searchsorted(which, (lo, lo + _BLOCK))
        c = np.zeros((len(texts), min(_BLOCK, len(codes) - lo)), np.float32)
        c[doc[i:j], which[i:j] - lo] = count[i:j]
        out += c @ _vectors(codes[lo : lo + _BLOCK])
    return out


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))[:, None]
    return v / np.where(n > 0, n, 1)


def prototypes(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of every language of the rows, learned from all of them."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b, texts, _, _ in chunks(batches):
            v = np.rint(unit(text_vectors(texts.to_pylist())) * SCALE).astype(np.int64)
            langs = np.array(b.column(1).to_pylist(), object)
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + v[langs == lang].sum(0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "dim", "value"])

    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = rows.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r.lang, np.zeros(DIM))[r.dim] = r.value
    return {k: unit(v[None])[0] for k, v in sorted(found.items()) if v.any()}


def identify(df: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score for every row."""
    names = list(profiles)
    table = np.stack([profiles[k] for k in names]).astype(np.float32) if names else np.zeros((0, DIM), np.float32)

    def run(batches):
        for b, texts, _, _ in chunks(batches, "__text"):
            v = unit(text_vectors(texts.to_pylist()))
            seen = v.any(1)
            if names:
                cos = v @ table.T
                best = cos.argmax(1)
                score = np.clip(cos.max(1), 0, 1)
                pred = [names[k] if s else "und" for k, s in zip(best.tolist(), seen.tolist())]
            else:
                score, pred = np.zeros(len(seen)), ["und"] * len(seen)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(np.where(seen, score, 0).astype(np.float64))], [*keep, "lang_pred", "score"]
            )

    src = df.select(*keep, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kept}, lang_pred string, score double")


def held_out(df: DataFrame, remainder: int, modulus: int, id_col: str = "doc_id"):
    return F.crc32(F.coalesce(df[id_col].cast("string"), F.lit(""))) % modulus == remainder


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents; learned from those not held out."""
    marked = docs.select("doc_id", "text", "lang", held_out(docs, 2, 4).alias("held_out"))
    return identify(marked, prototypes(marked.where("not held_out")), ["doc_id", "held_out"])
