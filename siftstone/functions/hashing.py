"""SipHash-1-3 over many keys at once, SimHash and MinHash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
_M = (1 << 64) - 1


#: so many hashes are worked on at a time, in place
_CHUNK = 1 << 15


def _rotl(x, b, t):
    np.right_shift(x, _U(64 - b), out=t)
    np.left_shift(x, _U(b), out=x)
    np.bitwise_or(x, t, out=x)


def _round(a, b, c, d, t):
    """One round in place; t is scratch."""
    a += b
    _rotl(b, 13, t)
    b ^= a
    _rotl(a, 32, t)
    c += d
    _rotl(d, 16, t)
    d ^= c
    a += d
    _rotl(d, 21, t)
    d ^= a
    c += b
    _rotl(b, 17, t)
    b ^= c
    _rotl(c, 32, t)


def sip13(items: list[bytes], k0=0, k1=0) -> np.ndarray:
    """64-bit SipHash-1-3 of every item; a key is a number or an array that broadcasts against the items.
    Items of one number of 8-byte blocks are hashed together."""
    k0, k1 = np.asarray(k0, _U), np.asarray(k1, _U)
    shape = np.broadcast_shapes(k0.shape, k1.shape, (len(items),))
    out = np.zeros(shape, _U)
    by: dict[int, list[int]] = {}
    for i, x in enumerate(items):
        by.setdefault(len(x) // 8, []).append(i)
    for blocks, at in by.items():
        raw = np.zeros((len(at), 8 * blocks + 8), np.uint8)
        for r, i in enumerate(at):
            raw[r, : len(items[i])] = np.frombuffer(items[i], np.uint8)
            raw[r, -1] = len(items[i]) & 255
        m = raw.view("<u8").astype(_U)
        step = max(1, _CHUNK // max(1, int(np.prod(shape[:-1]))))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            x, y = (k if k.ndim == 0 or k.shape[-1] == 1 else k.take(some, -1) for k in (k0, k1))
            v = [np.empty((*shape[:-1], len(some)), _U) for _ in range(5)]
            for i, word in enumerate((0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)):
                v[i][...] = (y if i % 2 else x) ^ _U(word)
            with np.errstate(over="ignore"):
                for k in range(blocks + 1):
                    own = np.ascontiguousarray(m[lo : lo + step, k])
                    v[3] ^= own
                    _round(*v)
                    v[0] ^= own
                v[2] ^= _U(0xFF)
                for _ in range(3):
                    _round(*v)
            out[..., some] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def token_hashes(tokens: list[str], k0=0, k1=0) -> np.ndarray:
    """Hash of a string as the reference's standard hasher has it: its bytes, then 0xFF."""
    return sip13([t.encode() + b"\xff" for t in tokens], k0, k1)


@F.pandas_udf(T.LongType())
def sip_hash(words: pd.Series) -> pd.Series:
    """SipHash-1-3 of each word, as a signed bit pattern."""
    return pd.Series(token_hashes(words.tolist()).view(np.int64))


def md5_hash(word: Column) -> Column:
    """The first 64 bits of MD5 as a signed bit pattern."""
    m = F.md5(word)
    half = lambda at: F.conv(F.substring(m, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def term_hash(term: Column, hash_fn: str = "sip13") -> Column:
    return sip_hash(term) if hash_fn == "sip13" else md5_hash(term)


def to_hex(c) -> Column:
    """16 lower-case digits of a bit pattern."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def from_hex(c) -> Column:
    """The bit pattern of up to 16 digits; null if they aren't."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.lpad(c, 16, "0")
    half = lambda at: F.conv(F.substring(p, at, 8), 16, 10).cast("long")
    return F.when(c.rlike("^[0-9a-fA-F]{1,16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def is_near_duplicate(a, b, threshold: int = 3) -> Column:
    """Whether two fingerprints differ in at most that many bits."""
    return hamming(a, b) <= threshold


def simhash_bits(weight: Column, h: Column) -> list[Column]:
    """64 aggregates: for every bit the sum of weights, negative where the bit isn't set."""
    return [F.sum(F.when(h.bitwiseAND(F.lit(1 << i if i < 63 else -(1 << 63))) != 0, weight).otherwise(-weight)).alias(f"b{i}") for i in range(64)]


def simhash(terms: DataFrame, id_col: str = "row_idx", hash_fn: str = "sip13") -> DataFrame:
    """(id, fingerprint) from rows (id, term, weight[, h]); weight is the whole contribution of the term, h its hash.

    Sums are rounded to 9 places, so that weights which cancel are a tie in whatever order they are added.
    Without h the vocabulary is hashed once a term; votes are summed before the shuffle by id.
    """
    if "h" not in terms.columns:
        terms = terms.join(terms.select("term").distinct().select("term", term_hash(F.col("term"), hash_fn).alias("h")), "term")
    votes = terms.groupBy(id_col).agg(*simhash_bits(F.col("weight"), F.col("h")))
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.round(f"b{i}", 9) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return votes.select(id_col, bits.alias("fingerprint"))


def simhash_lists(words: pd.Series) -> pd.Series:
    """The fingerprint of each list of terms, every occurrence counted, as 16 digits."""
    out = []
    for own in words:
        h = token_hashes([] if own is None else list(own))
        votes = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64).sum(0) * 2 - len(h)
        out.append(np.packbits(votes > 0).tobytes().hex())
    return pd.Series(out)


class Words:
    """Keyed hashes of words, kept from one batch to the next: at most ``most`` words (8 * perms bytes each) that came in two
    batches. Which are kept changes the time alone."""

    def __init__(self, perms: int = 128, most: int = 1 << 16, seen: int = 1 << 20):
        i = np.arange(perms, dtype=_U)
        with np.errstate(over="ignore"):
            self.k0, self.k1 = (i * _U(6364136223846793005) + _U(1))[:, None], (i * _U(1442695040888963407) + _U(7))[:, None]
        self.perms, self.most, self.limit = perms, most, seen
        self.place: dict[str, int] = {}
        self.once: set[str] = set()
        self.kept = np.empty((0, perms), _U)
        self.hashed = 0

    def table(self, words: list[str]) -> np.ndarray:
        """(words, perms): the hashes of different words."""
        at = np.array([self.place.get(w, -1) for w in words], np.int64)
        out = np.empty((len(words), self.perms), _U)
        out[at >= 0] = self.kept[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        for lo in range(0, len(new), 2048):
            some = new[lo : lo + 2048]
            out[some] = token_hashes([words[i] for i in some], self.k0, self.k1).T
        self.hashed += len(new)
        again = [i for i in new.tolist() if words[i] in self.once][: self.most - len(self.place)]
        if again:
            for i in again:
                self.place[words[i]] = len(self.place)
                self.once.discard(words[i])
            self.kept = np.concatenate([self.kept, out[again]])
        if len(self.place) < self.most:
            if len(self.once) > self.limit:
                self.once.clear()
            self.once.update(words[i] for i in new.tolist() if words[i] not in self.place)
        else:
            self.once.clear()
        return out


def least_hashes(words: list[str], row: np.ndarray, at: np.ndarray, rows: int, perms: int = 128, known: Words | None = None) -> np.ndarray:
    """(rows, perms): for each row the least hash of its words under each keyed permutation, unsigned; all ones without
    words. Row i has the words ``at[row == i]``; rows ascend. Every word is hashed once, or was by ``known``."""
    out = np.full((rows, perms), _M, _U)
    if not len(row):
        return out
    table = (known or Words(perms)).table(words)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for lo, hi in zip(begin, np.append(begin[1:], len(row))):
        out[row[lo]] = table[np.unique(at[lo:hi])].min(0)
    return out


def minhash_signature(words: list[str], perms: int = 128) -> np.ndarray:
    """Least hash of the words under each keyed permutation, unsigned; all ones without words."""
    words = sorted(set(words))
    return least_hashes(words, np.zeros(len(words), np.int64), np.arange(len(words)), 1, perms)[0]


def minhash_udf(perms: int = 128):
    """MinHash of a column of word lists; a batch's different words are hashed once."""

    @F.pandas_udf("array<long>")
    def sign(words: pd.Series) -> pd.Series:
        lists = [[] if w is None else list(w) for w in words]
        place: dict[str, int] = {}
        at = np.array([place.setdefault(w, len(place)) for x in lists for w in x], np.int64)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return pd.Series(list(least_hashes(list(place), row, at, len(lists), perms).view(np.int64)))

    return sign


def minhash_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
