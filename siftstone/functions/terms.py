"""Whole texts to counted terms, fingerprints and signatures: words are found in the JVM, and what follows is done an
Arrow batch at a time on its different words, within the rows. Nothing is shuffled by row."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import Words, least_hashes, token_hashes
from .text import STOPWORDS, raw_words

_SPLIT = 128 << 20
_ROWS, _WORDS = 512, 1 << 17
#: so many terms of rows vote at a time
_VOTES = 1 << 14
_STOP = pa.array(STOPWORDS)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is so small that its files are read by fewer tasks; larger tables are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * _SPLIT else df


def _batches(batches):
    """(ids, row of each term, its place among the terms, the terms) of a few hundred rows at a time, fewer where they have
    many words; one at least."""
    for whole in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        j = 0
        while j < whole.num_rows:
            i, before = j, ends[j - 1] if j else 0
            j = min(i + _ROWS, max(i + 1, int(np.searchsorted(ends, before + _WORDS, "right"))))
            j = min(j, whole.num_rows)
            b = whole.slice(i, j - i)
            lists = b.column(1)
            words = lists.flatten().dictionary_encode()
            names = words.dictionary
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            good = pc.and_(pc.greater_equal(pc.binary_length(names), 2), pc.invert(pc.is_in(names, _STOP)))
            good = pc.and_(good, pc.not_equal(pc.utf8_ltrim(names, "_"), "")).to_numpy(zero_copy_only=False)
            at = words.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), size)
            keep = good[at]
            place = np.cumsum(good) - 1
            yield b.column(0), row[keep], place[at[keep]], names.filter(pa.array(good))


def _counted(row: np.ndarray, at: np.ndarray, n: int):
    """(row, term, tf) of each term of a row, by row."""
    pair, tf = np.unique(row * max(n, 1) + at, return_counts=True)
    r, t = np.divmod(pair, max(n, 1))
    return r, t, tf


def _mapped(df: DataFrame, id_col: str, words: Column, run, schema: str) -> DataFrame:
    src = spread(df).select(id_col, words.alias("words"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, {schema}")


def term_counts(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """(id, term, tf, dl): how often a row has the term, and how many it has; rows without terms give none."""

    def run(batches):
        for ids, row, at, names in _batches(batches):
            r, t, tf = _counted(row, at, len(names))
            dl = np.bincount(row, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), names.take(pa.array(t)), pa.array(tf.astype(np.int64)), pa.array(dl[r].astype(np.int64))], [id_col, "term", "tf", "dl"])

    return _mapped(df, id_col, raw_words(field), run, "term string, tf long, dl long")


def strongest(df: DataFrame, id_col: str, count: int) -> DataFrame:
    """Of rows (id, term, tf, dl, least, most), a score's bounds, those that may be among the id's ``count`` highest. Rows are
    seen an Arrow batch at a time; an id that is cut by batches keeps more of them."""

    def run(batches):
        for b in batches:
            ids = b.column(0).dictionary_encode()
            row = pc.fill_null(ids.indices, len(ids.dictionary)).to_numpy(zero_copy_only=False)
            least, most = (b.column(k).to_numpy(zero_copy_only=False) for k in ("least", "most"))
            order = np.lexsort((-least, row))
            size = np.bincount(row, minlength=1)
            kth, enough = np.cumsum(size) - size + max(count, 1) - 1, size >= max(count, 1)
            floor = np.full(len(size), -np.inf)
            floor[enough] = least[order[kth[enough]]]
            # scores are rounded to 9 places before they are compared
            yield b.select([id_col, "term", "tf", "dl"]).filter(pa.array(most >= floor[row] - 2e-9))

    return df.mapInArrow(run, df.select(id_col, "term", "tf", "dl").schema)


def _hashes(names: pa.Array, hash_fn: str) -> np.ndarray:
    words = names.to_pylist()
    if hash_fn == "sip13":
        return token_hashes(words)
    return np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in words], np.uint64)


def fingerprints(df: DataFrame, id_col: str, field: str, hash_fn: str = "sip13") -> DataFrame:
    """(id, fingerprint) of every row: SimHash of its terms, each counted as often as it occurs; 0 without terms."""

    def run(batches):
        for ids, row, at, names in _batches(batches):
            r, t, tf = _counted(row, at, len(names))
            out = np.zeros(len(ids), np.uint64)
            if len(r):
                h = _hashes(names, hash_fn).astype(">u8").view(np.uint8).reshape(-1, 8)
                votes = np.zeros((len(ids), 64), np.int64)
                for lo in range(0, len(r), _VOTES):
                    own = r[lo : lo + _VOTES]
                    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    bits = np.unpackbits(h[t[lo : lo + _VOTES]], axis=1).astype(np.int64) * 2 - 1
                    bits *= tf[lo : lo + _VOTES, None]
                    votes[own[begin]] += np.add.reduceat(bits, begin, axis=0)
                out = np.packbits(votes > 0, axis=1).view(">u8").ravel().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out.view(np.int64))], [id_col, "fingerprint"])

    return _mapped(df, id_col, raw_words(field), run, "fingerprint long")


def signatures(df: DataFrame, id_col: str, field: str, perms: int = 128) -> DataFrame:
    """(id, signature) of every row: MinHash of its terms; all ones without terms."""

    def run(batches):
        known = Words(perms)
        for ids, row, at, names in _batches(batches):
            out = least_hashes(names.to_pylist(), row, at, len(ids), perms, known).view(np.int64)
            off = pa.array(np.arange(0, out.size + 1, perms, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(off, pa.array(out.ravel()))], [id_col, "signature"])

    return _mapped(df, id_col, raw_words(field), run, "signature array<long>")
