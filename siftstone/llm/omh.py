"""Order MinHash document fingerprints.

A text's elements are its k-mers of code points (a shorter text is one element), numbered by
occurrence. Each of ``VALUES`` random orders ranks all elements anew; the ``TUPLE`` least of them
(ties by place) are put in text order and their k-mers hashed as a tuple, so that both a changed k-mer
and a changed order change the value. A fingerprint is 16 bits a value, in hexadecimal; likeness is the share of
equal values. Orders are independent at every length: an element's 32-bit hash is permuted
by xor and an odd factor for each, a tile of orders and elements at a time.

Null is the empty text, whose fingerprint is all zeros. Equal texts have equal fingerprints; long texts are
fingerprinted whole; empty tables give no rows, further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, mix, sha

K, VALUES, TUPLE = 5, 64, 2
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=U64)) >> U64(32)
_XOR, _ODD = _SEEDS[:VALUES].astype(np.uint32)[:, None], (_SEEDS[VALUES:] | U64(1)).astype(np.uint32)[:, None]
_CELLS = 1 << 16  # of a tile


def _order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places), by hash and place; hashes lose as many low bits as a place needs."""
    low = (1 << max(len(h) - 1, 1).bit_length()) - 1
    x = (h & U64(~low & (1 << 64) - 1)) | np.arange(len(h), dtype=U64)
    x.sort()
    return x & U64(~low & (1 << 64) - 1), (x & U64(low)).astype(np.int64)


def fingerprint(text: str) -> np.ndarray:
    """VALUES unsigned 16-bit values."""
    if not text:
        return np.zeros(VALUES, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(len(points) - K + 1, 1)
    h = np.zeros(n, U64)
    for j in range(min(K, len(points))):
        h *= _A
        h += points[j : j + n]
    h = mix(h + _B)
    # number the occurrences of each k-mer
    same, place = _order(h)
    new = np.concatenate([[True], same[1:] != same[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    element = np.empty(n, np.uint32)
    element[place] = mix(h[place] + (np.arange(n) - begin).astype(U64) * _A) >> U64(32)
    at = np.full((VALUES, TUPLE), n)  # missing ones last
    step = max(_CELLS // n, 1)
    for lo in range(0, VALUES, step):
        rank = (element ^ _XOR[lo : lo + step]) * _ODD[lo : lo + step]
        for k in range(min(TUPLE, n)):
            least = rank.argmin(1)
            at[lo : lo + step, k] = least
            rank[np.arange(len(rank)), least] = 0xFFFFFFFF
    at.sort(axis=1)
    word = np.append(h, U64(1))
    value = np.zeros(VALUES, U64)
    for k in range(TUPLE):
        value = mix(value * _A + word[at[:, k]])
    return (value >> U64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""

    def run(batches):
        for b, texts, _, _ in chunks(batches, text_col):
            prints = [_hex(fingerprint(t)) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], [id_col, "fingerprint"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness to it and to the next document's.

    The next document is the one of the next doc_id (null first, ties by text, after the last the
    first). Ranges of doc_id go to one task each, in order, with a copy of the first document of the
    next range; the driver sees one id for each range. One shuffle of the text. Rows of one id follow each
    other in one task, one at a time.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("ord"))
    probs = [i / (8 * parts) for i in range(1, 8 * parts)]
    edges = np.unique(np.array(rows.approxQuantile("ord", probs, 0.2 / (8 * parts)), np.float64))

    @F.pandas_udf("int")
    def bucket(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(np.float64), "right").astype(np.int32))

    first = {r.bucket: r.least for r in rows.select("ord", bucket("ord").alias("bucket")).groupBy("bucket").agg(F.min("ord").alias("least")).collect()}
    full = sorted(first)
    heads = [(b, first[b], full[i - 1]) for i, b in enumerate(full)]
    heads = spark.createDataFrame(heads, "b int, ord long, bucket int")
    own = rows.withColumn("bucket", bucket("ord")).withColumn("copy", F.lit(0))
    copies = rows.join(F.broadcast(heads), "ord").select("doc_id", "text", "ord", "bucket", F.lit(1).alias("copy"))
    lined = own.unionByName(copies).repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", "ord", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last = None  # (bucket, doc_id, text, fingerprint) without a successor so far
        for b, texts, _, _ in chunks(batches):
            out = []
            for doc_id, text, at, copy in zip(b.column("doc_id").to_pylist(), texts.to_pylist(), b.column("bucket").to_pylist(), b.column("copy").to_pylist()):
                if copy and (last is None or last[0] != at):
                    continue  # a further document of the same first id
                f = fingerprint(text)
                if last is not None and last[0] == at:
                    new = edited(last[2], text)
                    g = fingerprint(new)
                    out.append((last[1], len(last[2]), sha(new.encode()), _hex(last[3]), _hex(g), likeness(last[3], g), likeness(last[3], f)))
                last = None if copy else (at, doc_id, text, f)
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return lined.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
