"""Substring deduplication by level-wise doubling.

Sought are windows of ``window`` consecutive words that start in more than one place. Lengths
double up to it (18, 35). Below the last length a window is represented by its least sub-window of
that length (its minimizer, the leftmost of equal ones): equal windows have equal minimizers, so a
window whose minimizer starts in one place alone is unique, and only the others are extended to
the next length. At the last length the windows themselves are counted. If nothing survives a
level, the rest is empty.

Texts are known by 96 bits of their MD5 and windows by 96 bits. Equal texts are one row with a
number of copies. Counts are partly summed before each shuffle; a hot passage's rows meet its one
count in a join that may be split. All texts are shuffled once, to the first level's survivors; later
steps have the texts alone in which something survived. Null text has no words; repeated rows are copies of each other;
an empty table gives no rows and further columns of any name are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import forget, saved
from .common import U64, chunks, documents, mix, ranges_hash, sha, word_hashes, words

WINDOW, SHORTEST = 35, 16


def lengths(window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    out = [window]
    while -(-out[0] // 2) >= shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _windows(first: np.ndarray, window: int) -> np.ndarray:
    """Starts of all windows within texts."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    return np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)


def minimizers(h: np.ndarray, starts: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the start of its least sub-window; and the sub-windows' hashes by start."""
    n = len(h)
    at = np.arange(max(n - length + 1, 0))
    sub = np.concatenate([ranges_hash(h, at, at + length), np.full(n - len(at), ~U64(0))])
    need, have = window - length + 1, 1
    value, place = sub, np.arange(n)
    while have < need:  # least of `have` sub-windows from each start, have doubling
        step = min(have, need - have)
        v, p = value[step:], place[step:]
        less = v < value[: n - step]
        value = np.concatenate([np.where(less, v, value[: n - step]), value[n - step :]])
        place = np.concatenate([np.where(less, p, place[: n - step]), place[n - step :]])
        have += step
    return place[starts], sub


def _keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    m = F.md5(text)
    k = lambda a, n: F.conv(F.substring(m, a, n), 16, 10)
    return docs.withColumn("__text", text).withColumn("k1", k(1, 15).cast("long")).withColumn("k2", k(16, 9).cast("long"))


def _emit(rows: DataFrame, window: int, length: int, before: int | None) -> DataFrame:
    """(h1, h2, k1, k2, start, copies) of the level's windows. rows: k1, k2, copies, __text[, alive]: the
    starts of the minimizers of length ``before`` that survived."""

    def run(batches):
        for b, _, data, off in chunks(batches, "__text"):
            h, first, _, _ = word_hashes(data, off)
            h >>= U64(1)
            starts = _windows(first, window)
            if before is not None and len(starts):
                place, _ = minimizers(h, starts, window, before)
                alive = b.column("alive").combine_chunks() if isinstance(b.column("alive"), pa.ChunkedArray) else b.column("alive")
                n = np.array([0 if x is None else len(x) for x in alive.to_pylist()], np.int64)
                kept = np.zeros(len(h), bool)
                kept[alive.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(first[:-1], n)] = True
                starts = starts[kept[place]]
            if length < window:
                at, sub = minimizers(h, starts, window, length)
                at = np.unique(at)
                h1, h2 = sub[at], np.zeros(len(at), np.int32)
            else:
                at = starts
                h1 = ranges_hash(h, at, at + window)
                h2 = (ranges_hash(mix(h) >> U64(1), at, at + window) >> U64(32)).astype(np.uint32).view(np.int32)
            doc = np.searchsorted(first, at, "right") - 1
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2), b.column("k1").take(take), b.column("k2").take(take), pa.array((at - first[doc]).astype(np.int32)), b.column("copies").take(take)],
                ["h1", "h2", "k1", "k2", "start", "copies"],
            )

    return rows.mapInArrow(run, "h1 long, h2 int, k1 long, k2 long, start int, copies int")


def _repeated(level: DataFrame) -> DataFrame:
    """(k1, k2, alive): starts of the level's windows that start in more than one place."""
    often = level.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2")
    return level.join(often, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("start").alias("alive"))


def removed_words(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(k1, k2, n_removed, kept_sha256, kept) of each distinct text that loses words, kept being what is left of it."""
    keyed = _keyed(docs, text_col)
    texts = keyed.groupBy("k1", "k2").agg(F.first("__text").alias("__text"), F.count(F.lit(1)).cast("int").alias("copies"))
    steps, rows = lengths(window), keyed.select("k1", "k2", F.lit(1).alias("copies"), "__text")
    for before, length in zip([None, *steps], steps):
        level = saved(_emit(rows, window, length, before))
        alive = _repeated(level)
        # texts in which nothing survives are left behind here
        rows = (texts if before is None else rows.drop("alive")).join(alive, ["k1", "k2"])
        if length < window:
            rows = saved(rows)
            forget(level)

    def run(batches):
        for b, texts, data, off in chunks(batches, "__text"):
            _, first, s, e = word_hashes(data, off)
            raw, rows = data.tobytes(), []
            for i, own in enumerate(b.column("alive").to_pylist()):
                lo, hi = int(first[i]), int(first[i + 1])
                gone, own = np.zeros(hi - lo + 1, np.int64), np.array(own)
                np.add.at(gone, own, 1)
                np.subtract.at(gone, own + window, 1)
                keep = lo + np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                left = b" ".join([raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())])
                rows.append((hi - lo - len(keep), sha(left), left.decode()))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *cols], ["k1", "k2", "n_removed", "kept_sha256", "kept"])

    return rows.select("k1", "k2", "__text", "alive").mapInArrow(run, "k1 long, k2 long, n_removed long, kept_sha256 string, kept string")


def _whole(rows: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, whole): the number and digest of all words of each row."""

    def run(batches):
        for b, _, data, off in chunks(batches, "__text"):
            s, e, first = words(data, off)
            raw = data.tobytes()
            s, e, first = s.tolist(), e.tolist(), first.tolist()
            digest = [sha(b" ".join([raw[x:y] for x, y in zip(s[i:j], e[i:j])])) for i, j in zip(first, first[1:])]
            n = [j - i for i, j in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(n, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "k1", "k2", "n_words", "whole"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "k1", "k2", "__text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, n_words long, whole string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    found = removed_words(docs, "text", window).drop("kept")
    rows = _whole(_keyed(docs.select("doc_id", "text"))).join(found, ["k1", "k2"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op8(spark, sf_dir):
    """What is left of every document without repeated windows of 35 words."""
    return remove_repeats(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 33, 1))) AS s FROM d)),
often AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM win SEMI JOIN often USING (h)),
lost AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
"""
