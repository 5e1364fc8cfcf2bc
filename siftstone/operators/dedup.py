"""Near duplicates by URL and by SimHash; LSH indexes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.url import canonical_key
from .corpus import fingerprints
from .graph import components, saved

STRATEGIES = ("url", "fuzzy", "combined")


def masks(threshold: int, lossless: bool = True) -> list[int]:
    """Bit masks such that fingerprints within the distance agree under one at least.

    64 bits are cut into threshold + r blocks; of fingerprints that differ in at most ``threshold`` bits r blocks are equal, so
    every r blocks are a mask. More blocks a mask give longer keys, which few unequal fingerprints share: 3 up to a
    threshold of 3 (20 keys of 32 bits), 2 up to 7, else 1. Above 15, or without ``lossless``, 16 blocks of 4 bits, as the
    reference's index has, whose pairs with no equal block are missing there too.
    """
    together = 3 if threshold <= 3 else 2 if threshold <= 7 else 1
    count = threshold + together
    if not lossless or threshold > 15:
        count, together = 16, 1
    edges = [64 * i // count for i in range(count + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(blocks, together)]


def hamming_pairs(fps: DataFrame, threshold: int = 3, fp_col: str = "fingerprint", lossless: bool = True) -> DataFrame:
    """(a, b, distance) of different fingerprints within the distance, a < b, once each. Equal ones are one
    row before the join, so copies never meet; a pair is given under the first mask it agrees under alone."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(threshold, lossless)]
    own = saved(fps.select(F.col(fp_col).alias("fp")).distinct())
    keyed = own.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("k", "key"))
    a, b = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(signed)])
    near = F.bit_count(x)
    # the planner knows the size of ``own``, not that of its rows under every mask, which it would broadcast
    return a.hint("merge").join(b.hint("merge"), ["k", "key"]).where((F.col("a") < F.col("b")) & (near <= threshold) & (first == F.col("k"))).select("a", "b", near.cast("int").alias("distance"))


def dedup(
    df: DataFrame, field: str = "content", url_field: str = "url", strategy: str = "combined", threshold: int = 3, id_col: str = "row_idx", hash_fn: str = "sip13", skip_empty: bool = False, strict: bool = True
) -> DataFrame:
    """``df`` with _dup_group (the least id of the group) and _is_primary (its first row).

    Groups are the connected components of equal URL keys and of fingerprints within the distance. Texts
    without terms all have fingerprint 0 and so are one group, unless ``skip_empty``. An unknown strategy
    is an error, or groups nothing if not ``strict``.
    """
    if strategy not in STRATEGIES and strict:
        raise ValueError(f"Unknown strategy: {strategy}")
    df = df.drop("_dup_group", "_is_primary")
    edges = None
    # groups of rows are stars around their least row, so they take one edge a row
    if strategy in ("url", "combined") and url_field in df.columns:
        keys = saved(df.select(F.col(id_col).alias("id"), canonical_key(url_field).alias("key")).where("key IS NOT NULL"))
        hub = keys.groupBy("key").agg(F.min("id").alias("hub"))
        edges = keys.join(hub, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    if strategy in ("fuzzy", "combined"):
        text = df if field in df.columns else df.withColumn(field, F.lit(""))
        fps = fingerprints(text, field, id_col=id_col, hash_fn=hash_fn)
        fps = saved((fps.where("fingerprint <> 0") if skip_empty else fps).select(F.col(id_col).alias("id"), "fingerprint"))
        hub = saved(fps.groupBy("fingerprint").agg(F.min("id").alias("hub")))
        same = fps.join(hub, "fingerprint").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        near = hamming_pairs(hub, threshold)
        left, right = hub.select(F.col("fingerprint").alias("a"), F.col("hub").alias("x")), hub.select(F.col("fingerprint").alias("b"), F.col("hub").alias("y"))
        near = near.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = same.union(near) if edges is None else edges.union(same).union(near)
    if edges is None:
        return df.withColumn("_dup_group", F.col(id_col)).withColumn("_is_primary", F.lit(True))
    label = components(edges).select(F.col("node").alias(id_col), "label")
    out = df.join(label, id_col, "left").withColumn("_dup_group", F.coalesce("label", id_col)).drop("label")
    return out.withColumn("_is_primary", F.col("_dup_group") == F.col(id_col))


def lsh_keys(signature: Column, bands: int = 16, rows: int = 8) -> Column:
    """(band, key) of every band of a MinHash signature; the signature must be long enough."""
    part = lambda k: F.slice(signature, k * rows + 1, rows)
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), part(k)).alias("key")) for k in range(bands)])
    return F.when(F.size(signature) >= bands * rows, keys).otherwise(F.raise_error("the signature is shorter than bands * rows"))


def minhash_candidates(df: DataFrame, id_col: str = "row_idx", sig_col: str = "signature", bands: int = 16, rows: int = 8) -> DataFrame:
    """(a, b) ids of signatures that share a band, a < b, once each."""
    keyed = df.select(id_col, F.explode(lsh_keys(F.col(sig_col), bands, rows)).alias("k"))
    a, b = keyed.select(F.col(id_col).alias("a"), "k"), keyed.select(F.col(id_col).alias("b"), "k")
    return a.join(b, "k").where("a < b").select("a", "b").distinct()


def minhash_query(df: DataFrame, signature: list[int], id_col: str = "row_idx", sig_col: str = "signature", bands: int = 16, rows: int = 8) -> DataFrame:
    """Ids of signatures that share a band with the given one."""
    own = F.array(*[F.lit(v) for v in signature])
    return df.where(F.arrays_overlap(lsh_keys(F.col(sig_col), bands, rows), lsh_keys(own, bands, rows))).select(id_col)
