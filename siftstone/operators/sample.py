"""Seeded samples of exact size. Indices are drawn on the driver (as many as the sample, or as the table
for reservoirs) and applied by a left-semi join."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import with_row_index

_M = (1 << 64) - 1
STRATEGIES = ("random", "systematic", "stratified", "reservoir")


class Lcg:
    def __init__(self, seed: int):
        self.state = seed + 1 & _M

    def next(self) -> int:
        self.state = self.state * 6364136223846793005 + 1442695040888963407 & _M
        return self.state


def random_sample(total: int, size: int, seed: int = 42) -> list[int]:
    """The first ``size`` places of a shuffle, in order; memory follows the sample alone."""
    if size >= total:
        return list(range(total))
    rng, moved, out = Lcg(seed), {}, []
    for i in range(size):
        j = i + rng.next() % (total - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return sorted(out)


def systematic_sample(total: int, size: int, seed: int = 42) -> list[int]:
    if size >= total:
        return list(range(total))
    k = total / size
    start = Lcg(seed).next() / float(_M) * k
    return [i for i in (int(start + j * k) for j in range(size)) if i < total]


def reservoir_sample(total: int, size: int, seed: int = 42) -> list[int]:
    if size >= total:
        return list(range(total))
    rng, out = Lcg(seed), list(range(size))
    for i in range(size, total):
        j = rng.next() % (i + 1)
        if j < size:
            out[j] = i
    return sorted(out)


def quotas(counts: dict[str, int], size: int) -> dict[str, int]:
    """Rows a stratum, by name: its rounded share, the last one taking the rest."""
    total, left, out = sum(counts.values()), size, {}
    names = sorted(counts)
    for i, k in enumerate(names):
        q = left if i == len(names) - 1 else min(math.floor(counts[k] / total * size + 0.5), left)
        out[k] = min(q, counts[k])
        left -= q
    return out


def stratified_places(counts: dict[str, int], size: int, seed: int = 42) -> list[tuple[str, int]]:
    """(stratum, place within it)."""
    if size >= sum(counts.values()):
        return [(k, i) for k in sorted(counts) for i in range(counts[k])]
    return [(k, i) for n, (k, q) in enumerate(quotas(counts, size).items()) for i in random_sample(counts[k], q, seed + n)]


def sample(df: DataFrame, size: int = 100, strategy: str = "random", field: str | None = None, seed: int = 42, id_col: str = "row_idx", dense: bool = True) -> DataFrame:
    """The sampled rows. ``id_col`` gives the order, and the places themselves if ``dense`` (0, 1, 2, ...)."""
    total = df.count()
    if not total:
        return df
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    if strategy == "stratified":
        if field is None:
            raise ValueError("stratified sampling needs a field")
        name = F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit("unknown"))
        counts = {r[0]: r[1] for r in df.groupBy(name.alias("s")).count().collect()}
        picked = df.sparkSession.createDataFrame(pd.DataFrame(stratified_places(counts, size, seed), columns=["__s", "__i"]), "__s string, __i long")
        rows = df.withColumn("__s", name).withColumn("__i", F.row_number().over(Window.partitionBy("__s").orderBy(id_col)).cast("long") - 1)
        return rows.join(picked, ["__s", "__i"], "left_semi").drop("__s", "__i")
    places = {"random": random_sample, "systematic": systematic_sample, "reservoir": reservoir_sample}[strategy](total, size, seed)
    picked = df.sparkSession.createDataFrame(pd.DataFrame({"__i": places}, dtype="int64"), "__i long")
    if dense:
        return df.join(picked, df[id_col] == picked["__i"], "left_semi")
    # rows of one id are told apart by their other columns, and each takes a place of its own
    order = [id_col, *(f.name for f in df.schema if f.name != id_col and not any(k in f.dataType.simpleString() for k in ("map<", "variant")))]
    return with_row_index(df.orderBy(*(F.col(f"`{c}`") for c in order)), "__i").join(picked, "__i", "left_semi").drop("__i")
