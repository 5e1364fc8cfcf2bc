"""Taxonomies by hierarchical clustering. Pairs and vectors come from joins; the merging itself is
sequential and runs on the driver for at most ``MAX_ITEMS`` rows (or the sample's)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import classify, tfidf, with_row_index
from .sample import sample

MAX_ITEMS = 2000
LINKAGES = ("single", "complete", "average", "ward")


def cosine_pairs(weights: DataFrame, id_col: str = "row_idx") -> DataFrame:
    """(a, b, distance), a < b, of rows that share a term; all other pairs have distance 1."""
    norm = weights.groupBy(id_col).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = weights.join(norm, id_col).select(id_col, "term", (F.col("weight") / F.col("norm")).alias("u"))
    a, b = unit.select(F.col(id_col).alias("a"), "term", F.col("u").alias("x")), unit.select(F.col(id_col).alias("b"), "term", F.col("u").alias("y"))
    dots = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.select("a", "b", (1 - F.col("dot")).alias("distance"))


def hac(dist: np.ndarray, linkage: str = "ward") -> list[tuple[int, int, float, int]]:
    """(cluster_a, cluster_b, distance, size) of each merge; the first pair in reading order wins ties."""
    if linkage not in LINKAGES:
        raise ValueError(f"Unknown linkage: {linkage}")
    n = len(dist)
    d = np.where(np.triu(np.ones((n, n), bool), 1), dist, np.inf)
    d = np.minimum(d, d.T)
    ids, size, merges = list(range(n)), np.ones(n), []
    upper = np.where(np.triu(np.ones((n, n), bool), 1), d, np.inf)
    for step in range(n - 1):
        i, j = divmod(int(upper.argmin()), n)
        best = float(d[i, j])
        if linkage == "single":
            new = np.minimum(d[i], d[j])
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        elif linkage == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * best) / (size[i] + size[j] + size)
        new[[i, j]] = np.inf
        new[np.isnan(new)] = np.inf
        size[i] += size[j]
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        upper[j], upper[:, j] = np.inf, np.inf
        upper[:i, i], upper[i, i + 1 :] = new[:i], new[i + 1 :]
        merges.append((ids[i], ids[j], best, int(size[i])))
        ids[i] = n + step
    return merges


def cut_tree(merges: list, n: int, k: int, compat: bool = False) -> list[int]:
    """Labels of the k clusters that are left after n - k merges, in order of appearance. ``compat``
    numbers merged clusters as the reference does, which leaves more clusters than k."""
    if k >= n:
        return list(range(n))
    parent: dict[int, int] = {}
    for t, (a, b, *_) in enumerate(merges[: n - k]):
        new = n + (len(parent) if compat else t)
        parent[a] = parent[b] = new
    label: dict[int, int] = {}
    out = []
    for i in range(n):
        while i in parent:
            i = parent[i]
        out.append(label.setdefault(i, len(label)))
    return out


def _clustered(rows: DataFrame, field: str, k: int, linkage: str, compat: bool):
    """(ids in order, term weights of each, labels) of a bounded table."""
    n = rows.limit(MAX_ITEMS + 1).count()
    if n > MAX_ITEMS:
        raise ValueError(f"more rows than can be clustered exactly ({MAX_ITEMS}); discover a taxonomy from a sample instead")
    ids = sorted(r.row_idx for r in rows.select("row_idx").collect())
    place = {r: i for i, r in enumerate(ids)}
    weights = tfidf(rows, "row_idx", field).select("row_idx", "term", "weight")
    vectors: list[dict[str, float]] = [{} for _ in ids]
    for r in weights.collect():
        vectors[place[r.row_idx]][r.term] = r.weight
    dist = np.ones((n, n))
    for r in cosine_pairs(weights).collect():
        i, j = place[r.a], place[r.b]
        dist[i, j] = dist[j, i] = r.distance
    return ids, vectors, cut_tree(hac(dist, linkage), n, min(k, n), compat)


def _merged(vectors, members) -> list[tuple[str, float]]:
    total: dict[str, float] = defaultdict(float)
    for i in members:
        for t, w in vectors[i].items():
            total[t] += w
    return sorted(((t, w) for t, w in total.items()), key=lambda p: (-round(p[1], 9), p[0]))


def generate(df: DataFrame, field: str = "content", depth: int = 10, linkage: str = "ward", top_terms: int = 5, compat_cut: bool = False) -> dict:
    """The report of at most ``depth`` labelled clusters of a table of 2 to MAX_ITEMS rows."""
    rows = df if "row_idx" in df.columns else with_row_index(df)
    n = rows.limit(MAX_ITEMS + 1).count()
    if n < 2:
        raise ValueError("Need at least 2 items")
    _, vectors, labels = _clustered(rows, field, depth, linkage, compat_cut)
    cats = []
    for c in range(max(labels) + 1):
        members = [i for i, x in enumerate(labels) if x == c]
        best = _merged(vectors, members)[:top_terms]
        cats.append({"id": c, "label": ", ".join(t for t, _ in best[:3]), "size": len(members), "keywords": [{"term": t, "weight": w} for t, w in best], "members": members})
    return {"name": "generated", "num_clusters": len(cats), "num_items": n, "linkage": linkage, "categories": cats}


def discover(df: DataFrame, field: str = "content", clusters: int = 15, sample_size: int = 500, seed: int = 42, linkage: str = "ward", keywords: int = 20, compat_cut: bool = False) -> dict:
    """A taxonomy from a seeded sample of at most ``sample_size`` rows."""
    rows = df if "row_idx" in df.columns else with_row_index(df)
    n = rows.count()
    empty = {"name": "discovered", "version": "auto", "categories": []}
    if not n:
        return empty
    if n > sample_size:
        rows = sample(rows, sample_size, "random", seed=seed)
    _, vectors, labels = _clustered(rows, field, clusters, linkage, compat_cut)
    for c in range(max(labels) + 1):
        best = _merged(vectors, [i for i, x in enumerate(labels) if x == c])
        name = ", ".join(t[:1].upper() + t[1:] for t, _ in best[:3])
        empty["categories"].append({"name": name, "keywords": [t for t, _ in best[:keywords]], "children": []})
    return empty


def classify_auto(df: DataFrame, field: str = "content", taxonomy: dict | None = None, clusters: int = 15, sample_size: int = 500, threshold: float = 0.5, seed: int = 42, id_col: str = "row_idx", linkage: str = "ward") -> DataFrame:
    """``classify`` by the given taxonomy or a discovered one."""
    if taxonomy is None:
        rows = df if id_col == "row_idx" else df.withColumn("row_idx", F.col(id_col))
        taxonomy = discover(rows, field, clusters, sample_size, seed, linkage)
    return classify(df, taxonomy, field, threshold, id_col)
