"""String similarities in [0, 1]."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

METRICS = {"levenshtein": "levenshtein", "lev": "levenshtein", "jaro-winkler": "jaro-winkler", "jaro_winkler": "jaro-winkler", "jw": "jaro-winkler", "cosine": "cosine", "cos": "cosine"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def levenshtein_similarity(a, b) -> Column:
    a, b = _c(a), _c(b)
    most = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j, same = jaro(a, b), 0
    if j > 0.7:
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            same += 1
    return j + 0.1 * same * (1 - j)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def bigram_cosine(a: str, b: str) -> float:
    p, q = (Counter(zip(s.lower(), s.lower()[1:])) for s in (a, b))
    if not p or not q:
        return float(a == b)
    dot = sum(n * q[g] for g, n in p.items())
    return dot / (sum(n * n for n in p.values()) ** 0.5 * sum(n * n for n in q.values()) ** 0.5)


def cosine_similarity(a, b) -> Column:
    """Cosine of the counts of character bigrams, as an expression."""
    a, b = _c(a), _c(b)

    def grams(x):
        cut = lambda y: F.transform(F.sequence(F.lit(1), F.char_length(y) - 1), lambda i: F.substr(y, i, F.lit(2)))
        return let(F.lower(x), lambda y: F.when(F.char_length(y) < 2, F.array().cast("array<string>")).otherwise(cut(y)))

    def dot(xs, ys):
        count = lambda g, zs: F.size(F.filter(zs, lambda y: y == g))
        return F.aggregate(F.transform(F.array_distinct(xs), lambda g: count(g, xs) * count(g, ys)), F.lit(0), lambda s, v: s + v)

    ratio = let(F.struct(grams(a).alias("p"), grams(b).alias("q")), lambda t: F.when((F.size(t["p"]) > 0) & (F.size(t["q"]) > 0), dot(t["p"], t["q"]) / (F.sqrt(dot(t["p"], t["p"])) * F.sqrt(dot(t["q"], t["q"])))))
    return F.coalesce(ratio, (a == b).cast("double"))


def similarity(a, b, metric: str = "levenshtein") -> Column:
    name = METRICS.get(metric.lower())
    if name is None:
        raise ValueError(f"Unknown metric: {metric}")
    return {"levenshtein": levenshtein_similarity, "jaro-winkler": jaro_winkler_similarity, "cosine": cosine_similarity}[name](a, b)


def compare(a: str, b: str, metric: str = "levenshtein", all_metrics: bool = False) -> dict:
    """The report for two strings."""
    most = max(len(a), len(b))

    def lev():
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return 1 - row[-1] / most if most else 1.0

    every = {"levenshtein": lev, "jaro-winkler": lambda: jaro_winkler(a, b), "cosine": lambda: bigram_cosine(a, b)}
    if all_metrics:
        return {"a": a, "b": b} | {k: f() for k, f in every.items()}
    if metric.lower() not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    return {"a": a, "b": b, "metric": metric, "similarity": every[METRICS[metric.lower()]]()}
