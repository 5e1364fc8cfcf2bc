import collections
import hashlib
import random
import re

import numpy as np
import pytest

from siftstone.llm import substring_dedup as S


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_lengths():
    assert S.lengths(35) == [18, 35] and S.lengths(100) == [25, 50, 100] and S.lengths(10) == [10]


def test_minimizers_are_leftmost_least():
    h = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint64)
    starts = S._windows(np.array([0, 300]), 20)
    place, sub = S.minimizers(h, starts, 20, 7)
    for s, p in zip(starts, place):
        own = sub[s : s + 14]
        assert p == s + int(np.argmin(own))


@pytest.mark.parametrize("window", [35, 70, 5])
def test_equals_brute_force(spark, window):
    r = random.Random(window)
    word = lambda: r.choice(["a", "b", "cé", "d."]) if r.random() < 0.2 else f"w{r.randrange(300)}"
    passages = [[word() for _ in range(r.randrange(20, 160))] for _ in range(6)]
    texts = []
    for _ in range(120):
        t = [word() for _ in range(r.randrange(0, 120))]
        if r.random() < 0.5:
            k = r.randrange(len(t) + 1)
            t[k:k] = r.choice(passages)[r.randrange(10) :]
        texts.append(r.choice([" ", "\n", "\x0b "]).join(t))
    texts += [None, "", " ", "one", texts[3], texts[3], "same " * 200, ("x y z " * 40), " ".join(passages[0]), "u " + " ".join(f"n{i}" for i in range(20_000))]
    rows = [(i if i % 11 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, n_words long").repartition(3)
    got = S.remove_repeats(docs, window).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute(texts, window))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.remove_repeats(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()[0].n_removed == 0
