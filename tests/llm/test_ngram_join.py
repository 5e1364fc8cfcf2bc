import random

import numpy as np
import pytest

from siftstone.llm import ngram_join as J


def grams(t, n=3):
    w = t.split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


@pytest.fixture
def rows():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.randrange(1, 80))]
        for _ in range(r.randrange(1, 5)):
            t = [r.choice(vocab) if r.random() < 0.06 else w for w in base]
            out += [" ".join(t)] * r.choice([1, 1, 1, 3])
    out += ["", None, " \t", "one", "one two", "one two", "x " * 30_000]
    base = [r.choice(vocab) for _ in range(60)]  # a crowded node: 200 near copies
    for i in range(200):
        t = list(base)
        t[i % 60] = f"edit{i}"
        out.append(" ".join(t))
    return [(i if i % 50 else None, t, "x", i) for i, t in enumerate(out)]


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_links long").repartition(4)
    got = J.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(t or "", []).append(i)
    sets = {t: grams(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) / len(sets[t] | sets[u]) >= J.THRESHOLD] for t in texts}
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    label = {}
    for t in texts:
        if t not in label:
            todo, seen = [t], {t}
            while todo:
                for u in links[todo.pop()]:
                    if u not in seen:
                        seen.add(u)
                        todo.append(u)
            c = least(i for u in seen for i in texts[u])
            label |= dict.fromkeys(seen, c)
    want = [(i, label[t or ""], least(texts[t or ""]), len(texts[t or ""]), len(links[t or ""])) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_and_depth(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert J.depth_for(0.5, 0.99, 40) == 3
    assert J.depth_for(0.9, 0.99, 40) > 3
    assert J.meets(0.5, J.depth_for(0.5, 0.99)) >= 0.99


def test_common_prefixes():
    r = random.Random(1)
    labels = [(r.randrange(2), *(r.choice([0, 1, 0xFFFF]) for _ in range(J.DEPTH))) for _ in range(400)]
    k1 = np.array([t << 48 | a << 32 | b << 16 | c for t, a, b, c, *_ in labels])
    k2 = np.array([d << 32 | e << 16 | f for *_, d, e, f in labels])
    got = J._common(k1[1:], k2[1:], k1[:-1], k2[:-1]).tolist()
    for x, y, n in zip(labels, labels[1:], got):
        want = -1
        if x[0] == y[0]:
            want = 0
            while want < J.DEPTH and x[1 + want] == y[1 + want]:
                want += 1
        assert n == want


def test_unmet_links():
    """Of links at the threshold alone, the estimate tells those that are left."""
    n = 10_000
    a, b = J.meets(0.5, 6), J.meets(0.5, 5)
    assert abs(J.unmet(round(n * (b - a)), 6, 5, 0.5) - n * (1 - b)) < 20
