import zlib

import numpy as np
import pyarrow as pa

from siftstone.llm import toxicity as X


def brute_marginals(w, trans):
    """Sum over all taggings."""
    n, t = len(w), np.exp(trans)
    p, z = np.zeros(n), 0.0
    for m in range(2**n):
        y = [m >> i & 1 for i in range(n)]
        v = np.prod([w[i] if y[i] else 1 for i in range(n)]) * np.prod([t[y[i], y[i + 1]] for i in range(n - 1)])
        z += v
        p += v * np.array(y)
    return p / z


def test_marginals_equal_all_taggings():
    r = np.random.default_rng(3)
    lens = [0, 3, 1, 0, 8, 5]
    first = np.concatenate([[0], np.cumsum(lens)])
    w, trans = np.exp(r.normal(size=first[-1])), r.normal(size=(2, 2))
    f, b = X.messages(w, first, trans)
    p = f * b / (1 + f * b)
    for i, j in zip(first[:-1], first[1:]):
        if j > i:
            assert np.allclose(p[i:j], brute_marginals(w[i:j], trans))


def sequential(w, first, trans):
    """One token after the other."""
    (a, b), (c, d) = np.exp(trans)
    f, q = np.empty(len(w)), np.ones(len(w))
    for i, j in zip(first[:-1], first[1:]):
        for k in range(i, j):
            f[k] = w[k] * (1 if k == i else (b + d * f[k - 1]) / (a + c * f[k - 1]))
        for k in range(j - 2, i - 1, -1):
            x = w[k + 1] * q[k + 1]
            q[k] = (c + d * x) / (a + b * x)
    return f, q


def test_long_chains_in_pieces_are_whole():
    r = np.random.default_rng(4)
    lens = [0, 3, X.PIECE, X.PIECE + 1, 5 * X.PIECE + 17, 0, 2 * X.PIECE, 1]
    first = np.concatenate([[0], np.cumsum(lens)])
    w, trans = np.exp(4 * r.normal(size=first[-1])), r.normal(size=(2, 2))
    for got, want in zip(X.messages(w, first, trans), sequential(w, first, trans)):
        assert np.allclose(got, want, rtol=1e-9)


def test_every_feature_keeps_its_weight():
    r = np.random.default_rng(5)
    keys = np.unique(r.integers(1, 1 << 63, 3000).astype(np.uint64) & np.uint64(~0xFF & (1 << 64) - 1))  # places clash
    model = X.Model(*X._slots(keys, np.arange(len(keys)) / 1000.0), 0.0)
    others = keys + np.uint64(1)
    assert np.allclose(np.log(model.emissions(np.stack([keys, others]))), np.arange(len(keys)) / 1000.0)


def test_near_copies_share_one_weight():
    r = np.random.default_rng(6)
    draw = lambda n: r.integers(1, 1 << 60, n).astype(np.uint64)
    base = draw(200)
    near = base.copy()
    near[7] = 5
    texts, y = [base, near, base, base, draw(200), draw(0)], np.array([1, 1, 1, 0, 1, 1], bool)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = X._shares(np.concatenate(texts), first, y)
    assert got.tolist() == [1 / 3, 1 / 3, 1 / 3, 1, 1, 1]


def test_fit_follows_the_likelihood():
    """The gradient of the weighted log likelihood vanishes as the field learns: marginals come near the labels."""
    texts = ["good day to you"] * 1 + [f"fine word{chr(97 + i % 26)} here" for i in range(60)] + [f"vile word{chr(97 + i % 26)} here" for i in range(60)]
    model = X.fit(texts, [0] * 61 + [1] * 60, {0: 1.0, 1: 1.0})
    data, off = X.flat(X.text_array(pa.array(["vile word here", "fine word here"])))
    f, _, _, first = X.tokens(data, off)
    p = model.marginals(f, first)
    assert p[0] > 0.9 and p[1:].max() < 0.2
    # the score is a logistic function of the largest marginal's log-odds and of the expected number of toxic tokens
    for k, own in enumerate((p[:3], p[3:])):
        top = np.clip(own.max(), 1e-4, 1 - 1e-4)
        z = model.score @ [1, np.log(top / (1 - top)), np.log1p(own.sum())]
        assert np.isclose(model.document(p, first)[k], 1 / (1 + np.exp(-np.clip(z, -50, 50))))


def test_tokens_and_offsets():
    texts = ["Éa bad. BAD", "", "x1y"]
    data, off = X.flat(X.text_array(pa.array(texts)))
    f, s, e, first = X.tokens(data, off)
    assert np.diff(first).tolist() == [3, 0, 2]
    assert f[0, 1] == f[0, 2] != f[0, 0]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    assert X._spans(np.array([0.1, 0.9, 0.8, 0.2, 0.7]), s, e, first, points, off) == ["3:11", "", "2:3"]


def corpus(n=1200, seed=0):
    r = np.random.default_rng(seed)
    clean = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words, bad = list(r.choice(clean, 40)), i % 5 == 0
        if bad:
            for k in r.choice(40, 4, replace=False):
                words[k] = r.choice(["vile", "scoundrel", "wretch"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad), 1))
    return rows, labels


def test_sample_reaches_rare_toxic_words():
    r = np.random.default_rng(1)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    word = lambda i, bad: "wretch" if bad and i % 80 == 0 else "vile" if bad else "fine"
    texts = [" ".join([*r.choice(vocab, 12), word(i, bad)]) for bad in (0, 1) for i in range(X.SAMPLE)]
    toxic = [int(i >= X.SAMPLE) for i in range(len(texts))]
    model = X.fit(texts, toxic, {0: 1.0, 1: 1.0})
    data, off = X.flat(X.text_array(pa.array(["waa wretch wab"])))
    f, _, _, first = X.tokens(data, off)
    assert model.marginals(f, first)[1] > 0.5  # in 1.25% of the toxic documents


def test_held_out_and_edges(spark):
    rows, labels = corpus()
    rows += [(None, None, "s"), (5000, "", "s"), (5001, "Éé wretch! " + "waa " * 50_000, "s"), (5001, "12", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1), (9999, 1, 0), (0, 1, 1)], "doc_id long, toxic int, quality int")
    got = X.score_documents(docs, lab).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in out]) > 0.98
    assert by[None].score == by[5000].score < 0.5
    text = rows[5][1]
    marked = [text[int(a) : int(b)] for a, b in (x.split(":") for x in by[5].spans.split(","))]
    assert marked and all(any(w in m for w in ("vile", "scoundrel", "wretch")) for m in marked)
    assert X.score_documents(docs.limit(0), lab).count() == 0
    assert {r.score for r in X.score_documents(docs, lab.limit(0)).collect()} == {1 / (1 + np.exp(50))}
