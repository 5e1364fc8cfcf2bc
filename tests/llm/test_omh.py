import hashlib
import random

import numpy as np

from siftstone.llm import omh


M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def brute(text):
    """From the definition: every order ranks all numbered k-mers, the two least are hashed as they follow each other."""
    if not text:
        return np.zeros(64, np.uint16)
    mix = lambda x: int(omh.mix(np.array([x & M64], np.uint64))[0])
    kmers = [text[i : i + 5] for i in range(max(len(text) - 4, 1))]
    hashes, seen, elements = [], {}, []
    for k in kmers:
        h = 0
        for c in k:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & M64
        hashes.append(mix(h + 0xC2B2AE3D27D4EB4F))
        seen[k] = seen.get(k, -1) + 1
        elements.append(mix(hashes[-1] + seen[k] * 0x9E3779B97F4A7C15) >> 32)
    out = []
    for t in range(64):
        x, a = mix(t + 1) >> 32, mix(t + 65) >> 32 | 1
        ranked = sorted((((e ^ x) * a) & M32, i) for i, e in enumerate(elements))
        v = 0
        for h in ([hashes[i] for i in sorted(i for _, i in ranked[:2])] + [1])[:2]:
            v = mix(v * 0x9E3779B97F4A7C15 + h)
        out.append(v >> 48)
    return np.array(out, np.uint16)


def exact_likeness(a, b, orders=400):
    """The same with orders drawn by shuffles: the share of orders whose tuples agree."""

    def numbered(t):
        seen, out = {}, []
        for i in range(max(len(t) - 4, 1)):
            k = t[i : i + 5]
            seen[k] = seen.get(k, -1) + 1
            out.append((k, seen[k]))
        return out

    r, x, y = random.Random(9), numbered(a), numbered(b)
    every, same = sorted(set(x) | set(y)), 0
    for _ in range(orders):
        rank = dict(zip(every, r.sample(range(len(every)), len(every))))
        least = [[k for _, k in sorted((i, e[0]) for i, e in sorted(enumerate(z), key=lambda p: rank[p[1]])[:2])] for z in (x, y)]
        same += least[0] == least[1]
    return same / orders


def test_likeness_at_every_length():
    """Without bias from 10 to 1000 characters."""
    r = random.Random(3)
    for n, times in [(10, 60), (20, 60), (40, 60), (80, 40), (1000, 8)]:
        got, want = [], []
        for _ in range(times):
            a, b = ("".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for _ in range(2))
            e = omh.edited(a, b)
            got.append(omh.likeness(omh.fingerprint(a), omh.fingerprint(e)))
            want.append(exact_likeness(a, e))
        assert abs(np.mean(got) - np.mean(want)) < 0.05, n


def test_fingerprint_equals_brute_force():
    r = random.Random(0)
    for n in [0, 1, 4, 5, 6, 50, 700]:
        t = "".join(r.choice("abcé日 ") for _ in range(n))
        assert (omh.fingerprint(t) == brute(t)).all(), n


def test_order_matters():
    r = random.Random(1)
    a, b = ("".join(r.choice("abcdefghij") for _ in range(3000)) for _ in range(2))
    swap = omh.likeness(omh.fingerprint(a + b), omh.fingerprint(b + a))
    small = omh.likeness(omh.fingerprint(a + b), omh.fingerprint(a + "x" + b))
    assert small > 0.9 > 0.75 > swap
    assert omh.likeness(omh.fingerprint(a), omh.fingerprint(b)) < 0.1


def test_frames(spark):
    r = random.Random(2)
    rows = [(i * 3, "".join(r.choice("abcd é") for _ in range(r.randrange(60))), "x") for i in range(400)]
    rows += [(None, None, "x"), (7, "é" * 40_000, "x"), (1, "", "x"), (2, None, "x"), (2, "tie", None), (2, "tie", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = omh.fingerprint_edits(df).collect()
    ordered = sorted(((-1 if i is None else i), (t or "").encode(), i) for i, t, _ in rows)
    want = []
    for k, (_, t, i) in enumerate(ordered):
        t, nxt = t.decode(), ordered[(k + 1) % len(ordered)][1].decode()
        e = omh.edited(t, nxt)
        f, g = omh.fingerprint(t), omh.fingerprint(e)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), omh._hex(f), omh._hex(g), omh.likeness(f, g), omh.likeness(f, omh.fingerprint(nxt))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert omh.fingerprint_edits(df.limit(0)).count() == 0
    one = omh.fingerprint_edits(df.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert omh.fingerprints(df).count() == len(rows)
