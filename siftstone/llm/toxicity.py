"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, with features word, beginnings of 4 and 6 bytes and ending of 5
bytes, in lower case. The field has two states. It is fitted on at most ``SAMPLE`` labelled
documents a class (those of the smallest hashes; of a repeated doc_id the least text): features that tell
toxic from clean documents beyond chance (G test) label the tokens of toxic documents, the field learns these
labels by gradient ascent on its conditional likelihood, and a logistic regression on a document's
marginals, weighted back to the classes' true sizes, learns its score. Near copies within a class share the
weight of one document in the test and in the field, so that what they share isn't taken for a sign; none is dropped.
Features of fewer than ``LEAST`` documents have no weight.

Scoring is one pass without a shuffle. With two states, forward and backward messages are ratios,
so all texts of a slice advance together, one token a step. Texts of more than ``PIECE`` tokens advance in pieces
that are composed first and entered then, which gives the messages of the whole chain. A span is a run of tokens
whose marginal is at least 1/2; offsets are code points.

Null and empty texts have the score of a text without tokens. Without labels of both classes
every text has the share of toxic labels (0 if there are none). Empty tables give no rows; further columns are left alone.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, flat, mix, prefix_sums, ranges_hash, released, text_array
from .langid import held_out

SAMPLE = 2500
STEPS, RATE, G_LEAST, LEAST, L2 = 40, 0.5, 25.0, 3, 1e-4
PIECE = 256
SLICE, SCORED = 100_000, 1 << 20  # tokens of the fit, bytes of scored texts at a time
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
for _c in range(65, 91):
    _LETTER[_c] = _LETTER[_c + 32] = True
    _LOWER[_c] = _c + 32


def tokens(data: np.ndarray, off: np.ndarray):
    """(features (4, tokens), byte starts, ends, first token of each text)."""
    solid = _LETTER[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    there = off[:-1] < off[1:]
    at = off[:-1][there]
    first[at] = solid[at]
    at = off[1:][there] - 1
    last[at] = solid[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = prefix_sums(_LOWER[data])
    h = [ranges_hash(data, s, e, total), ranges_hash(data, s, np.minimum(e, s + 4), total), ranges_hash(data, s, np.minimum(e, s + 6), total), ranges_hash(data, np.maximum(s, e - 5), e, total)]
    return np.stack([x ^ U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k, x in enumerate(h)]), s, e, np.searchsorted(s, off)


def _ragged(first: np.ndarray):
    """Places of tokens when all texts, longest first, advance together: (place of each token, begin of each step,
    texts in that order)."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    longest = int(n.max(initial=0))
    active = len(n) - np.searchsorted(np.sort(n), np.arange(longest), "right")
    begin = np.concatenate([[0], np.cumsum(active)])
    doc = np.repeat(np.arange(len(n)), n)
    return begin[np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], n)] + rank[doc], begin, order


def _composed(w: np.ndarray, cuts: np.ndarray, opens: np.ndarray, trans: np.ndarray):
    """For each piece the product of its steps, which takes the two states' weights before it to those at its last token, up
    to a factor; of a piece that opens a text the first column alone counts."""
    a, b, c, d = np.exp(trans).ravel()
    n = np.diff(cuts)
    order = np.argsort(-n, kind="stable")
    start, size, opens = cuts[:-1][order], n[order], opens[order]
    own = w[start]
    m = [np.where(opens, 1.0, a), np.where(opens, 0.0, c), np.where(opens, own, own * b), np.where(opens, 0.0, own * d)]
    for k in range(1, int(size.max(initial=0))):
        go = int(np.searchsorted(-size, -k))
        own = w[start[:go] + k]
        p, q, r, t = (x[:go] for x in m)
        new = (a * p + c * r, a * q + c * t, own * (b * p + d * r), own * (b * q + d * t))
        most = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
        for x, y in zip(m, new):
            x[:go] = y / most
    out = np.empty((4, len(n)))
    out[:, order] = m
    return out


def messages(w: np.ndarray, first: np.ndarray, trans: np.ndarray):
    """Forward and backward ratios (state 1 over state 0) of every token, from its emission ratio w."""
    n = np.diff(first)
    if n.max(initial=0) <= PIECE:
        return _advance(w, first, trans, np.ones(len(n)), np.ones(len(n)))
    a, b, c, d = np.exp(trans).ravel()
    count = -(-n // PIECE)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    cuts = np.append(first[:-1][doc] + nth * PIECE, first[-1])
    before, after = np.ones(len(doc)), np.ones(len(doc))
    long = np.flatnonzero(count[doc] > 1)
    ends = np.minimum(cuts[:-1][long] + PIECE, first[1:][doc[long]])
    own = np.concatenate([np.arange(i, j) for i, j in zip(cuts[:-1][long], ends)])
    m = np.zeros((4, len(doc)))
    m[:, long] = _composed(w[own], np.concatenate([[0], np.cumsum(ends - cuts[:-1][long])]), nth[long] == 0, trans)
    ratio = np.zeros(len(doc))
    for k in range(int(count.max())):
        at = long[nth[long] == k]
        if k:
            ratio[at] = (m[2, at] + m[3, at] * ratio[at - 1]) / (m[0, at] + m[1, at] * ratio[at - 1])
            before[at] = (b + d * ratio[at - 1]) / (a + c * ratio[at - 1])
        else:
            ratio[at] = m[2, at] / m[0, at]
    for k in range(int(count.max()) - 1, 0, -1):
        at = long[nth[long] == k]
        after[at - 1] = (m[1, at] + m[3, at] * after[at]) / (m[0, at] + m[2, at] * after[at])
    return _advance(w, cuts, trans, before, after)


def _advance(w, first, trans, before, after):
    """Messages within texts, from the factor of the message into each and the message back into its last token."""
    place, begin, order = _ragged(first)
    (a, b), (c, d) = np.exp(trans)
    x = np.empty(len(w))
    x[place] = w
    fwd, bwd = np.empty_like(x), np.ones_like(x)
    there = first[:-1] < first[1:]
    bwd[place[first[1:][there] - 1]] = after[there]
    steps = begin.tolist()
    r = None
    for lo, hi in zip(steps, steps[1:]):
        own = x[lo:hi]
        if r is None:
            r = own * before[order[: hi - lo]]
        else:
            r = r[: hi - lo]
            r = own * ((b + d * r) / (a + c * r))
        fwd[lo:hi] = r
    for lo, mid, hi in zip(steps[-3::-1], steps[-2::-1], steps[:0:-1]):
        n = hi - mid
        q = x[mid:hi] * bwd[mid:hi]
        bwd[lo : lo + n] = (c + d * q) / (a + b * q)
    return fwd[place], bwd[place]


def _slots(keys: np.ndarray, weights: np.ndarray):
    """A table of a power of two places, at most a quarter full: a key is at its low bits or, if that place is
    another's, at the next free one. 0 is no key."""
    size = 4
    while size < 4 * len(keys):
        size *= 2
    table, values = np.zeros(size, U64), np.zeros(size)
    at, left = (keys & U64(size - 1)).astype(np.int64), np.arange(len(keys))
    while len(left):
        own, who = np.unique(at[left], return_index=True)
        free = table[own] == 0
        own, who = own[free], left[who[free]]
        table[own], values[own] = keys[who], weights[who]
        left = left[table[at[left]] != keys[left]]
        at[left] = at[left] + 1 & size - 1
    return table, values


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(4, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = -5.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0, 0.0]))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        wanted, last = features.ravel(), len(self.keys) - 1
        at = (wanted & U64(last)).astype(np.int64)
        have = self.keys[at]
        s = np.where(have == wanted, self.weights[at], 0.0)
        go = np.flatnonzero((have != wanted) & (have != 0))
        while len(go):  # the place is another key's
            at[go] = at[go] + 1 & last
            have = self.keys[at[go]]
            hit = have == wanted[go]
            s[go[hit]] = self.weights[at[go[hit]]]
            go = go[~hit & (have != 0)]
        return np.exp(np.clip(s.reshape(features.shape).sum(0) + self.bias, -30, 30))

    def marginals(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        f, b = messages(self.emissions(features), first, self.trans)
        return f * b / (1 + f * b)

    def document(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = _summary(p, first) @ self.score
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1, log-odds of the largest marginal, log of the expected number of toxic tokens."""
    n = len(first) - 1
    out = np.ones((n, 3))
    top, total = np.zeros(n), np.zeros(n)
    there = first[:-1] < first[1:]
    if there.any():
        top[there] = np.maximum.reduceat(p, first[:-1][there])
        total[there] = np.add.reduceat(p, first[:-1][there])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    out[:, 1], out[:, 2] = np.log(top / (1 - top)), np.log1p(total)
    return out


def _g(a, b, na, nb):
    """G statistic of a feature in a of na and b of nb documents."""
    n = a + b
    ea, eb = n * na / (na + nb), n * nb / (na + nb)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(a > 0, a * np.log(a / ea), 0) + np.where(b > 0, b * np.log(b / eb), 0))


def _shares(words: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each text 1 over the number of its near copies of its class, itself included: texts are joined that have half of
    16 minimal hashes of five-token runs in common, among those that agree in a band of four."""
    n = np.diff(first)
    run = np.zeros(len(words), U64)
    for k in range(5):  # runs end with their text
        at = np.minimum(np.arange(len(words)) + k, np.repeat(first[1:] - 1, n))
        run = (run ^ words[at]) * U64(0x9E3779B97F4A7C15) + U64(k)
    there = np.flatnonzero(n)
    out = np.ones(len(n))
    if not len(there):
        return out
    least = np.stack([np.minimum.reduceat(mix(run + U64(k)), first[:-1][there]) for k in range(16)])
    parent = list(range(len(there)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k in range(0, 16, 4):
        band = y[there].astype(U64)
        for row in least[k : k + 4]:
            band = mix(band * U64(0x9E3779B97F4A7C15) + row)
        _, hub, back = np.unique(band, return_index=True, return_inverse=True)
        hub = hub[back]
        alike = (hub != np.arange(len(hub))) & ((least == least[:, hub]).mean(0) >= 0.5)
        for i in np.flatnonzero(alike).tolist():
            i, j = find(i), find(int(hub[i]))
            parent[max(i, j)] = min(i, j)
    root = np.array([find(i) for i in range(len(there))])
    out[there] = 1 / np.bincount(root, minlength=len(root))[root]
    return out


def fit(texts: list[str], toxic: list[int], weight: dict[int, float]) -> Model:
    """weight: of each document of a class, for its share in the score's fit."""
    y = np.asarray(toxic, bool)
    parts, first = [], [0]
    for i in range(0, len(texts), 200):
        own, _, _, begin = tokens(*flat(text_array(pa.array(texts[i : i + 200], pa.large_string()))))
        parts.append(list(own))
        first += (first[-1] + begin[1:]).tolist()
    first, kinds = np.array(first), len(parts[0])
    share = _shares(np.concatenate([p[0] for p in parts]), first, y)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    # kinds of features one by one, for memory
    keys, at, a, b = [], [], [], []
    for j in range(kinds):
        own, place = np.unique(np.concatenate([p[j] for p in parts]), return_inverse=True)
        for p in parts:
            p[j] = None
        d, k = np.divmod(np.unique(doc * np.int64(max(len(own), 1)) + place), max(len(own), 1))
        a.append(np.bincount(k[y[d]], share[d[y[d]]], minlength=len(own)))
        b.append(np.bincount(k[~y[d]], share[d[~y[d]]], minlength=len(own)))
        at.append((place + sum(map(len, keys))).astype(np.int32))
        keys.append(own)
        del place, d, k
    keys, a, b = np.concatenate(keys), np.concatenate(a), np.concatenate(b)
    na, nb = share[y].sum(), share[~y].sum()
    telling = (_g(a, b, na, nb) >= G_LEAST) & (a * nb > 9 * b * na)
    tag = np.any([telling[x] for x in at], axis=0) & y[doc]
    used = a + b > LEAST - 1e-6
    w, bias, trans = np.zeros(int(used.sum())), -5.0, np.zeros((2, 2))
    to = np.where(used, np.cumsum(used) - 1, len(w)).astype(np.int32)  # len(w): none
    for j in range(kinds):
        at[j] = to[at[j]]
    del doc

    def slices():
        """(tokens from, to, first tokens, the weight of each) of runs of texts, for memory."""
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(first, first[i] + SLICE, "right")) - 1)
            yield first[i], first[j], first[i : j + 1] - first[i], np.repeat(share[i:j], np.diff(first[i : j + 1]))
            i = j

    def summed(v, lo, hi):
        return sum(np.bincount(x[lo:hi], v, len(w) + 1) for x in at)[:-1]

    def emissions(lo, hi):
        padded = np.append(w, 0.0)
        return np.exp(np.clip(sum(padded[x[lo:hi]] for x in at) + bias, -30, 30))

    def before(own):
        """Tokens that have a next one."""
        inner = np.ones(own[-1], bool)
        inner[own[:-1][np.diff(own) > 0]] = False
        return np.flatnonzero(inner) - 1

    seen_w, seen_bias, seen_trans = np.zeros(len(w)), 0.0, np.zeros((2, 2))
    for lo, hi, own, part in slices():
        t, prev = tag[lo:hi].astype(int), before(own)
        seen_w += summed(t * part, lo, hi)
        seen_bias += (t * part).sum()
        np.add.at(seen_trans, (t[prev], t[prev + 1]), part[prev])
    gw, gb, gt = np.full(len(w), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    size = float(share @ np.diff(first))
    for _ in range(STEPS if len(tag) else 0):
        t = np.exp(trans)
        dw, db, dt = seen_w - L2 * size / max(len(w), 1) * w, seen_bias, seen_trans.copy()
        for lo, hi, own, part in slices():
            e, prev = emissions(lo, hi), before(own)
            f, q = messages(e, own, trans)
            m = f * q / (1 + f * q) * part
            x = e[prev + 1] * q[prev + 1]
            joint = [np.full(len(prev), t[0, 0]), t[0, 1] * x, t[1, 0] * f[prev], t[1, 1] * f[prev] * x]
            z = part[prev] / (joint[0] + joint[1] + joint[2] + joint[3])
            dw -= summed(m, lo, hi)
            db -= m.sum()
            dt -= np.array([j @ z for j in joint]).reshape(2, 2)
        gw, gb, gt = gw + dw * dw, gb + db * db, gt + dt * dt
        w += RATE * dw / np.sqrt(gw)
        bias += RATE * db / np.sqrt(gb)
        trans += RATE * dt / np.sqrt(gt)
    model = Model(*_slots(keys[used], w), float(bias), trans)
    found = []
    for lo, hi, own, _ in slices():
        f, q = messages(emissions(lo, hi), own, trans)
        found.append(_summary(f * q / (1 + f * q), own))
    model.score = _logistic(np.concatenate(found), y.astype(float), np.array([weight[int(v)] for v in y]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Weighted, slightly shrunk, by Newton steps."""
    v = v / v.mean()
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (v * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(c))
        step = np.linalg.solve(h, x.T @ (v * (y - p)) - 1e-2 * c)
        c += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return c


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` documents of each class; labels: (doc_id, toxic)."""
    lab = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.where(~held_out(lab, 0, 5))
    count = {r.toxic: r["count"] for r in lab.groupBy("toxic").count().collect()}
    if len(count) < 2:
        share = 1.0 if 1 in count else 0.0
        return Model(score=np.array([100 * share - 50, 0.0, 0.0]))
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id"]
    picked = lab.where("toxic = 0").orderBy(*order).limit(sample).union(lab.where("toxic = 1").orderBy(*order).limit(sample))
    share = count[1] / (count[0] + count[1])

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        n = [sum(r[2] == k for r in rows) for k in (0, 1)]
        if all(n):
            model = fit([r[1] for r in rows], [r[2] for r in rows], {k: count[k] / n[k] for k in (0, 1)})
        else:  # labels of a class belong to no document
            model = Model(score=np.array([np.log(share / (1 - share)), 0.0, 0.0]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        released()

    # at most 2 * sample rows, fitted in one task to spare the driver
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else Model(score=np.array([np.log(share / (1 - share)), 0.0, 0.0]))


def _spans(p: np.ndarray, s, e, first, points, off) -> list[str]:
    """``start:end`` of every run of toxic tokens of each text, in code points."""
    out = [""] * (len(first) - 1)
    hot = np.flatnonzero(p >= 0.5)
    if not len(hot):
        return out
    doc = np.searchsorted(first, hot, "right") - 1
    new = np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(doc) > 0)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hot) - 1]])
    base = points[off[doc[new]]]
    found: dict[int, list[str]] = {}
    for d, i, j in zip(doc[new].tolist(), (points[s[hot[new]]] - base).tolist(), (points[e[hot[last]]] - base).tolist()):
        found.setdefault(d, []).append(f"{i}:{j}")
    for d, x in found.items():
        out[d] = ",".join(x)
    return out


def score_toxicity(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, score, predicted and spans (offending offsets) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the bounded sample's features, whatever the input

    def run(batches):
        model = shared.value
        for b, _, data, off in chunks(batches, "__text", SCORED):
            feats, s, e, first = tokens(data, off)
            p = model.marginals(feats, first) if len(s) else np.zeros(0)
            score = model.document(p, first)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(_spans(p, s, e, first, points, off))],
                [*keep, "score", "predicted", "spans"],
            )

    src = df.select(*keep, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kept}, score double, predicted int, spans string")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b, _, data, off in chunks(batches, text_col, SCORED):
            feats, _, _, first = tokens(data, off)
            p = model.marginals(feats, first) if first[-1] else np.zeros(0)
            yield b.filter(pa.array(model.document(p, first) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of all documents."""
    marked = docs.select("doc_id", "text", held_out(docs, 0, 5).alias("held_out"))
    return score_toxicity(marked, train(docs, labels), ["doc_id", "held_out"])
