"""N-gram Jaccard join by a MinHash LSH forest.

A text's set is that of its runs of three words (all its words if fewer). In each of ``TREES`` tries its label
is a sequence of ``DEPTH`` MinHash values of 16 bits. Labels are range-partitioned and sorted by trie and value,
so a trie's nodes are runs of labels with a common prefix, and a label's longest match is with a neighbour in
that order; labels that match no neighbour as far as the shortest prefix are left there.

Matched prefixes are then shortened level by level (``LEVELS``). Texts of one node of the deepest level are
joined as stars. Further up, a node is looked at only if it holds texts that aren't joined yet: those of
different groups are compared by the share of equal values in their signatures, and join if that is at most
``SLACK`` standard deviations below the threshold (chance meetings fall away here, so they connect nothing).
From what a level adds follows how many links are still unmet (``unmet``); shortening ends when that is within
the target recall, or at the prefix by which pairs at the threshold meet with the target probability.
Last, all pairs of a group are verified on their whole sets.

Equal texts are one class and are compared once. Nodes and groups are cut into blocks of hashed members,
every two blocks meeting in a task of their own, so none is gathered whole or capped, and pairs are
counted where they are found instead of being sent. Null is the empty text; texts without words link to
nothing (equal ones are one class). Repeated rows are copies; a class of null ids alone has a null id. An empty
table gives no rows; further columns of any name are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, forget, saved
from .common import U64, chunks, documents, mix, ranges_hash, word_hashes

N, THRESHOLD, RECALL, TREES, DEPTH, BLOCK = 3, 0.5, 0.999, 80, 6, 512
#: at most 512 members a block of a trie's node; standard deviations of the estimate that a pair may lack
NODE_BLOCK, SLACK = 256, 4.0
FILTER_BITS = 1 << 25


def meets(s: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair of Jaccard s shares a prefix of that length in some trie."""
    return 1 - (1 - s**depth) ** trees


def depth_for(threshold: float, recall: float, trees: int = TREES, deepest: int = DEPTH) -> int:
    """The longest prefix by which pairs at the threshold meet with that probability."""
    d = deepest
    while d > 1 and meets(threshold, d, trees) < recall:
        d -= 1
    return d


def unmet(new: int, before: int, depth: int, threshold: float, trees: int = TREES) -> float:
    """How many links are left, as far as can be told from ``new`` ones of a level whose prefixes are shorter
    than those of length ``before``: were all of them at the threshold, the links met at this level and
    those not met yet are in the proportion of these probabilities. Three more count as found, for chance."""
    a, b = meets(threshold, before, trees), meets(threshold, depth, trees)
    return (new + 3) * (1 - b) / (b - a)


def shingles(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs of every text, with repeats, and the first of each text."""
    h, first, _, _ = word_hashes(data, off)
    count = np.diff(first)
    runs = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(runs)])
    doc = np.repeat(np.arange(len(count)), runs)
    start = first[doc] + np.arange(begin[-1]) - begin[doc]
    return ranges_hash(h >> U64(1), start, np.minimum(start + n, first[doc + 1])), begin


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__key", F.unhex(F.md5(F.col("__text"))))


def _signatures(keyed: DataFrame, trees: int, n: int) -> DataFrame:
    """(h, low, high): the hash of each text's key, and the low and high bytes of its trees * DEPTH MinHash values of
    16 bits. A partition signs a text once; texts without words have no row."""
    seeds = mix(np.arange(1, trees * DEPTH + 1, dtype=U64)) | U64(1)

    def run(batches):
        seen: set[int] = set()
        for b, _, data, off in chunks(batches, "__text"):
            h, begin = shingles(data, off, n)
            keys = b.column(0).to_numpy()
            there = []
            for i in np.flatnonzero(np.diff(begin)).tolist():
                if (k := int(keys[i])) not in seen:
                    seen.add(k)
                    there.append(i)
            if not there:
                continue
            here = np.array(there)
            if len(here) < len(begin) - 1:  # the others' runs aren't hashed
                size = np.diff(begin)[here]
                cuts = np.concatenate([[0], np.cumsum(size)])
                h = h[np.arange(cuts[-1]) + np.repeat(begin[here] - cuts[:-1], size)]
                begin = cuts
            out = np.empty((len(here), len(seeds)), np.uint16)
            for k, seed in enumerate(seeds):
                out[:, k] = mix(np.minimum.reduceat(h * seed, begin[:-1])) >> U64(48)
            low, high = (out & 0xFF).astype(np.uint8), (out >> 8).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(keys[here]), *(_binary(x) for x in (low, high))], ["h", "low", "high"])

    return saved(keyed.select(F.xxhash64("__key").alias("h"), "__text").mapInArrow(run, "h long, low binary, high binary"))


def _binary(x: np.ndarray) -> pa.Array:
    """A row of bytes each."""
    off = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    """The bytes of rows of one length."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(len(column), -1)


_MASKS = [(-1 << 16 * (3 - d) if d < 3 else -1, -1 << 16 * (6 - d) & (1 << 48) - 1 if d > 3 else 0) for d in range(DEPTH + 1)]


def _common(a1, a2, b1, b2) -> np.ndarray:
    """How many values of two labels agree from the first on; -1 in different tries."""
    out = np.full(len(a1), -1, np.int8)
    for d, (m1, m2) in enumerate(_MASKS):
        out[((a1 ^ b1) & m1 | (a2 ^ b2) & m2) == 0] = d
    return out


def _tries(signatures: DataFrame, trees: int, shortest: int) -> DataFrame:
    """(k1, k2, h, match): the sorted labels that share a prefix of at least ``shortest`` values with a neighbour,
    and the length of the longest. k1 is the trie and three values, k2 the other three. The first and last label of a
    partition, whose neighbours are elsewhere, count as matched."""

    def labels(batches):
        tree = np.arange(trees, dtype=np.int64) << 48
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                v = _matrix(part.column(1)).astype(np.int64) | _matrix(part.column(2)).astype(np.int64) << 8
                v = v.reshape(len(v), trees, DEPTH)
                k1 = tree | v[:, :, 0] << 32 | v[:, :, 1] << 16 | v[:, :, 2]
                k2 = v[:, :, 3] << 32 | v[:, :, 4] << 16 | v[:, :, 5]
                yield pa.RecordBatch.from_arrays([pa.array(k1.ravel()), pa.array(k2.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), trees))], ["k1", "k2", "h"])

    def matched(batches):
        held, first = [np.zeros(0, np.int64)] * 3, True
        for b in batches:
            k1, k2, h = (np.concatenate([x, c.to_numpy()]) for x, c in zip(held, b.columns))
            fresh = np.ones(len(h), bool)  # copies from other partitions
            fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (h[1:] != h[:-1])
            k1, k2, h = k1[fresh], k2[fresh], h[fresh]
            if len(h) < 3:
                held = k1, k2, h
                continue
            near = _common(k1[1:], k2[1:], k1[:-1], k2[:-1])
            # all but the last two have both neighbours here; the last but one is kept to be compared with
            match = np.concatenate([[DEPTH if first else near[0]], np.maximum(near[:-1], near[1:])]).astype(np.int8)
            out = slice(0 if first else 1, len(h) - 1)
            own = np.flatnonzero(match[out] >= shortest) + out.start
            held, first = (k1[-2:], k2[-2:], h[-2:]), False
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (k1, k2, h, match)], ["k1", "k2", "h", "match"])
        last = held if first else [x[1:] for x in held]
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in last), pa.array(np.full(len(last[0]), DEPTH, np.int8))], ["k1", "k2", "h", "match"])

    rows = signatures.mapInArrow(labels, "k1 long, k2 long, h long")
    # by the key as well: a label that many texts have isn't one task's
    rows = rows.repartitionByRange("k1", "k2", "h").sortWithinPartitions("k1", "k2", "h")
    return saved(rows.mapInArrow(matched, "k1 long, k2 long, h long, match byte"))


def _nodes(tries: DataFrame, depth: int) -> DataFrame:
    m1, m2 = _MASKS[depth]
    return tries.where(F.col("match") >= depth).select(F.xxhash64(F.col("k1").bitwiseAND(F.lit(m1)), F.col("k2").bitwiseAND(F.lit(m2))).alias("node"), "h")


def _plausible(rows: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """(a, b): groups of which texts in one node have ``least`` equal values or more; as many as join the node's groups.
    rows: node, h, comp, count."""
    rows = rows.withColumn("blocks", F.ceil(F.col("count") / NODE_BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "h", "comp", "own")
    rows = rows.join(signatures.groupBy("h").agg(F.first("low").alias("low")), "h")
    rows = rows.repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi").select("node", "lo", "hi", "comp", "own", "low")

    def joined(node, lo, hi, comp, own, low):
        """Edges of whole nodes: rows are compared with the next, the next but one and so on."""
        ends = np.flatnonzero(np.concatenate([(node[1:] != node[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]])) + 1
        size = np.diff(ends, prepend=0)
        after = np.repeat(ends, size)
        parent: dict[int, int] = {}

        def find(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        edges = set()
        at = np.flatnonzero(np.arange(len(node)) + 1 < after)
        step = 1
        while len(at):
            i, j = at, at + step
            new = (comp[i] != comp[j]) & ((lo[i] == hi[i]) | (own[i] != own[j]))
            i, j = i[new], j[new]
            for k in range(0, len(i), 4096):
                x, y = i[k : k + 4096], j[k : k + 4096]
                near = (low[x] == low[y]).sum(1) >= least
                for p, q in zip(comp[x[near]].tolist(), comp[y[near]].tolist()):
                    p, q = find(p), find(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.add((min(p, q), max(p, q)))
            step += 1
            at = at[at + step < after[at]]
        return edges

    def run(batches):
        held, bytes_ = None, 0
        out: set = set()

        def parts(b):
            return [b.column(k).to_numpy() for k in range(5)] + [_matrix(b.column(5))]

        for b in batches:
            for i in range(0, b.num_rows, 4096):
                new = parts(b.slice(i, 4096))
                cols = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
                node, lo, hi = cols[:3]
                # the last node may go on
                cut = int(np.flatnonzero((node != node[-1]) | (lo != lo[-1]) | (hi != hi[-1])).max(initial=-1)) + 1
                if cut:
                    out |= joined(*(x[:cut] for x in cols))
                held = [x[cut:].copy() for x in cols]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in range(2)], ["a", "b"])
                out = set()
        if held is not None and len(held[0]):
            out |= joined(*held)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in range(2)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _groups(keys: DataFrame, keyed: DataFrame, threshold: float, recall: float, n: int, trees: int) -> DataFrame:
    """(key, group, count) of the texts that the forest joins with others; group is a number. keys: (key)."""
    shortest = depth_for(threshold, recall, trees)
    signatures = _signatures(keyed, trees, n)
    tries = _tries(signatures, trees, shortest)
    values = trees * DEPTH
    least = int(np.floor(values * (threshold - SLACK * (threshold * (1 - threshold) / values) ** 0.5)))
    # the deepest level: stars around a member, a row for each member however many pairs it has
    rows = _nodes(tries, DEPTH)
    hubs = rows.groupBy("node").agg(F.min("h").alias("hub"), F.max("h").alias("last")).where("hub < last").drop("last")
    edges = rows.join(hubs, "node").where("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct()
    group = saved(components(edges).select(F.col("node").alias("h"), F.col("label").alias("comp")))
    before = DEPTH
    for depth in range(DEPTH - 1, shortest - 1, -1):
        rows = _nodes(tries, depth).join(group, "h", "left").select("node", "h", F.coalesce("comp", "h").alias("comp"))
        busy = rows.groupBy("node").agg(F.min("comp").alias("one"), F.max("comp").alias("last"), F.count(F.lit(1)).alias("count")).where("one < last")
        edges = saved(_plausible(rows.join(busy.select("node", "count"), "node"), signatures, least))
        new = edges.count()
        if new:
            moved = components(edges).select(F.col("node").alias("comp"), F.col("label").alias("to"))
            # groups move as a whole; texts that had none are their own
            old = group.join(moved, "comp", "left").select("h", F.coalesce("to", "comp").alias("comp"))
            own = moved.join(group.select(F.col("h").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("h"), F.col("to").alias("comp"))
            last, group = group, saved(old.union(own))
            forget(last)
        forget(edges)
        if unmet(new, before, depth, threshold, trees) <= (1 - recall) * group.count():
            break
        before = depth
    last, group = group, group.withColumnRenamed("comp", "group")
    group = group.join(group.groupBy("group").count(), "group")
    group = saved(keys.select("key", F.xxhash64("key").alias("h")).join(group, "h").drop("h"))
    for used in (last, tries, signatures):
        forget(used)
    return group


def _bits(keys: pa.Array) -> np.ndarray:
    """Places of keys in the filter: two numbers of each."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)
    return (raw % U64(FILTER_BITS)).astype(np.int64)


def _filter(group: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys, of FILTER_BITS bits whatever their number: it spares most other texts a shuffle
    while it isn't full, and lets them pass beyond."""

    def run(batches):
        words = np.zeros(FILTER_BITS // 64, np.int64)
        for b in batches:
            at = _bits(b.column(0)).ravel()
            np.bitwise_or.at(words, at >> 6, np.int64(1) << (at & 63))
        own = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words[own])], ["word", "bits"])

    words = np.zeros(FILTER_BITS // 64, np.int64)
    found = group.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def _verified(group: DataFrame, keyed: DataFrame, threshold: float, n: int, pairs: bool) -> DataFrame:
    """Compares the whole sets of every two texts of a group, block by block, each two blocks in a task of
    their own. Gives (a, b, jaccard) of the links, or without ``pairs`` (key, n_links, root), which has a row for
    every linked text of a block and no pairs: its links there, and the root of its component there."""
    members = keyed.sparkSession.sparkContext.broadcast(_filter(group))  # FILTER_BITS / 8 bytes

    def sets(batches):
        words = members.value

        def chosen():
            for b in batches:
                at = _bits(b.column("key"))
                yield b.filter(pa.array(((words[at >> 6] >> (at & 63)) & 1).all(1)))

        for b, _, data, off in chunks(chosen(), "__text"):
            h, begin = shingles(data, off, n)
            sets = [np.unique(h[i:j]).tobytes() for i, j in zip(begin[:-1], begin[1:])]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sets, pa.binary())], ["key", "grams"])

    own = keyed.select(F.col("__key").alias("key"), "__text").mapInArrow(sets, "key binary, grams binary")
    own = own.groupBy("key").agg(F.first("grams").alias("grams"))
    m = own.join(group, "key").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    m = m.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "key"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "grams")

    def verify(rows):
        first, second = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        side = rows.column("own").to_numpy()
        keys = rows.column("key").to_pylist()
        sets = [np.frombuffer(g.as_buffer(), U64) for g in rows.column("grams")]
        size = np.array([len(g) for g in sets], np.float64)
        every, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        shared = times > 1  # the others meet nothing here
        doc, at = doc[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
        every = every[shared]
        order = np.argsort(at, kind="stable")
        at, doc = at[order], doc[order]
        same = np.zeros((len(sets), len(sets)), np.float64)
        for lo in range(0, len(every), 4096):
            i, j = np.searchsorted(at, (lo, lo + 4096))
            c = np.zeros((len(sets), min(4096, len(every) - lo)), np.float32)
            c[doc[i:j], at[i:j] - lo] = 1
            same += c @ c.T
        jac = same / (size[:, None] + size[None, :] - same)
        link = np.triu(jac >= threshold, 1)
        if first != second:
            link &= side[:, None] != side[None, :]
        x, y = np.nonzero(link)
        if pairs:
            out = [sorted((keys[i], keys[j])) + [float(jac[i, j])] for i, j in zip(x.tolist(), y.tolist())]
            kinds = (("a", pa.binary()), ("b", pa.binary()), ("jaccard", pa.float64()))
        else:
            parent = list(range(len(keys)))

            def find(i):
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            for i, j in zip(x.tolist(), y.tolist()):
                i, j = find(i), find(j)
                parent[max(i, j)] = min(i, j)
            count = (link.sum(0) + link.sum(1)).tolist()
            out = [(keys[i], k, keys[find(i)]) for i, k in enumerate(count) if k]
            kinds = (("key", pa.binary()), ("n_links", pa.int64()), ("root", pa.binary()))
        cols = zip(*out) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], [k for k, _ in kinds])

    schema = "a binary, b binary, jaccard double" if pairs else "key binary, n_links long, root binary"
    return saved(m.groupBy("group", "lo", "hi").applyInArrow(verify, schema))


def _texts(docs: DataFrame, id_col: str, text_col: str):
    """(key, id, copies) of every different text, and the rows with their texts and keys."""
    keyed = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t")
    return saved(keyed.groupBy(F.col("__key").alias("key")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))), keyed


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, trees: int = TREES):
    """(links, texts): links (a, b, jaccard) between keys of different texts, and texts (key, id, copies),
    one row per distinct text with its least id. Keys are the texts' MD5. Links are as many as the data
    have; ``classes`` counts them without making a row of each."""
    texts, keyed = _texts(docs, id_col, text_col)
    return _verified(_groups(texts, keyed, threshold, recall, n, trees), keyed, threshold, n, True), texts


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, trees: int = TREES) -> DataFrame:
    """One row per distinct text: (key, id, copies, n_links, class_key): the number of other texts linked
    to it, and the least key of the texts that links connect it with."""
    texts, keyed = _texts(docs, id_col, text_col)
    linked = _verified(_groups(texts, keyed, threshold, recall, n, trees), keyed, threshold, n, False)
    ends = linked.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    found = components(linked.where("key <> root").select(F.col("root").alias("a"), F.col("key").alias("b")).distinct())
    found = found.select(F.col("node").alias("key"), F.col("label").alias("class_key"))
    out = texts.join(ends.join(found, "key"), "key", "left")
    return out.select("key", "id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_key", "key").alias("class_key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, text_id, n_copies, n_links) of every document: the least doc_id among the
    documents that equality and links connect it with, and among those of equal text; how many
    documents have its text, and how many different texts are linked to it."""
    found = classes(docs)
    least = found.groupBy("class_key").agg(F.min("id").alias("class_id"))
    found = found.join(least, "class_key").select(F.col("key").alias("__key"), "class_id", F.col("id").alias("text_id"), F.col("copies").alias("n_copies"), "n_links")
    return _keyed(docs.select("doc_id", "text"), "text").select("doc_id", "__key").join(found, "__key").drop("__key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of every class: that of the least id (null last), then of the least key and row."""
    found = classes(docs, id_col, text_col, **how)
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")).select(F.col("best.key").alias("__key"))
    row = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("first"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    m = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(m.alias("__key"), row.alias("__row")).groupBy("__key").agg(F.min("__row").alias("__row"))
    return rows.join(best, "__key", "left_semi").select("__row.row.*")


def op4(spark, sf_dir):
    """Near duplicates among all documents."""
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT text, min(doc_id) AS id, count(*) AS copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs GROUP BY text),
grams AS (SELECT DISTINCT id, array_to_string(w[i:i + 2], ' ') AS g
          FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
same AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
links AS (SELECT a, b FROM same JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE k::DOUBLE / (p.n + q.n - k) >= 0.5),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM texts UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON r.other = e.a),
class AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n_links FROM both_ GROUP BY a)
SELECT d.doc_id, class_id, t.id AS text_id, t.copies AS n_copies, coalesce(n_links, 0) AS n_links
FROM docs d JOIN texts t USING (text) JOIN class c ON c.id = t.id LEFT JOIN degree g ON g.id = t.id
"""
