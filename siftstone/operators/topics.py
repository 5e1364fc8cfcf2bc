"""Topics by non-negative matrix factorisation with multiplicative updates."""

from __future__ import annotations

import tempfile
from base64 import b64decode, b64encode

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import term_counts
from .corpus import idf, with_row_index
from .graph import saved

#: NONZEROS: at most so many weights (16 bytes each) are factorised on the driver
EPS, NONZEROS = 1e-10, 5_000_000


def start(i: np.ndarray, width: int) -> np.ndarray:
    """Row i of the first factors."""
    return 0.1 + 0.01 * ((i[:, None] * width + np.arange(width)) % 100) / 100.0


def nmf(v: np.ndarray, k: int, iterations: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(rows x k, k x terms); W (H Ht) stands for (W H) Ht, so nothing of V's size is built."""
    w, h = start(np.arange(v.shape[0]), k), start(np.arange(k), v.shape[1])
    for _ in range(iterations):
        h *= (w.T @ v) / (w.T @ w @ h + EPS)
        w *= (v @ h.T) / (w @ (h @ h.T) + EPS)
    return w, h


def nmf_sparse(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, m: int, k: int, iterations: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The same of a matrix of n rows and m columns given by its cells."""
    w, h = start(np.arange(n), k), start(np.arange(k), m)
    for _ in range(iterations):
        wv = np.stack([np.bincount(col, w[row, t] * value, m) for t in range(k)])
        h *= wv / (w.T @ w @ h + EPS)
        vh = np.stack([np.bincount(row, h[t, col] * value, n) for t in range(k)], 1)
        w *= vh / (w @ (h @ h.T) + EPS)
    return w, h


class _Rows:
    """Sparse rows in local files, read a slice at a time, and their factors; memory follows the number of rows alone."""

    def __init__(self, k: int, width: int):
        self.k, self.width, self.slices, self.pos = k, width, [], []
        self.at, self.v = tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def add(self, pos: np.ndarray, size: np.ndarray, at: np.ndarray, v: np.ndarray) -> None:
        at.astype(np.int32).tofile(self.at)
        v.astype(np.float64).tofile(self.v)
        self.pos.append(pos)
        self.slices.append([size, start(pos, self.k)])

    def sums(self, h: np.ndarray | None = None) -> np.ndarray:
        """Cells of W V and of W W, after a step of W with h if it is given."""
        k, width = self.k, self.width
        wv, ww = np.zeros((k, width)), np.zeros((k, k))
        self.at.seek(0), self.v.seek(0)
        for own in self.slices:
            row, w = np.repeat(np.arange(len(own[0])), own[0]), own[1]
            at, v = np.fromfile(self.at, np.int32, len(row)), np.fromfile(self.v, np.float64, len(row))
            if h is not None:
                vh = np.stack([np.bincount(row, h[t][at] * v, len(w)) for t in range(k)], 1)
                own[1] = w = w * (vh / (w @ (h @ h.T) + EPS))
            for t in range(k):
                wv[t] += np.bincount(at, w[:, t][row] * v, width)
            ww += w.T @ w
        return np.concatenate([wv.ravel(), ww.ravel()])


def _nmf_distributed(rows: DataFrame, k: int, width: int, iterations: int) -> tuple[DataFrame, np.ndarray]:
    """rows: (pos, at array<int>, v array<double>). One job of as many tasks as there are cores: each keeps its rows in local
    files and their W in memory, and in every round all tasks add up their sums, from which each takes the same H."""

    def run(batches):
        from pyspark import BarrierTaskContext

        every, own = BarrierTaskContext.get(), _Rows(k, width)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                at, v = b.column("at"), b.column("v")
                own.add(b.column("pos").to_numpy(), at.value_lengths().to_numpy(), at.flatten().to_numpy(), v.flatten().to_numpy())
        h = start(np.arange(k), width)
        for i in range(iterations + 1):
            flat = own.sums(h if i else None)
            if i == iterations:
                break
            flat = sum(np.frombuffer(b64decode(x)) for x in every.allGather(b64encode(flat.tobytes()).decode()))
            h = h * (flat[: k * width].reshape(k, width) / (flat[k * width :].reshape(k, k) @ h + EPS))
        if every.partitionId() == 0:  # H in rows before those of W
            yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(k)), pa.array(list(h), pa.list_(pa.float64()))], ["pos", "w"])
        for pos, (_, w) in zip(own.pos, own.slices):
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(list(w), pa.list_(pa.float64()))], ["pos", "w"])

    cores = rows.sparkSession.sparkContext.defaultParallelism
    found = saved(rows.repartition(cores, "pos").sortWithinPartitions("pos").mapInArrow(run, "pos long, w array<double>", barrier=True))
    h = np.array([r.w for r in sorted(found.where("pos < 0").collect(), key=lambda r: -r.pos)]).reshape(k, width)
    return found.where("pos >= 0"), h


def dominant(w: np.ndarray) -> np.ndarray:
    """The strongest topic of each row, the last of equal ones."""
    return w.shape[1] - 1 - w[:, ::-1].argmax(1)


def topics(df: DataFrame, field: str = "content", topics: int = 5, terms: int = 10, iterations: int = 200, vocab: int = 5000, id_col: str = "row_idx", dense: int = NONZEROS):
    """(topics, assignments): topics (id, label, size, terms) and (id_col, topic) of every row."""
    n = df.count()
    if not n:
        raise ValueError("No items")
    spark = df.sparkSession
    tf = saved(term_counts(df, id_col, field))
    words = [(i, r.term, r.df) for i, r in enumerate(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.col("df").desc(), "term").limit(vocab).collect())]
    place = spark.createDataFrame(words or [(0, "", 1)], "at int, term string, df long").withColumn("idf", idf(n, F.col("df")))
    words = [w for _, w, _ in words]
    # at most ``vocab`` rows are broadcast; the other terms' weights are never needed
    cells = saved(tf.join(F.broadcast(place), "term").select(id_col, "at", (F.col("tf") / F.col("dl") * F.col("idf")).alias("weight")))
    if cells.limit(dense + 1).count() <= dense and n <= max(dense, 0):
        ids = sorted(df.select(id_col).toArrow().column(0).to_pylist())
        found = cells.toArrow()
        row = {x: i for i, x in enumerate(ids)}
        where = np.array([row[x] for x in found.column(0).to_pylist()], np.int64)
        w, h = nmf_sparse(where, found.column(1).to_numpy().astype(np.int64), found.column(2).to_numpy(), n, len(words), topics, iterations)
        assigned = spark.createDataFrame(list(zip(ids, dominant(w).tolist())), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, topic int")
    else:
        ranked = saved(with_row_index(df.select(id_col).orderBy(id_col), "pos"))
        packed = cells.groupBy(id_col).agg(F.collect_list("at").alias("at"), F.collect_list("weight").alias("v"))
        rows = ranked.join(packed, id_col, "left").select("pos", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("v", F.array().cast("array<double>")).alias("v"))
        w, h = _nmf_distributed(rows, topics, len(words), iterations)
        best = F.array_max(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]
        assigned = ranked.join(w.select("pos", best.alias("topic")), "pos").select(id_col, "topic")
    sizes = {r.topic: r["count"] for r in assigned.groupBy("topic").count().collect()}
    out = []
    for t in range(topics):
        best = sorted(range(len(words)), key=lambda j: (-h[t, j], j))[:terms]
        out.append((t, ", ".join(words[j] for j in best[:3]), sizes.get(t, 0), [(words[j], float(h[t, j])) for j in best]))
    return spark.createDataFrame(out, "id int, label string, size long, terms array<struct<term:string,weight:double>>"), assigned


def report(df: DataFrame, field: str = "content", id_col: str = "row_idx", **params) -> dict:
    """The nested report of a result small enough for the driver."""
    found, assigned = topics(df, field, id_col=id_col, **params)
    rows = sorted((r[0], r.topic) for r in assigned.collect())
    out = []
    for t in found.orderBy("id").collect():
        out.append({"id": t.id, "label": t.label, "size": t.size, "terms": [{"term": x.term, "weight": x.weight} for x in t.terms], "members": [i for i, k in rows if k == t.id]})
    return {"num_topics": len(out), "num_items": len(rows), "topics": out, "assignments": [{"item": i, "topic": k} for i, k in rows]}
