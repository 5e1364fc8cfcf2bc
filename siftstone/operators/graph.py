"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the session's ``spark.checkpoint.dir`` and read back: the lineage ends at files that every
    executor can reach. Where that is unset, a private folder is made on a local master; a cluster must name one."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = tempfile.mkdtemp(prefix="siftstone-")
    path = f"{root.rstrip('/')}/siftstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``saved`` table that nothing will read again."""
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(df._saved_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge; label is the least node of its component.

    Each round takes the least label among a node's neighbours, then jumps to that label's own
    label, so the number of rounds grows with the logarithm of the longest chain. No group is
    gathered: neighbours are only counted into a minimum, partly before the shuffle.
    """
    both = saved(edges.select(F.col(a).alias("node"), F.col(b).alias("near")).union(edges.select(F.col(b), F.col(a))).distinct())
    held = saved(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label")))
    labels = held
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("other")), "near").groupBy("node").agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select("node", F.least("label", "other").alias("new"), "label")
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = saved(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        moved = step.where("new <> label").limit(1).count()
        forget(held)
        held, labels = step, step.select("node", F.col("new").alias("label"))
        if not moved:
            forget(both)
            return labels
