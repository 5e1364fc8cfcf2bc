"""Stream forms of row-wise operations: exact-content and fingerprint deduplication, running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def drop_repeats(stream: DataFrame, field: str = "content", time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows whose terms, as a multiset, weren't seen within the watermark's delay."""
    key = F.xxhash64(F.array_sort(tokens(field)))
    return stream.withWatermark(time_col, delay).withColumn("__key", key).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def counts(stream: DataFrame, field: str, time_col: str = "ts", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, group, count) per tumbling window."""
    out = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), F.col(field).alias("group")).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("w.start").alias("start"), "group", "count")
