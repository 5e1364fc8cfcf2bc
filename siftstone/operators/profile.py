"""Column profiles in one pass over an unpivoted table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.ArrayType,)):
        return "array"
    if isinstance(t, (T.StructType, T.MapType, T.VariantType)):
        return "object"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "number" if isinstance(t, T.NumericType) else "string"


def _values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(position, column, value, whole): every cell as text; the value of each row is counted before it is widened."""
    cells = []
    for i, c in enumerate(fields):
        t = df.schema[c].dataType
        text = F.to_json(F.col(f"`{c}`")) if isinstance(t, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) else F.col(f"`{c}`").cast("string")
        cells.append(F.struct(F.lit(i).alias("pos"), text.alias("value")))
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(pos, value, n)."""
    return _values(df, fields).groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, field: str | None = None) -> DataFrame:
    """One row a column: column, type, non_null, null_count, cardinality, uniqueness, avg_length, min_length,
    max_length (bytes as text). Everything follows from counts of distinct values, made partly before the shuffle."""
    fields = [field] if field else df.columns
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c, _kind(df.schema[c].dataType)) for i, c in enumerate(fields)], "pos int, column string, type string")
    size = F.octet_length("value")
    out = value_counts(df, fields).groupBy("pos").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("value").alias("cardinality"),
        F.sum(size * F.col("n")).alias("bytes"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
    )
    out = F.broadcast(names).join(out, "pos", "left")  # one row a column
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, F.round(F.col(a) / F.col(b), 9)).otherwise(F.lit(0.0))
    return out.select("column", "type", zero("non_null"), zero("null_count"), zero("cardinality"), ratio("cardinality", "non_null").alias("uniqueness"), ratio("bytes", "non_null").alias("avg_length"), zero("min_length"), zero("max_length"))


def type_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(column, type, n): the types of a column's values, most first; many in a variant column, else the declared one."""
    parts = []
    for c in fields:
        t, v = df.schema[c].dataType, F.col(f"`{c}`")
        kind = F.lit(_kind(t))
        if isinstance(t, T.VariantType):
            own = F.schema_of_variant(v)
            kind = F.when(own.startswith("ARRAY"), "array").when(own.startswith("OBJECT"), "object").when(own == "BOOLEAN", "bool").when(own == "VOID", "null").when(own == "STRING", "string").otherwise("number")
        parts.append(F.struct(F.lit(c).alias("column"), F.when(v.isNotNull(), kind).alias("type")))
    cells = df.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("type IS NOT NULL")
    return cells.groupBy("column", "type").agg(F.count(F.lit(1)).alias("n")).orderBy("column", F.desc("n"), "type")


def top_values(df: DataFrame, field: str | None = None, count: int = 5) -> DataFrame:
    """(column, rank, value, n): the most frequent values, ties by value."""
    fields = [field] if field else df.columns
    w = Window.partitionBy("pos").orderBy(F.col("n").desc(), "value")
    names = df.sparkSession.createDataFrame(list(enumerate(fields)), "pos int, column string")
    top = value_counts(df, fields).where("value IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
    return top.join(F.broadcast(names), "pos").select("column", "rank", "value", "n")


def report(df: DataFrame, field: str | None = None) -> dict:
    """The nested report."""
    fields = [field] if field else df.columns
    total = df.count()
    if not total:
        return {"total_rows": 0, "columns": [], "fields": {}}
    out = {r["column"]: r.asDict() for r in profile(df, field).collect()}
    for v in out.values():
        v["types"], v["top_values"] = [], []
        v.pop("type")
        v.pop("column")
    for r in type_counts(df, fields).collect():
        out[r["column"]]["types"].append({"type": r.type, "count": r.n})
    for r in top_values(df, field).orderBy("column", "rank").collect():
        out[r["column"]]["top_values"].append({"value": r.value, "count": r.n})
    return {"total_rows": total, "columns": fields, "num_columns": len(fields), "fields": out}
