"""Mixing sources to target weights along a time-varying curriculum.

Sources, by code point with null last, weigh 5, 2, 1, repeating. Together they get ``share``
of all words; a source gets at most ``cap`` times its own, the excess going to the others by
weight (found at once from sorted ratios). Source s has the weight schedule
target_s * (1 + drift_s * (1 - 2 t)) over training time t in [0, 1]; its integral is the demand
for s until t. A source's documents are consumed in the order of a hash of their id, copy by
copy; a copy's position is the t at which the demand reaches the words consumed before it (a
quadratic, solved in closed form), its place the share of the whole mix that all sources' demands have
reached by then. The last copy a source takes may be cut to meet the target. Results are range-sorted by position.

Running sums within a source are kept in two levels, hash ranges and rows within a range, so no
source, however large, is gathered in one task; rows of one id and size are summed into one before, so
neither is a repeated or null id. Null text has no words; null ids and repeated rows are documents like any other,
tied by size; texts are counted whole; an empty table gives no rows and further columns of any name are kept by ``take``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved

WEIGHTS, SHARE, CAP, DRIFTS = (5, 2, 1), 1.5, 2, (0.5, 0.0, -0.5)
RANGE_BITS = 10
WORD = r"[^\x20\x09-\x0D]+"


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, drifts=DRIFTS) -> DataFrame:
    """(no_source, source, source_size, target, drift, total, tilt) from rows (source, size); total is the sum of all targets,
    tilt that of targets times drifts. One row per source is all that the windows without partitions see."""
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy("no_source", "source")
    by_ratio = one.orderBy("ratio", "no_source", "source")
    s = sizes.groupBy(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("drift", _cycle(drifts, F.col("rank")))
    s = s.withColumn("room", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("room") / F.col("weight"))
    s = s.withColumn("full", F.coalesce(F.sum("room").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(one) - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no_source", "source", "level"))).over(one)["level"]
    target = F.coalesce(F.least(F.col("room").cast("double"), F.col("weight") * level), F.col("room").cast("double"))
    s = s.select("no_source", "source", "source_size", target.alias("target"), "drift")
    return s.withColumn("total", F.sum("target").over(one)).withColumn("tilt", F.sum(F.col("target") * F.col("drift")).over(one))


_KEY = ["no_source", "source", "h", "id", "size"]
_BLOCK = 1 << 16


def _slim(df: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    """(no_source, source, h, id, size, ...), written once."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col)
    return saved(df.select(source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), h.alias("h"), F.col(id_col).alias("id"), size.alias("size"), *more))


def _consumed(rows: DataFrame, **how) -> DataFrame:
    """(_KEY, n, first, source_size, target, drift, total, tilt): for rows that are alike their number and the words
    that are consumed before the first of them."""
    alike = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.shiftright("h", 52 - RANGE_BITS))
    sums = rows.groupBy("no_source", "source", F.shiftright("h", 52 - RANGE_BITS).alias("bin")).agg(F.sum("size").alias("binned"))
    before = F.coalesce(F.sum("binned").over(Window.partitionBy("no_source", "source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(rows.select(F.when(~F.col("no_source"), F.col("source")).alias("source"), "size"), **how)
    sums = sums.withColumn("bins_before", before).drop("binned").join(targets, ["no_source", "source"])
    w = Window.partitionBy("no_source", "source", "bin").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.join(sums, ["no_source", "source", "bin"]).withColumn("first", F.col("bins_before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(w), F.lit(0)))
    return alike.drop("bin", "bins_before")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(id, source, size, source_size, target, taken, position, place) for every row; position and place are its first
    copy's, null if nothing is taken. For copies: before, drift, total, tilt."""
    rows = _consumed(_slim(df, id_col, text_col, source_col), **how)
    # rows that are alike are told apart by their number alone; many of them are spread by blocks
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _BLOCK)))).repartition("h", "id", "size", "block")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("block") * _BLOCK, F.least(F.col("n"), (F.col("block") + 1) * _BLOCK) - 1)))
    rows = rows.withColumn("before", F.col("first") + F.col("nth") * F.col("size")).withColumn("taken", words_of_copy(0) + words_of_copy(1))
    source = F.when(~F.col("no_source"), F.col("source")).alias("source")
    some = F.col("taken") > 0
    return rows.select(
        F.col("id").alias(id_col), source, "size", "source_size", "target", "taken", F.when(some, position(0)).alias("position"), F.when(some, place(position(0))).alias("place"), "before", "drift", "total", "tilt"
    )


def words_of_copy(copy: int) -> Column:
    left = F.floor(F.col("target") + 0.5) - F.lit(copy) * F.col("source_size") - F.col("before")
    return F.greatest(F.least(left, F.col("size")), F.lit(0)).cast("long")


def position(copy: int) -> Column:
    """The training time at which the source's demand reaches this copy."""
    u = (F.lit(copy) * F.col("source_size") + F.col("before")) / F.greatest(F.col("target"), F.lit(1.0))
    a = F.col("drift")
    p = 1 + a
    return F.when(a == 0, u).otherwise((p - F.sqrt(F.greatest(p * p - 4 * a * u, F.lit(0.0)))) / (2 * a))


def place(t: Column) -> Column:
    """The share of the mix that is consumed by then, all sources together."""
    return F.round((F.col("total") * t + F.col("tilt") * (t - t * t)) / F.greatest(F.col("total"), F.lit(1.0)), 9)


def curriculum(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: (id, copy, words, position), range-sorted by position."""
    m = mix(df, id_col, text_col, source_col, **how)
    copies = [F.struct(F.lit(c).alias("copy"), words_of_copy(c).alias("words"), position(c).alias("position")) for c in range(2)]
    c = m.select(id_col, F.explode(F.array(*copies)).alias("c")).select(id_col, "c.*").where("words > 0")
    return c.repartitionByRange(F.col("position"), F.col(id_col)).sortWithinPartitions("position", id_col)


def _addressed(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and row that each is read from, written first if they aren't files."""
    where = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        return docs.select("*", *where)
    except AnalysisException:
        return saved(docs).select("*", *where)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document once for each copy taken, the copy that
    the target cuts with its first words alone, range-sorted by the copies' positions. Rows of one id, source and size
    are consumed in the order of their files and rows."""
    own = _addressed(docs)
    slim = _slim(own, id_col, text_col, source_col, "__file", "__row")
    alike = _consumed(slim, **how)
    # the number among rows that are alike, by file first: no task has more of them than a file
    files = slim.groupBy(*_KEY, "__file").agg(F.count(F.lit(1)).alias("held"))
    above = Window.partitionBy(*_KEY).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("above", F.coalesce(F.sum("held").over(above), F.lit(0))).drop("held")
    files = files.join(alike, [files[c].eqNullSafe(alike[c]) for c in _KEY]).select(*(files[c] for c in _KEY), "__file", "above", "first", "source_size", "target", "drift")
    rows = slim.withColumn("nth", F.row_number().over(Window.partitionBy(*_KEY, "__file").orderBy("__row")) - 1)
    rows = rows.join(files, [rows[c].eqNullSafe(files[c]) for c in [*_KEY, "__file"]]).select(rows["__file"], rows["__row"], rows["size"], "nth", "above", "first", "source_size", "target", "drift")
    rows = rows.withColumn("before", F.col("first") + (F.col("above") + F.col("nth")) * F.col("size"))
    copies = F.filter(F.array(*[F.struct(words_of_copy(c).alias("words"), position(c).alias("position")) for c in range(2)]), lambda x: x["words"] > 0)
    rows = rows.select("__file", "__row", F.col("size").alias("__size"), copies.alias("__copies")).where(F.size("__copies") > 0)
    rows = own.join(rows, ["__file", "__row"]).withColumn("__c", F.explode("__copies"))
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns), "__size", F.col("__c.words").alias("__copy"), F.col("__c.position").alias("__position"))
    rows = rows.repartitionByRange(F.col("__position"), F.col(id_col)).sortWithinPartitions("__position", id_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), 1), 1, F.col("__copy").cast("int")), " ")
    text = F.when(F.col("__copy") == F.col("__size"), F.col(text_col)).otherwise(cut)
    return rows.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op9(spark, sf_dir):
    """All documents, mixed, in training order; those of which nothing is taken come first."""
    rows = mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position", "place")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


SQL = r"""
WITH docs AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS h
  FROM documents),
s1 AS (SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY ALL),
s2 AS (SELECT *, row_number() OVER (ORDER BY no_source, source) AS rank FROM s1),
s3 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
              CASE (rank - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS drift FROM s2),
s4 AS (SELECT *, source_size * 2 AS room, (source_size * 2)::DOUBLE / weight AS ratio FROM s3),
s5 AS (SELECT *, coalesce(sum(room) OVER (ORDER BY ratio, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_,
              sum(weight) OVER (ORDER BY ratio, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_,
              sum(source_size) OVER ()::DOUBLE AS all_ FROM s4),
s6 AS (SELECT *, (1.5::DOUBLE * all_ - full_) / open_ AS level FROM s5),
s7 AS (SELECT *, (SELECT level FROM s6 WHERE level <= ratio ORDER BY ratio, no_source, source LIMIT 1) AS found FROM s6),
src AS (SELECT no_source, source, source_size, drift, coalesce(least(room::DOUBLE, weight::DOUBLE * found), room::DOUBLE) AS target FROM s7),
whole AS (SELECT sum(target) AS total, sum(target * drift) AS tilt FROM src),
d AS (SELECT doc_id, size, source_size, target, drift,
             coalesce(sum(size) OVER (PARTITION BY no_source, source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_
      FROM docs JOIN src USING (no_source, source)),
t AS (SELECT *, CAST(greatest(least(floor(target + 0.5::DOUBLE)::BIGINT - before_, size), 0)
                 + greatest(least(floor(target + 0.5::DOUBLE)::BIGINT - source_size - before_, size), 0) AS BIGINT) AS taken,
             before_::DOUBLE / greatest(target, 1.0::DOUBLE) AS u FROM d),
p AS (SELECT *, CASE WHEN taken > 0 THEN CASE WHEN drift = 0 THEN u
         ELSE ((1 + drift) - sqrt(greatest((1 + drift) * (1 + drift) - 4 * drift * u, 0.0::DOUBLE))) / (2 * drift) END END AS position FROM t)
SELECT doc_id, size, source_size, target, taken, position, round((total * position + tilt * (position - position * position)) / greatest(total, 1.0::DOUBLE), 9) AS place
FROM p, whole
"""
