from pyspark.sql import functions as F

from siftstone.operators import corpus, sample


def test_positions_of_a_sorted_table_and_of_repeated_keys(spark):
    key = (F.col("id") * 7919 % 100_000).alias("k")
    df = spark.range(300_000).select(key, F.concat(F.lit("n"), (F.col("id") * 31 % 7).cast("string")).alias("x")).repartition(9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = corpus.with_row_index(df.orderBy("k"), "at").selectExpr("count(distinct at) n", "max(at) m", "sum(cast(at div 3 <> k as int)) wrong").first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert (ranked.n, ranked.m, ranked.wrong) == (300_000, 299_999, 0)
    rows = sorted((r.k, r.x) for r in df.collect())
    got = sorted((r.k, r.x) for r in sample.sample(df, 50, "reservoir", id_col="k", dense=False).collect())
    assert got == [rows[i] for i in sample.reservoir_sample(300_000, 50)]
