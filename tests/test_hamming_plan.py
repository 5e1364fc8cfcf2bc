from pyspark.sql import functions as F

from siftstone.operators import dedup


def test_hamming_keys_are_not_broadcast(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("fingerprint"))
    df = df.union(df.limit(50).select(F.col("fingerprint").bitwiseXOR(F.lit(5))))
    pairs = dedup.hamming_pairs(df)
    found = pairs.count()
    plan = pairs._jdf.queryExecution().executedPlan()
    assert found == 50 and "Broadcast" not in plan.toString()
