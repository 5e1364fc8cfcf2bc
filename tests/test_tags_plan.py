from siftstone.operators import corpus


def test_rows_are_not_sorted_for_their_tags(spark):
    df = spark.createDataFrame([(0, "rust code"), (1, None)], "row_idx long, content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corpus.tags(df, "content")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and sorted(found.collect())[1]._tags == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
