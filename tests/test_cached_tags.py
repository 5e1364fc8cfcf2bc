from siftstone.operators import cache


def test_rows_are_read_once_for_their_key(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(seen, "id long")
    kept = cache.Cache(str(tmp_path / "kept"), spark)
    kept.put(spark.range(1), "x", cache.content_hash(df), {}, 100)
    read.value = 0
    assert kept.cached(df, "x", {}, lambda d: d).count() == 1 and read.value == 100
