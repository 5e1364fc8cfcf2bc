import pytest

from siftstone.llm import mixing


def water(sizes, weights, share=1.5, cap=2):
    """Rounds of resharing, as the definition has it."""
    target, left, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        w = sum(weights[i] for i in free)
        give = {i: left * weights[i] / w for i in free}
        over = {i for i in free if give[i] > cap * sizes[i]}
        if not over:
            for i in free:
                target[i] = give[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        free -= over
    return target


@pytest.mark.parametrize("hot", [1, 40])
def test_targets_and_taken(spark, hot):
    rows = []
    for s in ["a", "b", "c", "d", "", None]:
        for i in range(60 * (hot if s == "b" else 1)):
            rows.append((len(rows), " word" * (1 + i % 7) + "\t", s, "x"))
    rows += [(None, None, "a", "x"), (5, "", "a", "x"), (5, "", "a", "x"), (6, "w " * 3000, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    src = {}
    for (_, t, s, _) in rows:
        src[s] = src.get(s, 0) + len((t or "").split())
    order = sorted(src, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water([src[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_size.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sorted(t for _, t in by_size) == pytest.approx(sorted(set(want.values())))
    for (size, target), taken in by_size.items():
        n = sum(1 for s in src if src[s] == size and want[s] == pytest.approx(target))
        assert abs(sum(taken) - n * target) <= n
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_positions_follow_the_schedule(spark):
    rows = [(i, "a b c", f"s{i % 3}") for i in range(900)]
    c = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    p = [r.position for r in c]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1
    early = [r for r in c if r.position < 0.5]
    share = lambda rs, k: sum(r.words for r in rs if r.doc_id % 3 == k) / sum(r.words for r in rs)
    assert share(early, 0) > share(c, 0) + 0.03  # drift +0.5
    assert share(early, 2) < share(c, 2) - 0.01  # drift -0.5


def test_taken_rows_and_sequences_follow_the_curriculum(spark, tmp_path):
    from siftstone.llm import packing

    df = spark.createDataFrame([(i, f"a b c w{i}", f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string").repartition(5)
    want = [r.doc_id for r in mixing.curriculum(df).collect()]
    mixing.take(df).write.option("maxRecordsPerFile", 150).parquet(str(tmp_path / "mix"))
    packed = packing.pack(spark.read.parquet(str(tmp_path / "mix")), with_ids=False, in_file_order=True).collect()
    assert len({r.sequence_id for r in packed}) == len(packed)
    for n in {r.length for r in packed}:
        rows = sorted((r for r in packed if r.length == n), key=lambda r: r.sequence_id)
        left = iter(want)
        assert len(rows) > 1 and all(r.doc_id in left for r in rows)  # a subsequence of the order
    assert [r.doc_id for r in mixing.take(df).collect()] == want


def test_place_in_the_stream(spark):
    """A copy's place is the share of all words before it, up to a document a source."""
    rows = [(i, "a b c", f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r for r in mixing.mix(df).collect() if r.position is not None), key=lambda r: r.position)
    c = mixing.curriculum(df).collect()
    total, before, at = sum(r.words for r in c), {}, 0
    for r in c:
        before.setdefault(r.doc_id, at)
        at += r.words
    assert [r.place for r in got] == sorted(r.place for r in got)
    assert max(abs(r.place - before[r.doc_id] / total) for r in got) < 0.01


def test_hot_ids(spark):
    """A third of the rows without an id; alike ones too."""
    rows = [(i, "a b c " * (i % 5), f"s{i % 3}") for i in range(600)] + [(None, "x y", "s0")] * 200 + [(None, "z " * (i % 4), None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    m = mixing.mix(df).collect()
    assert len(m) == len(rows)
    taken = mixing.take(df).collect()
    assert sum(len(r.text.split()) for r in taken) == sum(r.taken for r in m)
    assert sum(len(r.text.split()) for r in taken if r.doc_id is None) == sum(r.taken for r in m if r.doc_id is None)


def test_query_is_in_training_order(spark, tmp_path):
    rows = [(i, "a b c " * (i % 5), f"s{i % 3}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.position is not None, r.position) for r in mixing.op9(spark, str(tmp_path)).collect()]
    assert got == sorted(got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    df = spark.createDataFrame([(1, None, None)], df.schema)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)]
