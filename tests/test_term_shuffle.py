import random

import pytest

from siftstone.operators import corpus


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=r.choice((0, 1, 5, 150)))) + f" own{i}" * (i % 3)) for i in range(2000)]
    return spark.createDataFrame(rows + [(2000, "long" * 30), (2001, "long" * 30 + " w1"), (2002, None)], "row_idx long, content string")


def _moved(spark, run):
    """The result, and how many rows were written to shuffles for it."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def rows():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        x = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(x.apply(i).shuffleWriteRecords() for i in range(x.size()))

    before = rows()
    found = sorted(map(tuple, run().collect()))
    return found, rows() - before


RUNS = {
    "simhash": lambda docs: corpus.fingerprints(docs, weighted=True),
    "top_terms": lambda docs: corpus.top_terms(docs, "row_idx", "content"),
}


@pytest.fixture
def large(spark):
    """Tables are joined as if they were too large to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", RUNS)
def test_terms_of_rows_are_not_shuffled(spark, docs, large, name):
    pairs = corpus.term_counts(docs, "row_idx", "content").count()
    assert _moved(spark, lambda: RUNS[name](docs))[1] < pairs / 2


@pytest.mark.parametrize("name", RUNS)
def test_any_number_of_common_terms_gives_the_same(spark, docs, name, monkeypatch):
    every, _ = _moved(spark, lambda: RUNS[name](docs))
    for most in (0, 25):
        monkeypatch.setattr(corpus, "COMMON", most)
        assert _moved(spark, lambda: RUNS[name](docs))[0] == every
    rest = corpus.frequencies(docs, "row_idx", "content")[1].where("NOT common").count()
    assert rest > 200
