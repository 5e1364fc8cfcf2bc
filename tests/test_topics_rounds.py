import random

import numpy as np
from pyspark.sql import functions as F

from siftstone.operators import topics


def test_all_rounds_are_one_job(spark):
    r = random.Random(5)
    rows = [(p, sorted(r.sample(range(30), r.randrange(6)))) for p in range(3000)]
    rows = [(p, at, [r.random() for _ in at]) for p, at in rows]
    df = spark.createDataFrame(rows, "pos long, at array<int>, v array<double>")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    found, h = topics._nmf_distributed(df, 4, 30, 40)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before
    v = np.zeros((3000, 30))
    for p, at, x in rows:
        v[p, at] = x
    w, want = topics.nmf(v, 4, 40)
    assert np.allclose(h, want) and np.allclose([x.w for x in found.orderBy("pos").collect()], w)
    assert jobs < 10
