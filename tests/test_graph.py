import random

from siftstone.operators.graph import components


def test_components_equal_union_find(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (5, 5)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
