import random

from veilframe.operators.components import connected_components


def test_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None)]
    edges += edges[:20]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {row.node: row.component for row in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
