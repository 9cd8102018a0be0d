import random

import pytest

from larder.llm.graph import connected_components


def want(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "odd"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 200)] + [(500, i) for i in range(501, 600)] + [(17, 555)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
        "odd": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5), (-7, 4)],
    }[kind]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == want(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
