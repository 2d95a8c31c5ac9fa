import random

import pytest

from loamgrid.operators.components import connected_components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("chunk", [10, 100_000])
def test_components_equal_union_find(spark, chunk):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)] + [(5, 5), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), chunk=chunk).collect()
    assert {r["node"]: r["component"] for r in got} == brute(edges)
    assert len(got) == len({r["node"] for r in got})


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
