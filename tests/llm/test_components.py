import random

import pytest

from lodestack.llm.components import connected_components


def find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = find([e for e in edges if e[0] != e[1]])
    assert got == want


def test_odd_edges(spark):
    t = "src long, dst long"
    assert connected_components(spark.createDataFrame([], t)).count() == 0
    got = connected_components(spark.createDataFrame([(5, 5), (None, 3), (2, 1), (1, 2), (2, 1)], t)).collect()
    assert sorted(tuple(x) for x in got) == [(1, 1), (2, 1)]
