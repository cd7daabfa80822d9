import math
import random

import pytest

from lodestar.llm.graph import components, stars


def test_paths_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def _shuffled(n):
    order = list(range(n))
    random.Random(1).shuffle(order)
    return order


@pytest.mark.parametrize("order", [[0, *range(1023, 0, -1)], _shuffled(10_000)], ids=["adverse", "random"])
def test_rounds_grow_with_the_logarithm(spark, order):
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    found, rounds = stars(edges)
    assert rounds <= 2 * math.log2(len(order)) + 3
    assert sorted((r.a, r.b) for r in found.collect()) == [(i, 0) for i in range(1, len(order))]


def test_random_graphs(spark):
    r, edges = random.Random(4), []
    for base in range(0, 3000, 100):
        edges += [(base + r.randrange(100), base + r.randrange(100)) for _ in range(60)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
