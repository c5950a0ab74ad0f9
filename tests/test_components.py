import random

from shelfmark.operators.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def run(spark, edges):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    return {r.node: r.component for r in components(df).collect()}


def test_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    assert run(spark, edges) == brute(edges)


def test_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)]
    assert run(spark, edges) == brute(edges)


def test_longer_path_and_ring(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000 + i, 1000 + (i + 1) % 300) for i in range(300)]
    assert run(spark, edges) == brute(edges)


def test_nulls_loops_and_nothing(spark):
    assert run(spark, [(1, None), (None, 2), (3, 3)]) == {}
    assert run(spark, []) == {}
