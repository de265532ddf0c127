import random

from corpusloom.operators.graph import connected_components
from corpusloom.runtime import Scratch


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def got(spark, edges, kind="long"):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    groups = {}
    for r in connected_components(df, Scratch(spark, "test")).collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    return {frozenset(g) for g in groups.values()}


def test_random_graph_chain_star_and_dirt(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(1000, 1060)]  # a chain
    edges += [(0, i) for i in range(1, 40)]  # a hub
    edges += [(rng.randrange(2000, 2150), rng.randrange(2000, 2150)) for _ in range(90)]
    edges += [(5000, 5000), (None, 3), (7, None), (0, 1), (1, 0)]
    assert got(spark, edges) == brute(edges)


def test_strings_and_empty(spark):
    edges = [("a", "b"), ("c", "b"), ("x", "y")]
    assert got(spark, edges, "string") == {frozenset("abc"), frozenset("xy")}
    assert got(spark, []) == set()
