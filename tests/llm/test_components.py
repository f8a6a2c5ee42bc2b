"""Connected components against disjoint sets."""

import random

from lumigrid.llm.graph import Union, components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(220)] + [(500, 500)]
    sets = Union(600)
    for a, b in edges:
        sets.join(a, b)
    roots = sets.roots()
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: int(roots[x]) for e in edges for x in e}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
