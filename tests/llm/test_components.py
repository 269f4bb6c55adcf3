"""Components of edge tables against a plain union, and what is left of dense groups' edges."""

import random

from tarn.llm.components import components, star


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(-400, 400), pick.randrange(-400, 400)) for _ in range(350)] + [(7, 7), (999, 999), (3, 4), (4, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == plain(edges)
    assert len(found) == len(plain(edges))


def test_a_dense_group_keeps_an_edge_a_node(spark):
    """A group of near copies, each linked with some chosen ones of its keys, came to every round with all its links."""
    pick = random.Random(7)
    chosen = pick.sample(range(2000), 25)
    edges = [(min(x, c), max(x, c)) for x in range(2000) for c in chosen if x != c]
    left = star(star(spark.createDataFrame(edges, "a long, b long"))).collect()
    assert len(left) < 2100 < len(set(edges)) / 20
    assert plain([tuple(r) for r in left]) == plain(edges)
