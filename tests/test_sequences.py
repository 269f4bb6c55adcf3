"""Operators that keep the order of a sequential run, against plain runs in that order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import clones, graph, history
from tarn.queries.graphs import supply_graph


def plain_communities(edges, nodes, rounds=30):
    near = {n: {} for n in nodes}
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    label = {n: n for n in nodes}
    order = sorted(nodes, key=lambda n: (-len(near[n]), n))
    for _ in range(rounds):
        moved = False
        for n in order:
            score = {}
            for m, w in near[n].items():
                score[label[m]] = score.get(label[m], 0) + w
            if score:
                best, most = label[n], score.get(label[n], -1)
                for other in sorted(score):
                    if score[other] > most + 1e-9:
                        best, most = other, score[other]
                moved, label[n] = moved or best != label[n], best
        if not moved:
            break
    size = {}
    for n in nodes:
        size[label[n]] = size.get(label[n], 0) + 1
    for n in sorted(nodes):
        if size[label[n]] == 1 and label[n] == n and near[n]:
            label[n] = label[min(near[n], key=lambda m: (-near[n][m], m))]
    return label


def test_communities_are_those_of_a_sequential_run(spark):
    pick = random.Random(11)
    for n, m in ((8, 9), (30, 45), (60, 80), (40, 200), (25, 12)):
        nodes = [f"n{i:02}" for i in range(n)]
        edges = [(pick.choice(nodes), pick.choice(nodes), pick.choice([0.5, 1.0, 1.25, 3.0])) for _ in range(m)]
        found = graph.communities(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(x,) for x in nodes], "id string"))
        assert {r["node"]: r["community"] for r in found.collect()} == plain_communities(edges, nodes)


def test_communities_of_the_tables(spark):
    edges, nodes = supply_graph(spark, "/root/testdata/sf0.01")
    found = {r["node"]: r["community"] for r in graph.communities(edges, nodes).collect()}
    assert found == plain_communities([tuple(r) for r in edges.collect()], [r["id"] for r in nodes.collect()])
    assert len(set(found.values())) > 1


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.communities(none).collect() == []
    assert [tuple(r) for r in graph.communities(none, spark.createDataFrame([("a",)], "id string")).collect()] == [("a", "a")]


def test_as_of_takes_the_last_value(spark):
    pick = random.Random(3)
    values = [(pick.choice(["hot", "hot", "hot", "b", None]), pick.randint(0, 200), pick.choice([None, 1, 2, 3, 4])) for _ in range(800)]
    asks = [(pick.choice(["hot", "hot", "b", "never", None]), pick.randint(-5, 210), i) for i in range(400)] * 2

    def last(item, at):
        known = [(o, v) for i, o, v in values if i == item and o <= at and v is not None]
        return max(known)[1] if known else None

    for slices in (1, 7, 64):
        found = history.as_of(spark.createDataFrame(values, "item string, i int, size int"), spark.createDataFrame(asks, "item string, i int, number int"), "item", "i", "size", slices=slices)
        assert sorted(map(str, ((r["item"], r["i"], r["number"], r["size"]) for r in found.collect()))) == sorted(map(str, ((*a, last(a[0], a[1])) for a in asks)))
    assert history.as_of(found.limit(0).select("item", "i", "size"), spark.createDataFrame(asks[:1], "item string, i int, number int"), "item", "i", "size").head()["size"] is None
    assert history.as_of(spark.createDataFrame(values, "item string, i int, size int"), spark.createDataFrame([], "item string, i int"), "item", "i", "size").collect() == []


def test_sizes_are_scaled_to_the_lines_of_today(spark):
    net = spark.createDataFrame([("a", 1, 10), ("a", 3, 40), ("a", 5, 20), ("z", 2, 5), ("z", 4, 0)], "item string, i int, size int")
    asks = spark.createDataFrame([(x, i) for x in ("a", "z", "new") for i in (0, 1, 3, 5)], "item string, i int")
    loc = spark.createDataFrame([("a", 100), ("new", 7)], "item string, loc int")
    found = {(r["item"], r["i"]): r["shown"] for r in history.sizes_at(net, asks, loc, "item", "i", "size").collect()}
    assert [found["a", i] for i in (0, 1, 3, 5)] == [0, 50, 100, 100] and found["new", 0] == 7 and [found["z", i] for i in (0, 3, 5)] == [0, 0, 0]


def test_overlapping_and_nested_ranges(spark):
    units = [(1, "f", 10, 20), (2, "f", 20, 30), (3, "f", 31, 40), (4, "g", 12, 18), (5, None, 1, 2)]
    table = spark.createDataFrame(units, "unit int, file string, start int, `end` int")
    pairs = spark.createDataFrame([(a[0], b[0], 0.9) for a in units for b in units if a[0] < b[0]], "a int, b int, sim double")
    assert {(r["a"], r["b"]) for r in clones.apart(pairs, table).collect()} == {(a, b) for a in range(1, 6) for b in range(a + 1, 6)} - {(1, 2)}


def test_members_in_longer_ones_go(spark):
    pick = random.Random(9)
    rows = [(g, n, pick.choice("fg"), s := pick.randint(1, 40), s + pick.randint(0, 15)) for g in range(12) for n in range(pick.choice([2, 5, 20, 61]))]
    table = spark.createDataFrame(rows, "`group` int, unit int, file string, start int, `end` int")
    kept = []
    for g in range(12):
        own = [r for r in rows if r[0] == g]
        left = own if len(own) > clones.MANY else [r for r in own if not any(x[2] == r[2] and x[3] <= r[3] and x[4] >= r[4] and x[4] - x[3] > r[4] - r[3] for x in own)]
        kept += left if len(left) > 1 else []
    members = clones.outermost(table)
    assert sorted(tuple(r[c] for c in ("group", "unit", "file", "start", "end")) for r in members.collect()) == sorted(kept)
    groups = spark.createDataFrame([(g, "costosa" if g == 3 else "latente", g * 10) for g in range(12)], "`group` int, sev string, score int")
    found = {r["file"]: r for r in clones.duplicated(members, groups, spark.createDataFrame([("f", 200), ("g", 5)], "file string, loc int")).collect()}
    for file, loc in (("f", 200), ("g", 5)):
        own = [r for r in kept if r[2] == file]
        lines = len({x for r in own for x in range(r[3], r[4] + 1)})
        assert (found[file]["lines"], found[file]["pct"], found[file]["groups"], found[file]["cost"]) == (lines, math.floor(min(1, lines / loc) * 100 + 0.5) / 100, len({r[0] for r in own}), max(r[0] for r in own) * 10)
        assert found[file]["sev"] == ("costosa" if any(r[0] == 3 for r in own) else "latente")


def plain_fuzzy(q, s):
    q, s, at, score, last, hit = q.lower(), s.lower(), 0, 0, -2, []
    for i, c in enumerate(s):
        if at < len(q) and c == q[at]:
            score += (3 if i == last + 1 else 1) + (2 if i == 0 or s[i - 1] in "/._-" else 0)
            hit.append(i)
            last, at = i, at + 1
    return None if at < len(q) else (score + (8 if q in s.split("/")[-1] else 0) - len(s) * 0.02, hit)


def test_fuzzy_score(spark):
    pick = random.Random(7)
    rows = [("".join(pick.choices("abA.", k=pick.randint(0, 3))), "".join(pick.choices("abcAB/._-é$ ", k=pick.randint(0, 14)))) for _ in range(500)]
    found = spark.createDataFrame(rows, "q string, s string").withColumn("f", text.fuzzy(F.col("q"), F.col("s"))).collect()
    assert sum(r["f"] is not None for r in found) > 50
    for r in found:
        expected = plain_fuzzy(r["q"], r["s"])
        assert (r["f"] is None) == (expected is None), r
        if expected:
            assert r["f"]["score"] == pytest.approx(expected[0]) and r["f"]["hit"] == expected[1]
