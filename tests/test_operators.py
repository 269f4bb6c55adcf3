"""Graph, history and text operators on small cases and against plain versions."""

import random

from pyspark.sql import functions as F

from tarn.functions import text
from tarn.functions.stats import half_up, wilson
from tarn.operators import clones, cochange, compare, graph, history, measures, sets
from tarn.sources.gitlog import commits_of, touches_of


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_cycles_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(24)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    nodes = {x for p in pairs for x in p}
    alike = {a: {b for b in nodes if b in reached(a) and a in reached(b)} | {a} for a in nodes}
    expected = {a: min(s) for a, s in alike.items() if len(s) > 1}
    assert {r["node"]: r["component"] for r in graph.cycles(edges(spark, pairs)).collect()} == expected


def test_components_and_communities(spark):
    two = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d")]
    assert {r["node"]: r["component"] for r in graph.components(edges(spark, two)).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    joined = edges(spark, [*two, ("c", "d")]).withColumn("weight", F.when((F.col("src") == "c") & (F.col("dst") == "d"), 0.1).otherwise(1.0))
    found = {r["node"]: r["community"] for r in graph.communities(joined).collect()}
    assert len({found[x] for x in "abc"}) == len({found[x] for x in "def"}) == 1 and found["a"] != found["d"]
    assert graph.communities(joined.limit(0)).collect() == [] and graph.cycles(edges(spark, [])).collect() == []


def test_symbols_are_traced_through_barrels(spark):
    symbols = spark.createDataFrame([("a", "f"), ("a", "g")], "file string, name string")
    barrels = spark.createDataFrame([("b", "a", "*"), ("c", "b", "f"), ("b", "c", "*")], "source string, target string, name string")
    uses = spark.createDataFrame([("x", "c", "f", 2), ("y", "b", "g", 1), ("z", "a", "*", 1)], "source string, target string, name string, count long")
    found = {(r["name"], r["user"]): (r["count"], r["via"]) for r in graph.trace(barrels, uses, symbols).collect()}
    assert found[("f", "x")] == (2, ["b", "c"]) and found[("g", "y")] == (1, ["b"]) and found[("f", "z")] == (1, [])


def test_renames_keep_a_file(spark):
    rows = [(0, "A", "old", None), (1, "M", "old", None), (2, "R", "new", "old"), (3, "A", "old", None), (4, "R", "last", "new"), (5, "D", "old", None), (6, "M", "last", None)]
    touches = spark.createDataFrame(rows, "i long, status string, path string, from_path string")
    keys = {r["i"]: r["file_key"] for r in history.replay(touches).collect()}
    assert keys == {0: "old@0", 1: "old@0", 2: "old@0", 3: "old@3", 4: "old@0", 5: "old@3", 6: "old@0"}


def test_a_log_is_parsed():
    sep = "\x1f"
    heads = [f"@@h1{sep}Ana{sep}2024-01-02T03:04:05+00:00{sep}start\n\n", f"@@h2{sep}Luz{sep}2024-01-03T03:04:05+00:00{sep}fix it\n\n"]
    named, counted = heads[0] + "A\ta.py\n" + heads[1] + "R090\ta.py\tb.py\n", heads[0] + "3\t0\ta.py\n" + heads[1] + "1\t2\tb.py\n-\t-\timg\n"
    assert [(i, author, msg) for i, _, author, _, msg in commits_of(iter(named.split("\n")))] == [(0, "Ana", "start"), (1, "Luz", "fix it")]
    assert [t[1:] for t in touches_of(iter(named.split("\n")), iter(counted.split("\n")))] == [("A", "a.py", None, 3, 0), ("R", "b.py", "a.py", 1, 2)]


def test_sizes_never_fall_below_zero(spark):
    rng = random.Random(2)
    rows = [(f"f{k}", i, rng.randint(-9, 9)) for k in range(5) for i in range(40)]
    net, expected = {}, {}
    for f, i, c in rows:
        net[f] = expected[(f, i)] = max(0, net.get(f, 0) + c)
    found = history.clamped(spark.createDataFrame(rows, "f string, i int, c int"), "f", "i", "c").collect()
    assert {(r["f"], r["i"]): r["net"] for r in found} == expected


def test_statistics(spark):
    one = spark.range(1)
    assert one.select(half_up(F.lit(-0.005)).alias("x")).first()["x"] == 0.0
    low, high = wilson(F.lit(0), F.lit(0))
    assert tuple(one.select(low, high).first()) == (0.0, 1.0)
    flat = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 9)], "i int, v int")
    assert {r["i"]: (r["z"], r["outlier"]) for r in measures.robust_z(flat, "v").collect()} == {1: (0.0, False), 2: (0.0, False), 3: (0.0, False), 4: (3.6, True)}


def test_regions_sum_to_the_union(spark):
    rows = spark.range(200)
    keys = {"a": F.col("id") % 2 == 0, "b": F.col("id") % 3 == 0, "c": F.col("id") < 50}
    found = sets.regions(sets.membership(rows, "id", keys), list(keys)).collect()
    assert sum(r["n"] for r in found) == sum(1 for i in range(200) if i % 2 == 0 or i % 3 == 0 or i < 50)
    assert sum(r["n"] for r in found if r["mask"] & 3 == 3) == sum(1 for i in range(200) if i % 6 == 0)


def test_equal_snapshots_differ_in_nothing(spark):
    snap = spark.createDataFrame([("a", 10, "activo"), ("b", 50, "estable")], "id string, risk int, state string")
    assert compare.snapshot_diff(snap, snap).collect() == []
    later = spark.createDataFrame([("a", 20, "activo"), ("c", 1, "nuevo")], "id string, risk int, state string")
    assert {(r["id"], r["change"]) for r in compare.snapshot_diff(snap, later).collect()} == {("a", "riesgo"), ("b", "eliminado"), ("c", "añadido")}


def test_big_transactions_make_no_pairs(spark):
    rows = [(1, i) for i in range(40)] + [(2, 1), (2, 2), (3, 1), (3, 2), (3, None)]
    found = cochange.pair_counts(spark.createDataFrame(rows, "tx int, item int"), "tx", "item").collect()
    assert [(r["a"], r["b"], r["count"]) for r in found] == [(1, 2, 2)]


def test_near_clones_need_rare_shingles(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, words), (2, [*words[:30], "x", *words[31:]]), (3, list(reversed(words)))]
    shingled = clones.shingles(spark.createDataFrame(rows, "u int, t array<string>"), "u", F.col("t"))
    assert [(r["a"], r["b"]) for r in clones.near_pairs(shingled, similarity=0.8).collect()] == [(1, 2)]


def test_fuzzy_matches_a_plain_scan(spark):
    from tarn.queries.texts import fuzzy
    from tests.test_sequences import plain_fuzzy

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_brand", "p_name", "p_type").collect()
    names = {f"{r['p_brand']}/{r['p_name']}" for r in parts}
    expected = {}
    for q in {(r["p_type"][0] + r["p_name"][0] + r["p_name"][-1]).lower() for r in parts}:
        scored = sorted((-round(found[0], 6), name) for name in names if (found := plain_fuzzy(q, name)))
        expected |= {(q, place): (name, -score) for place, (score, name) in enumerate(scored[:7], 1)}
    assert {(r["q"], r["place"]): (r["name"], r["score"]) for r in fuzzy(spark, sf).collect()} == expected


def test_questions(spark):
    rows = [("¿QUÉ ES LO MÁS RIESGOSO?", "risk"), ("depende de quién", "impact"), ("hola", "none")]
    found = spark.createDataFrame(rows, "q string, e string").select(text.intent(F.col("q")).alias("i"), "e").collect()
    assert all(r["i"] == r["e"] for r in found)
