"""Copies in a world: groups, what they cost, literals, homonyms, and the findings in words."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import measures
from tarn.plans import duplicates, wording, world
from tarn.sources import files as tree
from tests.test_plans import put

FILES = {
    "src/a/one.js": "import { help } from '../lib/help.js';\nexport function load() { return help(3); }\n",
    "src/b/two.js": "import { help } from '../lib/help.js';\nimport { load } from '../a/one.js';\nexport function save() { return help(load()); }\n",
    "src/lib/help.js": "export function help(x) { return x; }\nexport function idle() { return 1; }\n",
    "src/lib/bus.js": "import { save } from '../b/two.js';\nexport function emit() { return save(); }\n",
    "src/a/three.js": "import { emit } from '../lib/bus.js';\nexport function three() { return emit(); }\n",
    "src/b/alone.js": "console.log(2);\n",
    "src/x.pb.go": "package x\nfunc X() int { return 1 }\n",
    "tests/one.test.js": "import { load } from '../src/a/one.js';\nload();\n",
}
#: name, file, start, end, tokens: a and b are equal but for names, c is like them, d lies in a, the others are too small, generated or tests.
BODY = [f"w{i}" for i in range(60)]
UNITS = [
    ("u1", "src/a/one.js", "compute", "function", 10, 30, BODY, "x"), ("u2", "src/b/two.js", "compute", "function", 5, 25, BODY, "y"),
    ("u3", "src/a/three.js", "reckon", "function", 1, 21, BODY[:58] + ["z1", "z2"], "z"), ("u4", "src/a/one.js", "inner", "function", 12, 20, BODY, "x"),
    ("u5", "src/b/two.js", "little", "function", 40, 43, BODY, "x"), ("u6", "src/b/two.js", "short", "function", 50, 70, BODY[:39], "x"), ("u7", "src/x.pb.go", "gen", "function", 1, 30, BODY, "x"),
    ("u8", "src/b/alone.js", "transform", "function", 1, 20, [f"q{i}" for i in range(50)], "q"), ("u9", "src/lib/help.js", "transform", "function", 2, 20, [f"r{i}" for i in range(50)], "r"),
    ("v1", "tests/one.test.js", "transform", "function", 2, 20, [f"s{i}" for i in range(50)], "s"), ("v2", "gone.js", "compute", "function", 2, 20, BODY, "s"), ("v3", "src/lib/bus.js", None, "callback", 2, 20, [f"t{i}" for i in range(50)], "t"),
]
LITERALS = [("86400", "num", f, n) for f, n in (("src/a/one.js", 4), ("src/b/two.js", 9), ("src/lib/help.js", 3), ("src/b/two.js", 2))] + [("orders/new", "str", f, 1) for f in ("src/a/one.js", "src/b/two.js", "src/b/two.js")] + [("once", "str", "src/a/one.js", 1)] + [("tested", "str", "tests/one.test.js", n) for n in range(5)]
NAMED = [("86400", "num", "src/lib/help.js", 1, "DAY"), ("86400", "num", "src/lib/zz.js", 1, "LATER")]
COMMITS = [(i, f"h{i}", "Ana" if i % 4 else "Luz", f"2024-05-{i + 1:02} 10:00:00", "fix: x" if i % 2 else "more") for i in range(8)]


def touches():
    rows = [(i, "A" if i == 0 else "M", p, None, 10, 1) for i in range(6) for p in ("src/a/one.js", "src/b/two.js")]
    rows += [(0, "A", p, None, 5, 0) for p in FILES if p not in ("src/a/one.js", "src/b/two.js", "src/b/alone.js")]
    return rows + [(i, "A" if i == 6 else "M", "src/b/alone.js", None, 3, 0) for i in (6, 7)] + [(i, "M", "src/lib/help.js", None, 3, 2) for i in (6, 7)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = put(tmp_path_factory.mktemp("copies"), FILES)
    units = spark.createDataFrame(UNITS, "unit string, file string, name string, kind string, start int, end int, tokens array<string>, raw string")
    literals = spark.createDataFrame(LITERALS, duplicates.LITERALS)
    named = spark.createDataFrame(NAMED, "value string, kind string, file string, line int, name string")
    commits = spark.createDataFrame(COMMITS, "i long, hash string, author string, ts string, msg string").withColumn("ts", F.col("ts").cast("timestamp"))
    dated = spark.createDataFrame(touches(), "i long, status string, path string, from_path string, add long, del long")
    return world.build(spark, tree.source_tree(spark, root), units=units, literals=literals, named=named, commits=commits, touches=dated, now="2024-05-11 10:00:00")


def test_groups_and_their_cost(built):
    (group,) = built.groups.collect()
    assert {(r.unit, r["start"]) for r in built.members.collect()} == {("u1", 10), ("u2", 5), ("u3", 1)}
    runs = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (BODY, UNITS[2][6])]
    sim = len(runs[0] & runs[1]) / len(runs[0] | runs[1])
    assert sim >= 0.8 and (group.id, group.name, group.type, group.copies, group.files, group.lines) == ("d0", "compute", "similar", 3, 3, 21)
    assert group.sim == math.floor(sim * 100 + 0.5) / 100
    # one and two were changed together in all their six commits
    assert (group.co_rate, group.co_count, group.sev, group.owners) == (1.0, 6, "costosa", ["Ana", "Luz"])
    assert group.score == min(100, math.floor(8 * math.sqrt(21 * 2) * 3 * 1.25 + 0.5))
    assert (group.dir, group.to) == ("src/lib", "src/lib/compute.js")
    # src/lib uses src/b, which would then use it
    assert group.warn == ["src/lib ya depende de src/b: importarlo desde ahí crearía una dependencia circular"]


def test_copies_count_for_files_and_health(spark, built):
    files = {r["id"]: r for r in built.files.collect()}
    one = files["src/a/one.js"]
    assert one.dup_lines == 21 and one.dup_pct == 1.0 and one.dup_sev == "costosa" and "duplicado" in one.flags and one.parts["dup"] == 1.0
    assert files["src/lib/help.js"].dup_pct == 0 and "duplicado" not in files["src/lib/help.js"].flags
    assert (one.add, one["del"], one.fixes, one.fix_rate) == (60, 6, 3, 0.5) and 0 < one.fix_low < 0.5 < one.fix_high < 1
    assert one.months == [0, 0, 0, 0, 0, 6] and sum(files["src/b/alone.js"].months) == 2
    kinds = {(r.kind, r.sev, r["id"]) for r in built.findings.collect()}
    assert {("duplicación", "alta", "src/a/one.js"), ("constante", "media", "num:86400")} <= kinds


def test_literals_and_homonyms(built):
    found = {r.key: r for r in built.constants.collect()}
    assert set(found) == {"num:86400", "str:orders/new"}
    day = found["num:86400"]
    assert (day["count"], day.files, day.sev, day.existing.name) == (4, 3, "media", "DAY") and [(x.file, x.line) for x in day["at"]][:2] == [("src/a/one.js", 4), ("src/b/two.js", 2)]
    assert found["str:orders/new"].sev == "info" and found["str:orders/new"].existing is None
    assert {(r.name, r.file, r.start, r.files, r.units) for r in built.homonyms.collect()} == {("transform", "src/b/alone.js", 1, 2, 2), ("transform", "src/lib/help.js", 2, 2, 2)}


def test_findings_in_words(built):
    rows = built.told.orderBy("place").collect()
    told = {(r.kind, r.title): r for r in rows}
    assert [r.id for r in rows] == [f"i{n}" for n in range(len(rows))]
    order = ["alta", "media", "info"]
    assert [r.sev for r in rows] == sorted((r.sev for r in rows), key=order.index)
    by_kind = {}
    for r in rows:
        by_kind.setdefault(r.kind, []).append(r)
    copy = by_kind["duplicación"][0]
    assert copy.title == "compute() está copiada en 3 archivos y las copias cambian juntas" and copy.sev == "alta"
    assert copy.detail == "3 copias de ~21 líneas (similar, 93% parecidas). Aparecieron juntas en 6 commits (100% de los cambios del menos tocado); las tocan Ana y Luz."
    assert copy.action == "Mueve compute() a src/lib/compute.js y importa desde 3 archivos. Las copias difieren un poco: unifica primero las diferencias como parámetros. Ojo: src/lib ya depende de src/b: importarlo desde ahí crearía una dependencia circular."
    assert by_kind["constante"][0].title == "86400 se repite 4 veces en 3 archivos" and by_kind["constante"][0].detail == "one.js:4, two.js:2, two.js:9, help.js:3."
    assert by_kind["constante"][0].action == "Ya existe DAY en help.js: úsala en lugar del literal." and by_kind["constante"][1].title == '"orders/new" se repite 3 veces en 2 archivos'
    assert by_kind["homónimo"][0].title == "transform() existe en 2 archivos" and by_kind["homónimo"][0].detail == "alone.js:1, help.js:2."
    assert by_kind["huérfano"][0].title == "b/alone no está conectado" and by_kind["huérfano"][0].detail == "Nadie lo importa y no cambia desde hace 3 días."
    assert ("generado", "1 archivo generado (no se editan a mano)") in told and told[("generado", "1 archivo generado (no se editan a mano)")].detail == "src/x.pb: nombre."
    assert {r.file for r in built.about.join(built.told.filter("title like 'compute()%'"), "id").collect()} == {"src/a/one.js", "src/b/two.js", "src/a/three.js"}
    assert [(r.title, r.detail) for r in by_kind["hotspot"]] == [("lib/help cambia mucho y otros dependen de él", "3 cambios en 90 días · lo importan 2 archivos · sin pruebas · 2 autores principales.")]


def test_words_of_cycles_and_pairs(spark):
    flat = "id string, skipped boolean, is_test boolean, flags array<string>, coverage string, score int, c90 long, fan_in long, bus_factor long, owner string, owner_share double, commits long, loc long, role string, last timestamp, gen string, dynamic boolean, dyn array<struct<line:int,what:string>>, status string"
    file = lambda p, **k: {"id": p, "skipped": False, "is_test": False, "flags": [], "coverage": "directa", "score": 1, "c90": 0, "fan_in": 0, "bus_factor": 2, "owner": "Ana", "owner_share": 0.9, "commits": 5, "loc": 50, "role": "module", "last": None, "gen": None, "dynamic": False, "dyn": None, "status": "clean"} | k
    rows = [
        file("s/a.js", flags=["propietario-único"]), file("s/b.js", coverage="ninguna", fan_in=2), file("s/c.js", coverage="ninguna", fan_in=3), file("lib/eventBus.js"),
        file("s/d.js", dynamic=True, dyn=[(1, "eval"), (2, "eval"), (3, "require")]), file("t/x.test.js", skipped=True, is_test=True, flags=["sin-commit"], status="modified"), file("s/n.js", flags=["sin-commit"], status="untracked"),
    ]
    files = spark.createDataFrame(rows, flat)
    cycles = spark.createDataFrame([("s/a.js", "s/a.js"), ("s/b.js", "s/a.js")], "node string, component string")
    edges = spark.createDataFrame([("s/a.js", "s/b.js", "import", 3, ["x"]), ("s/b.js", "s/a.js", "import", 1, ["y", "z"]), ("s/b.js", "s/a.js", "relation", 0, [])], "source string, target string, kind string, refs long, symbols array<string>")
    pairs = spark.createDataFrame([("s/a.js", "s/c.js", 4, 0.75, True), ("s/a.js", "s/b.js", 9, 1.0, False)], "a string, b string, count long, strength double, hidden boolean")
    symbols = spark.createDataFrame([("s/c.js", f"f{i}", "function", i, 0, 0) for i in range(7)] + [("s/b.js", f"g{i}", "function", i, 1, 1) for i in range(30)], "file string, name string, kind string, line int, total long, users long")
    recursion = spark.createDataFrame([("s/a.js", "directa", ["fact"], 3), ("s/a.js", "mutua", ["p", "q"], 1)], "id string, kind string, names array<string>, line int")
    told, about = wording.told(files, cycles=cycles, edges=edges, pairs=pairs, symbols=symbols, recursion=recursion)
    found = {r.kind: r for r in told.collect()}
    assert found["ciclo"].title == "Ciclo entre s/a y s/b" and found["ciclo"].detail == "Se importan entre sí. La dependencia más débil es s/b → s/a (y, z, 1 uso)."
    assert found["ciclo"].action == "Mueve y, z a un módulo aparte o avisa con un evento por eventBus.js en lugar de importar."
    assert found["pruebas"].title == "2 módulos muy usados sin ninguna prueba" and found["pruebas"].detail == "s/b (2), s/c (3). Ninguna prueba los toca, ni directa ni indirectamente."
    assert found["acoplamiento"].title == "s/a y s/c cambian juntos sin importarse" and found["acoplamiento"].sev == "media" and "4 commits (75% de" in found["acoplamiento"].detail
    assert found["dueño"].title == "Solo Ana conoce s/a" and found["dueño"].detail == "5 commits y 90% de ellos del mismo autor."
    assert found["exports"].title == "7 exports sin uso" and found["exports"].detail == "c.f0, c.f1, c.f2, c.f3, c.f4, c.f5…."
    assert found["reflexión"].title == "1 archivo usa reflexión o carga dinámica" and found["reflexión"].detail == "s/d (eval, require)."
    assert found["recursión"].detail == "s/a: p⇄q, fact()." and found["trabajo"].title == "2 archivos con cambios sin commit" and found["trabajo"].detail == "n (nuevo), x.test (modificado)." and found["trabajo"].action is None
    assert {r.file for r in about.join(told.filter("kind = 'ciclo'"), "id").collect()} == {"s/a.js", "s/b.js"}
    none, about = wording.told(files.limit(0), cycles=cycles.limit(0), edges=edges, pairs=pairs.limit(0), symbols=symbols, recursion=recursion)
    assert none.count() == 0 and about.count() == 0


def test_numbers_and_ranks_are_those_of_one_sequence(spark):
    rng = random.Random(3)
    values = [rng.randrange(40) for _ in range(500)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "id int, v int").repartition(5)
    placed = measures.numbered(rows, "place", F.col("v").desc_nulls_last(), F.col("id")).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(501)) and [(r.v, r["id"]) for r in placed[:-1]] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))
    ranks = {r["id"]: r.pct for r in measures.ranks(rows, "v", "pct").collect()}
    assert ranks == {i: math.floor(100 * (sum(x < v for x in values) + values.count(v) / 2) / 500 + 0.5) for i, v in enumerate(values)} | {999: None}
