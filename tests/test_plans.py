"""Signals, bridges, relations, guards and answers of a small repository of several languages."""

import dataclasses
import subprocess

import pytest
from pyspark.sql import functions as F

from tarn.operators import cochange, compare, graph, measures
from tarn.plans import answers, bridges, guard, links, parse, relations, review, signals, store, world
from tarn.sources import files as tree
from tarn.sources import generate, history

TREE = {
    "web/app.js": "// Front of the shop\nimport { fmt } from './util.js';\nimport './side.js';\nexport const load = (id) => fetch(`/api/orders/${id}`).then((r) => fmt(r));\nexport function fact(n) { return n <= 1 ? 1 : n * fact(n - 1); }\n",
    "web/util.js": "/* @set money\n * @rel app N:1 belongs to */\nexport function fmt(x) { return x; }\nexport function unused(x) { return 'it // is no comment'; }\n",
    "web/side.js": "// @rel missing 1:1 nowhere\nglobalThis.x = 1;\n",
    "api/OrdersController.cs": "using Acme.Models;\nnamespace Acme.Api\n{\n    [Route(\"api/[controller]\")]\n    public class OrdersController\n    {\n        [HttpGet(\"{id}\")]\n        public object Get(int id) { Order o = null; return Type.GetType(\"x\"); }\n    }\n}\n",
    "models/Order.cs": "namespace Acme.Models\n{\n    public class Order { }\n}\n",
    "com/acme/User.java": "package com.acme.model;\npublic class User { }\n",
    "com/acme/UserService.java": "package com.acme.svc;\nimport com.acme.model.User;\nimport java.util.List;\npublic class UserService { User u; List<User> l; }\n",
    "rust/src/lib.rs": "mod shapes;\nuse crate::shapes::area;\npub fn go() { area(); }\n",
    "rust/src/shapes.rs": "pub fn area() -> i32 { 1 }\n",
    "c/geo.c": "#include \"geo.h\"\nint f() { return 1; }\n",
    "c/include/geo.h": "int f();\n",
    "go/go.mod": "module ex.com/m\n",
    "go/store/store.go": "package store\nfunc Open() int { return Helper() }\n",
    "go/store/more.go": "package store\nfunc Helper() int { return 2 }\n",
    "go/store/x.pb.go": "package store\nfunc Gen() int { return 3 }\n",
    "tools/helpers.py": "import json\n\ndef is_even(n):\n    return True if n == 0 else is_odd(n - 1)\n\ndef is_odd(n):\n    return False if n == 0 else is_even(n - 1)\n\ndef call(o, k):\n    return getattr(o, k)()\n",
    "tools/main.py": "import helpers\nhelpers.call(1, 'x')\nhelpers.is_even(3)\n",
    "tests/test_helpers.py": "from tools.helpers import is_even\nis_even(2)\n",
}


def put(top, files):
    for name, text in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return put(tmp_path_factory.mktemp("poly"), TREE)


@pytest.fixture(scope="module")
def built(spark, root):
    return world.from_tree(spark, root)


def test_edges_of_several_languages(built):
    edges = {(r.source, r.target): r for r in built.edges.collect()}
    for pair in (
        ("web/app.js", "web/util.js"), ("web/app.js", "web/side.js"), ("api/OrdersController.cs", "models/Order.cs"), ("com/acme/UserService.java", "com/acme/User.java"), ("rust/src/lib.rs", "rust/src/shapes.rs"),
        ("c/geo.c", "c/include/geo.h"), ("go/store/store.go", "go/store/more.go"), ("tools/main.py", "tools/helpers.py"), ("tests/test_helpers.py", "tools/helpers.py"),
    ):
        assert pair in edges
    assert edges[("web/app.js", "web/side.js")].refs == 1
    assert edges[("web/app.js", "api/OrdersController.cs")].kind == "bridge"
    assert edges[("web/util.js", "web/app.js")].kind == "relation"
    assert {"pkg:java.util"} <= {r.target for r in built.packages.collect()}
    assert [(r.id, r.target, r.why) for r in built.warnings.collect()] == [("web/side.js", "missing", "no se encontró")]


def test_signals(spark, root, built):
    files = {r["id"]: r for r in built.files.collect()}
    assert files["web/app.js"].summary == "Front of the shop" and files["web/util.js"].tags == ["money"]
    assert files["go/store/x.pb.go"].gen == "nombre" and files["go/store/x.pb.go"].score == 0 and files["go/store/store.go"].gen is None
    assert "reflexión" in files["tools/helpers.py"].flags and "recursión" in files["web/app.js"].flags
    assert files["tests/test_helpers.py"].coverage == "prueba" and files["tools/helpers.py"].coverage == "directa"
    assert {(r.id, r.kind, tuple(r.names)) for r in built.recursion.collect()} == {("web/app.js", "directa", ("fact",)), ("tools/helpers.py", "mutua", ("is_even", "is_odd"))}
    noted = {(r.id, r.line, r.comment.strip()[:12]) for r in parse.comments(parse.lexed(tree.source_tree(spark, root))).collect()}
    assert ("web/util.js", 1, "@set money\n ") in noted and not any("no comment" in x[2] for x in noted)
    used = {(r["file"], r["name"]): r.total for r in built.symbols.collect()}
    assert used[("web/util.js", "fmt")] == 1 and used[("web/util.js", "unused")] == 0 and used[("tools/helpers.py", "is_even")] == 1
    assert {(r.test, r.why) for r in relations.impact_tests(built.impact, built.tested, spark.createDataFrame([("tools/helpers.py",)], "id string")).collect()} == {("tests/test_helpers.py", "prueba directa")}


def test_routes_and_calls(spark):
    rows = [
        ("s.py", "python", "@app.route('/a/<id>', methods=['POST'])\n@app.get('/b')\n"), ("s.go", "go", "mux.HandleFunc(\"GET /v1/things\", f)\n"),
        ("S.java", "java", "@RequestMapping(\"/base\")\nclass S {\n@GetMapping(\"/list/{x}\")\n}"), ("c.js", "javascript", "fetch('http://h/a/7', { method: 'POST' });\naxios.get('/base/list/9?q=1');\nfetch('/api/v1/things');\nfetch('/B');\n"),
    ]
    files = spark.createDataFrame(rows, "id string, lang string, content string")
    offered, made = bridges.routes(files), bridges.calls(files)
    assert {(r.id, r.method, r.path, r.line) for r in offered.collect()} >= {("s.py", "POST", "a/:p", 1), ("s.py", "GET", "b", 2), ("s.go", "ANY", "v1/things", 1), ("S.java", "GET", "base/list/:p", 3)}
    met = {(r.target, r.method, r.path, r.line) for r in bridges.bridges(offered, made).filter("source = 'c.js'").collect()}
    assert met == {("s.py", "POST", "/a/:p", 1), ("S.java", "GET", "/base/list/:p", 2), ("s.go", "GET", "/v1/things", 3), ("s.py", "GET", "/b", 4)}


def test_lines_and_methods_of_routes(spark):
    text = "app.get('/abc', f)\napp.get('/a', f)\n\n@api.get('/b', methods=['POST'])\n@x.route('/c')\n@x.route('/d', methods=['PUT'])\n"
    found = {(r.method, r.path, r.line) for r in bridges.routes(spark.createDataFrame([("s.py", "python", text)], "id string, lang string, content string")).collect()}
    assert found == {("GET", "abc", 1), ("GET", "a", 2), ("GET", "b", 4), ("POST", "b", 4), ("GET", "c", 5), ("PUT", "d", 6)}


def test_a_removed_file_that_was_used_is_told_unless_it_was_a_test(spark):
    form = "id string, risk int, fan_in int, loc int, covered boolean, dynamic boolean, skipped boolean, test boolean"
    before = spark.createDataFrame([("gen.js", 0, 4, 9, True, False, True, False), ("t.js", 0, 2, 9, True, False, True, True), ("a.js", 0, 1, 9, True, False, False, False)], form)
    assert {(r.id, r.rule) for r in compare.check(before, before.limit(0)).collect()} == {("gen.js", "eliminado en uso"), ("a.js", "eliminado en uso")}
    groups = spark.createDataFrame([(1, "f", "t.js", True), (2, "g", "a.js", False)], "`group` int, name string, file string, test boolean")
    assert {r.id for r in guard.signatures(groups=groups, like=groups).collect()} == {"a.js"}


def test_support_is_of_all_commits(spark):
    touches = spark.createDataFrame([(i, x) for i in range(4) for x in "ab"], "i int, item string")
    found = [cochange.associated(touches, "i", "item", transactions=t).first() for t in (None, spark.range(8).withColumnRenamed("id", "i"))]
    assert [(r["support"], r["lift"]) for r in found] == [(1.0, 1.0), (0.5, 2.0)]


def test_second_authors_are_authors(spark, built):
    shares = spark.createDataFrame([("web/app.js", "Ana", 8, 0.8, 1), ("web/app.js", "Luz", 2, 0.2, 2), ("web/util.js", "Luz", 1, 0.19, 2)], "id string, author string, commits long, share double, place int")
    found = world.sets(dataclasses.replace(built, shares=shares)).filter("set_key like 'author:%'").collect()
    assert {(r.set_key, r["id"]) for r in found} == {("author:Ana", "web/app.js"), ("author:Luz", "web/app.js")}


def test_review_of_a_change(spark, tmp_path):
    top = tmp_path / "repo"
    put(top, {"src/a.js": "import { b } from './b.js';\nexport const a = () => b();\n", "src/b.js": "export const b = 1;\n", "test/a.test.js": "import { a } from '../src/a.js';\na();\n"})
    git = lambda *a: subprocess.run(["git", "-C", str(top), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    put(top, {"src/b.js": "import { a } from './a.js';\nexport const b = () => a();\n", "src/new.js": "export const n = 1;\n" * 9})
    found = review.review(spark, str(top))
    told = {(r.rule, r.id): r.text for r in found.issues.collect()}
    assert found.level == "alto" and told[("ciclo nuevo", "src/a.js")] == "Ciclo nuevo entre src/a.js, src/b.js." and told[("sin pruebas", "src/new.js")] == "src/new.js es nuevo (9 líneas) y no tiene pruebas."
    assert {(r.path, r.status) for r in found.changed.collect()} == {("src/b.js", "M"), ("src/new.js", "A")}
    assert {(r.test, r.why) for r in found.tests.collect()} == {("test/a.test.js", "prueba de a, que depende de b")}
    assert {r.text for r in found.advice.collect()} == {"src/b.js está en un ciclo con src/a.js: un cambio de interfaz puede propagarse en círculo."}
    lines = found.markdown().split("\n")
    assert lines[0] == "## Riesgo del cambio: **alto**" and lines[2] == "Frente a `HEAD`: 1 nuevo(s), 1 modificado(s), 0 borrado(s)."
    assert "- `test/a.test.js` — prueba de a, que depende de b" in lines and "- Ciclo nuevo entre src/a.js, src/b.js." in lines and any(x.startswith("- `src/new.js` — riesgo") and x.endswith("· nuevo") for x in lines)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".base-")]
    assert history.info(str(top))["branch"] and history.info(str(tmp_path)) is None


def test_answers_name_files_and_plans_warn(spark, built):
    asked = spark.createDataFrame([("¿qué se rompe si cambio helpers.py?",), ("¿cómo está la salud?",)], "q string")
    assert [r.file for r in answers.named_file(asked, "q", built.files).orderBy("q").collect()] == [None, "tools/helpers.py"]
    assert answers.risk(built.files).count() == 5 and answers.generated(built.files).first()["id"] == "go/store/x.pb.go"
    assert [r["id"] for r in answers.impact(built.files, built.impact, "tools/helpers.py").collect()] == ["tools/main.py"]
    plan = guard.plan(built.files, built.impact, built.tested, spark.createDataFrame([("tools/helpers.py",), ("none.py",)], "id string"), bridges=built.bridges, cycles=built.cycles)
    assert {(r.id, r.kind) for r in plan["warnings"].collect()} == {("none.py", "desconocido"), ("tools/helpers.py", "reflexión")}
    assert [(r.id, r.direct) for r in plan["ripple"].collect()] == [("tools/main.py", True)]
    keys = {r.set_key for r in world.sets(built, spark.createDataFrame([("mine", "x.py")], "name string, id string")).collect()}
    assert {"dir:web", "lang:go", "tag:money", "saved:mine", "pkg:java.util", "flag:reflexión"} <= keys


def test_stores(spark, built, tmp_path):
    store.save(built.files.select("id", "score"), str(tmp_path), "print")
    assert store.load(spark, str(tmp_path), "print", "id string, score int").count() == built.files.count()
    for name in ("a", "b"):
        store.save(spark.createDataFrame([(name, "x")], "name string, id string"), str(tmp_path), "sets", add=True)
    assert store.load(spark, str(tmp_path), "sets", "name string, id string").count() == 2
    assert store.graph_json(built.files.select("id"), built.edges.select("source", "target")).count() == built.files.count() + built.edges.count()
    masks = spark.createDataFrame([("x", 3), ("y", 1)], "id string, mask int")
    assert [tuple(r) for r in store.region(masks, 3, "both").collect()] == [("both", "x")]


def test_generated_projects_are_the_same_however_dealt(spark):
    one, two = (sorted(map(tuple, generate.project(spark, 60).repartition(n).collect())) for n in (1, 7))
    assert one == two and len(one) == 60
    _, edges, _ = links.graph(generate.project(spark, 60))
    assert edges.count() > 60


def test_reach_has_no_end_of_its_own(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "src string, dst string")
    seeds = spark.createDataFrame([("n000", "n000")], "seed string, node string")
    assert graph.reach(chain, seeds).agg(F.max("depth")).first()[0] == 60
    star = spark.createDataFrame([(f"m{i:02}", "hub") for i in range(9)] + [("x", "m00"), ("y", "x")], "src string, dst string")
    told = {r.node: r for r in graph.impact(star, spark.createDataFrame([("hub",), ("x",)], "id string"), cap=5).collect()}
    assert told["hub"].capped and told["hub"].total == 4 and not told["x"].capped and (told["x"].total, told["x"].levels) == (1, [1])


def test_greedy_passes_over_what_does_not_fit(spark):
    sizes = [5, 4, 9, 2, 30, 1, 3, 1, 1, 1]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id int, n int").repartition(3)
    taken, left = [], 14
    for i, n in enumerate(sizes):
        if n <= 20 and n <= left:
            taken.append(i)
            left -= n
    assert sorted(r["id"] for r in measures.greedy(rows, "id", "n", most=20, budget=14).collect()) == taken


def test_rounded_strength_counts(spark):
    rows = [(i, x) for i in range(199) for x in ("a", "b")] + [(1000 + i, x) for i in range(201) for x in ("a", f"c{i}")] + [(5000 + i, x) for i in range(201) for x in ("b", f"d{i}")]
    found = cochange.associated(spark.createDataFrame(rows, "tx int, item string"), "tx", "item").filter("a = 'a' and b = 'b'").collect()
    assert [(r["count"], r["strength"]) for r in found] == [(199, 0.5)]
    aside = cochange.hidden(spark.createDataFrame([("a", "b")], "a string, b string"), spark.createDataFrame([], "a string, b string"), spark.createDataFrame([("b",)], "id string"))
    assert not aside.first()["hidden"]
