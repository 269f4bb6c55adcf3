"""Source trees, links and histories of small repositories written by the tests."""

import subprocess

import pytest

from tarn.plans import links, world
from tarn.sources import files as tree
from tarn.sources import gitlog, history

TREE = {
    "src/a.js": "import { b, c } from './lib/b.js';\nimport fs from 'fs';\n// import { z } from './zz.js';\nexport function a() { return b() + c(); }\n",
    "src/lib/b.js": "import { a } from '../a.js';\nexport const b = () => a;\nexport function c() { return eval('1'); }\nexport { d } from './d';\n",
    "src/lib/d.js": "export const d = 4;\n",
    "test/a.test.js": "import { a } from '../src/a.js';\na();\n",
    "py/pkg/__init__.py": "from . import mod\nfrom .mod import (\n    f,\n    h)\nimport os, sys as s\n\ndef g():\n    return f() + h()\n",
    "py/pkg/mod.py": "def f():\n    return 1\n\ndef h():\n    return 2\n",
    "go/go.mod": "module ex.com/m\n",
    "go/main.go": "package main\nimport (\n  \"ex.com/m/util\"\n)\nfunc main() { util.Do() }\n",
    "go/util/u.go": "package util\nfunc Do() {}\n",
    "node_modules/x/x.js": "export const x = 1;\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return str(top)


def test_graph(spark, root):
    modules = spark.createDataFrame(tree.modules(root), "dir string, module string")
    coded, edges, outside = links.graph(tree.source_tree(spark, root), modules)
    assert coded.count() == 8
    assert {(r.source, r.target, r.kind, r.refs, tuple(r.symbols)) for r in edges.collect()} == {
        ("src/a.js", "src/lib/b.js", "import", 2, ("b", "c")),
        ("src/lib/b.js", "src/a.js", "import", 1, ("a",)),
        ("src/lib/b.js", "src/lib/d.js", "reexport", 0, ("d",)),
        ("test/a.test.js", "src/a.js", "import", 1, ("a",)),
        ("py/pkg/__init__.py", "py/pkg/mod.py", "import", 2, ("f", "h", "mod")),
        ("go/main.go", "go/util/u.go", "import", 1, ("Do",)),
    }
    assert {(r.source, r.target) for r in outside.collect()} == {("src/a.js", "pkg:fs"), ("py/pkg/__init__.py", "pkg:os"), ("py/pkg/__init__.py", "pkg:sys")}


def test_imports_from_far_folders_and_of_several_modules(spark, tmp_path):
    found = {
        "a/pkg/__init__.py": "",
        "a/pkg/one.py": "x = 1\n",
        "a/pkg/two/__init__.py": "y = 2\n",
        "a/b/c/d/e/deep.py": "from pkg import one, two\n\none.x + two.y\n",
        "n/include/top.h": "int f();\n",
        "n/p/q/r/s/low.c": "#include \"top.h\"\n",
    }
    for name, text in found.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    _, edges, outside = links.graph(tree.source_tree(spark, str(tmp_path)))
    assert {(r.source, r.target) for r in edges.collect()} == {("a/b/c/d/e/deep.py", "a/pkg/one.py"), ("a/b/c/d/e/deep.py", "a/pkg/two/__init__.py"), ("n/p/q/r/s/low.c", "n/include/top.h")}
    assert outside.isEmpty()


def test_world(spark, root):
    found = {r["id"]: r for r in world.from_tree(spark, root).files.collect()}
    assert {k for k, r in found.items() if r.in_cycle} == {"src/a.js", "src/lib/b.js"}
    assert [found[k].coverage for k in ("test/a.test.js", "src/a.js", "src/lib/d.js", "py/pkg/mod.py")] == ["prueba", "directa", "indirecta", "ninguna"]
    assert [(u.line, u.what) for u in found["src/lib/b.js"].dyn] == [(3, "eval")]
    assert found["test/a.test.js"].score == 0 and found["src/a.js"].fan_in == 1


def test_history(spark, tmp_path):
    root = str(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    assert history.head(root) is None
    git("init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    git("add", ".")
    git("commit", "-qm", "first")
    git("mv", "a.txt", "b.txt")
    git("commit", "-qm", "fix: moved")
    commits, touches = history.history(spark, root)
    assert [(r.i, r.author, r.msg) for r in commits.orderBy("i").collect()] == [(0, "Ann", "first"), (1, "Ann", "fix: moved")]
    assert [(r.status, r.path, r.from_path, r["add"]) for r in touches.orderBy("i").collect()] == [("A", "a.txt", None, 2), ("R", "b.txt", "a.txt", 2)]
    assert len(history.head(root)) == 40
    lines = history.blame(root, spark.createDataFrame([("b.txt",), ("none.txt",)], "id string")).orderBy("line").collect()
    assert [(r["id"], r.line, r.author, r.content) for r in lines] == [("b.txt", 1, "Ann", "one"), ("b.txt", 2, "Ann", "two")]
    (tmp_path / "b.txt").write_text("one\nthree\n")
    (tmp_path / "new.txt").write_text("x\n")
    assert {(r.path, r.status) for r in history.status(spark, root).collect()} == {("b.txt", "modified"), ("new.txt", "untracked")}
    assert "+three" in history.diff(root, "b.txt")


def test_history_in_ranges_of_commits(spark, tmp_path):
    top = tmp_path / "repo"
    top.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(top), "-c", "user.name=Ann Ü", "-c", "user.email=a@x", *a], check=True, capture_output=True, text=True).stdout
    assert [t.count() for t in history.history(spark, str(top))] == [0, 0]
    git("init", "-q")
    assert [t.count() for t in history.history(spark, str(top))] == [0, 0]
    for n in range(23):
        (top / f"f{n % 7}.txt").write_text("line\n" * (n + 1))
        (top / "ñ é\t\"x\".txt").write_text(f"{n}\n")
        if n == 11:
            git("mv", "f1.txt", "sub dir.txt")
        if n == 15:
            (top / "f2.txt").unlink()
        git("add", "-A")
        git("commit", "-qm", f"@@ {n} fix\tit")
    for table in ("commits", "touches"):
        whole, parted = (gitlog.read(spark, str(top), table, per_task=p) for p in (500, 4))
        assert (whole.rdd.getNumPartitions(), parted.rdd.getNumPartitions()) == (1, 6)
        assert sorted(whole.collect()) == sorted(parted.collect())
    commits, touches = history.history(spark, str(top), per_task=4)
    rows = commits.orderBy("i").collect()
    assert [(r.i, r.author, r.msg) for r in rows] == [(n, "Ann Ü", f"@@ {n} fix\tit") for n in range(23)]
    assert [r.hash for r in rows] == git("log", "--reverse", "--format=%h").split()
    assert [int(r.ts.timestamp()) for r in rows] == [int(x) for x in git("log", "--reverse", "--format=%at").split()]
    plain = [(n, *line.split("\t")) for n, c in enumerate(git("-c", "core.quotepath=off", "log", "--reverse", "--name-status", "-M", "--format=tformat:@@").split("@@\n")[1:]) for line in c.split("\n") if line]
    name = lambda x: 'ñ é\t"x".txt' if x.startswith('"') else x
    assert sorted((r.i, r.status, r.from_path, r.path) for r in touches.collect() if r.status == "R") == [(p[0], "R", p[2], p[3]) for p in plain if p[1][0] == "R"] != []
    assert sorted((r.i, r.status, r.path) for r in touches.collect()) == sorted((p[0], p[1][0], name(p[-1])) for p in plain)
    assert touches.filter("path = 'f3.txt'").selectExpr("sum(add) - sum(del)").head()[0] == 18
    assert [r.i for r in gitlog.read(spark, str(top), "commits", most=3, per_task=2).orderBy("i").collect()] == [0, 1, 2]
    (top / "sub").mkdir()
    (top / "sub/in.txt").write_text("x\n")
    git("add", "-A")
    git("commit", "-qm", "below")
    assert [(r.i, r.status, r.path) for r in gitlog.read(spark, str(top / "sub"), "touches").collect()] == [(0, "A", "in.txt")]


def test_settings(tmp_path):
    assert history.settings(str(tmp_path / "none.json"))["aux"] == []
    (tmp_path / "x.json").write_text('{"aux": ["demo"], "other": 1}')
    assert history.settings(str(tmp_path / "x.json")) == {"languages": {}, "dupes": {}, "aux": ["demo"], "auxOff": []}
    (tmp_path / "bad.json").write_text("{")
    assert history.settings(str(tmp_path / "bad.json"))["dupes"] == {}
