"""Languages as data: signs of comments, names, lines, resolution over many levels, and languages from settings."""

import pytest

from tarn.plans import links, parse
from tarn.sources.languages import BUILTIN, Grammar


def files(spark, texts, grammar=BUILTIN):
    ext = lambda n: "." + n.rsplit(".", 1)[1]
    return spark.createDataFrame([(n, ext(n), grammar.extensions[ext(n)], t) for n, t in texts.items()], "id string, ext string, lang string, content string")


def test_signs_of_each_language(spark):
    texts = {
        "a.php": "<?php\n# one use X;\n$s = '# no'; // two\n/* three\n\n*/ use Acme\\Shop\\Cart;\n",
        "b.rs": "fn f<'a>(x: &'a str) -> &'a str { x } // life\nuse crate::deep::mod_a;\n",
        "c.py": "x = '''\n# no\n'''  # yes\ns = \"it's # no\"\n",
        "d.js": "const r = `a // no\n/* no */`; // yes\nconst e = 'it\\'s // no';\n/* open",
        "e.go": "package e\nvar s = `raw // no\n` // yes\n",
        "f.py": 'bad = "no end\n# here\n',
    }
    coded = {r["id"]: r for r in parse.lexed(files(spark, texts)).collect()}
    assert {n: [(c["line"], c["comment"].strip()) for c in r["noted"]] for n, r in coded.items()} == {
        "a.php": [(2, "one use X;"), (3, "two"), (4, "three")], "b.rs": [(1, "life")], "c.py": [(3, "yes")], "d.js": [(2, "yes"), (4, "open")], "e.go": [(3, "yes")], "f.py": [(2, "here")],
    }
    for r in coded.values():
        assert r["code"].count("\n") == r["content"].count("\n") == r["blank"].count("\n")
    assert "use Acme" in coded["a.php"]["code"] and "no" not in coded["d.js"]["blank"].replace("const", "") and coded["b.rs"]["code"].startswith("fn f<'a>(x: &'a str)")


def test_names_lines_and_exports_of_javascript(spark):
    text = (
        "import def, { a as b, type T } from './x.js'; import * as ns from './y.js';\n"
        "import './side.js';\n/*\n*/\nimport { z } from './x.js';\n\nimport { z } from './x.js';\n"
        "export { q as default, r } from './x.js';\nexport * from './y.js';\nconst { m, n: o } = require('./x.js');\nimport('./y.js');\n"
        "function inner() {}\nexport default class Big {}\nconst late = 1;\nexport { inner, late as soon };\nexport const f = async (x) => x;\n"
    )
    coded = parse.lexed(files(spark, {"m.js": text})).cache()
    said = parse.imports(coded)
    found = sorted((r["kind"], r["spec"], r["line"], r["side"], tuple((n["name"], n["local"]) for n in r["names"])) for r in said.collect())
    assert found == sorted([
        ("import", "./x.js", 1, False, (("default", "def"), ("a", "b"), ("T", "T"))), ("import", "./y.js", 1, False, (("*", "ns"),)), ("import", "./side.js", 2, True, ()),
        ("import", "./x.js", 5, False, (("z", "z"),)), ("import", "./x.js", 7, False, (("z", "z"),)), ("reexport", "./x.js", 8, False, (("q", ""), ("r", ""))), ("reexport", "./y.js", 9, False, (("*", ""),)),
        ("require", "./x.js", 10, False, (("m", "m"), ("n: o", "n: o"))), ("dynamic", "./y.js", 11, False, ()),
    ])
    defined = parse.definitions(coded)
    offered = parse.exports(coded, said, defined)
    assert {r["name"] for r in offered.collect()} == {"Big", "default", "inner", "soon", "f", "q", "r"}
    assert {(r["name"], r["kind"], r["line"], r["exported"]) for r in parse.told(defined, offered).collect()} == {("inner", "function", 12, True), ("Big", "class", 13, True), ("late", "const", 14, False), ("f", "function", 16, True)}


def test_definitions_of_other_languages(spark):
    texts = {
        "a.cs": "[Serializable] public sealed class Order\n{\n    public async Task<int> Get(int x)\n    private void Hid(int x)\n  internal record struct P(int X);\n}\n",
        "b.kt": "data class Item(val x: Int)\nprivate fun hid() = 1\nfun <T> Box.second(x: T): T = x\nobject One\n",
        "c.php": "<?php\nabstract class A {\n  private static function go() {}\n}\nfunction top() {}\n",
        "d.rs": "pub(crate) async fn run() {}\nstruct S;\npub const X: i32 = 1;\nmod inner;\n",
        "e.go": "func (s *T) Do() {}\nfunc hid() {}\ntype T struct {}\nvar V = 1\n",
        "f.java": "@Entity(name = \"x\") public final class User {}\nprivate interface I {}\n",
        "g.c": "typedef struct node {\nstatic int area(int a, int b) {\nreturn f(x);\n",
    }
    found = {}
    for r in parse.definitions(parse.lexed(files(spark, texts))).collect():
        found.setdefault(r["file"], set()).add((r["line"], r["name"], r["kind"], r["exported"]))
    assert found == {
        "a.cs": {(1, "Order", "class", True), (3, "Get", "function", True), (5, "P", "record", True)},
        "b.kt": {(1, "Item", "class", True), (2, "hid", "function", False), (3, "second", "function", True), (4, "One", "object", True)},
        "c.php": {(2, "A", "class", True), (3, "go", "function", True), (5, "top", "function", True)},
        "d.rs": {(1, "run", "function", True), (2, "S", "struct", False), (3, "X", "const", True), (4, "inner", "module", False)},
        "e.go": {(1, "Do", "function", True), (2, "hid", "function", False), (3, "T", "type", True), (4, "V", "const", True)},
        "f.java": {(1, "User", "class", True), (2, "I", "interface", False)},
        "g.c": {(1, "node", "struct", True), (2, "area", "function", True)},
    }


@pytest.fixture(scope="module")
def deep(spark):
    texts = {
        "svc/go.mod.go": "package x\n",
        "svc/a/b/c/main.go": "package main\nimport (\n  st \"ex.com/m/store\"\n  \"ex.com/m/none\"\n  \"fmt\"\n)\nfunc main() { st.Open(); st.Shut() }\n",
        "svc/store/store.go": "package store\nfunc Open() {}\nfunc Close() {}\n",
        "svc/store/b.go": "package store\nfunc Shut() {}\n",
        "other/x.go": "package other\nimport \"ex.com/m/store\"\nfunc X() {}\n",
        "rs/src/lib.rs": "mod one;\n",
        "rs/src/one/mod.rs": "pub mod two;\n",
        "rs/src/one/two/mod.rs": "pub mod three;\nuse super::super::top::f;\n",
        "rs/src/one/two/three.rs": "use crate::top::Thing::new;\nuse super::sib::g;\nuse self::kid::h;\n",
        "rs/src/one/two/three/kid.rs": "pub fn h() {}\n",
        "rs/src/one/two/sib.rs": "pub fn g() {}\n",
        "rs/src/top.rs": "pub fn f() {}\n",
        "cs/Base.cs": "namespace Acme\n{\n public class Base { }\n public class Both { }\n}\n",
        "cs/Mid.cs": "namespace Acme.Shop\n{\n public class Mid { }\n public class Both { }\n}\n",
        "cs/Low.cs": "using Acme.Other;\nusing System.Text;\nusing Tool = Far.Away.Tool;\nnamespace Acme.Shop.Cart.Api\n{\n public class Low { Base b; Mid m; Both x; Tool t; Peer p; string s = \"Text\"; }\n}\n",
        "cs/Peer.cs": "namespace Acme.Other\n{\n public class Peer { }\n}\n",
        "cs/Far.cs": "namespace Far.Away\n{\n public class Tool { }\n public class Base { }\n}\n",
        "php/a/one.php": "<?php\nnamespace App\\A;\nuse App\\B\\Two;\nrequire_once('inc/three.php');\nclass One { function f(Two $t) {} }\n",
        "php/b/two.php": "<?php\nnamespace App\\B;\nclass Two {}\n",
        "php/a/inc/three.php": "<?php\n",
    }
    modules = spark.createDataFrame([("svc", "ex.com/m"), ("other", "ex.com/other")], "dir string, module string")
    return links.linked(files(spark, texts), modules)


def test_resolution_over_many_levels(deep):
    _, found, outside = deep
    got = {}
    for r in found.collect():
        got.setdefault((r["source"], r["target"]), set()).add((r["name"], r["count"]))
    assert got == {
        ("svc/a/b/c/main.go", "svc/store/store.go"): {("Open", 1)}, ("svc/a/b/c/main.go", "svc/store/b.go"): {("Shut", 1)},
        ("other/x.go", "svc/store/b.go"): {("", 0)},
        ("rs/src/lib.rs", "rs/src/one/mod.rs"): {("", 0)}, ("rs/src/one/mod.rs", "rs/src/one/two/mod.rs"): {("", 0)}, ("rs/src/one/two/mod.rs", "rs/src/one/two/three.rs"): {("", 0)},
        ("rs/src/one/two/mod.rs", "rs/src/top.rs"): {("", 0)}, ("rs/src/one/two/three.rs", "rs/src/top.rs"): {("", 0)}, ("rs/src/one/two/three.rs", "rs/src/one/two/sib.rs"): {("", 0)}, ("rs/src/one/two/three.rs", "rs/src/one/two/three/kid.rs"): {("", 0)},
        ("cs/Low.cs", "cs/Base.cs"): {("Base", 1)}, ("cs/Low.cs", "cs/Mid.cs"): {("Mid", 1), ("Both", 1)}, ("cs/Low.cs", "cs/Peer.cs"): {("Peer", 1)}, ("cs/Low.cs", "cs/Far.cs"): {("Tool", 3)},
        ("php/a/one.php", "php/b/two.php"): {("Two", 2)}, ("php/a/one.php", "php/a/inc/three.php"): {("", 0)},
    }
    assert {(r["source"], r["target"]) for r in outside.collect()} == {("svc/a/b/c/main.go", "pkg:ex.com/m/none"), ("svc/a/b/c/main.go", "pkg:fmt"), ("cs/Low.cs", "pkg:System")}


SETTINGS = {
    "ruby": {"exts": [".rb"], "ignore": ["gems"], "tests": ["_spec\\.rb$"], "lexer": {"line": ["#"], "block": [["=begin", "=end"]], "strings": ["'", '"']}, "resolver": "file", "imports": [{"re": "^[ \\t]*require_relative[ \\t]+['\"]([^'\"]+)['\"]", "spec": 1}], "defs": [{"re": "^[ \\t]*def[ \\t]+(?<n>\\w+)", "name": 1, "exported": "noUnderscore"}]},
    "php": False,
    "python": {"exts": [".py"], "lexer": {"line": ["%"]}, "resolver": "dotted", "imports": [{"re": "^use (\\w+)", "spec": 1}]},
    "broken": {"exts": [".zz"], "imports": [{"re": "(", "spec": 1}]},
    "bare": {"name": "no extensions"},
}


def test_languages_from_settings(spark):
    grammar = BUILTIN.with_settings(SETTINGS)
    assert grammar.extensions[".rb"] == "ruby" and ".php" not in grammar.extensions and ".zz" not in grammar.extensions and "gems" in grammar.ignored and "cache" not in grammar.ignored
    texts = {"a/x.rb": "# require_relative 'no.rb'\n=begin\nrequire_relative 'no.rb'\n=end\nrequire_relative '../b/y.rb'\nrequire_relative 'none.rb'\ndef go\ndef _hid\n", "b/y.rb": "x = 1\n", "b/no.rb": "", "m.py": "% use gone\nuse helper\nimport helper\n", "helper.py": "", "x_spec.rb": ""}
    parsed, found, _ = links.linked(files(spark, texts, grammar), grammar=grammar)
    assert {(r["source"], r["target"], r["line"]) for r in found.collect()} == {("a/x.rb", "b/y.rb", 5), ("m.py", "helper.py", 2)}
    assert {(r["name"], r["exported"]) for r in parsed.defined.collect()} == {("go", True), ("_hid", False)}


def test_tests_are_told_by_language(spark):
    grammar = BUILTIN.with_settings(SETTINGS)
    names = ["a/x_spec.rb", "a/x.rb", "src/UserTest.java", "src/test/User.java", "web/a.test.ts", "web/spec/a.js", "pkg/UnitTests/A.cs", "tests/lib.rs", "a_test.go", "tests/x.go"]
    rows = files(spark, {n: "" for n in names}, grammar)
    assert {r["id"] for r in rows.filter(grammar.is_test(rows["lang"], rows["id"])).collect()} == set(names) - {"a/x.rb", "tests/x.go"}


def test_no_language_and_no_files(spark):
    empty = files(spark, {"a.js": "import './b.js';"}).limit(0)
    parsed, found, outside = links.linked(empty)
    assert found.isEmpty() and outside.isEmpty() and parsed.defined.isEmpty()
    assert Grammar(()).extensions == {}
