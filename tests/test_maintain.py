"""A kept repository against one that is parsed whole."""

from pyspark.sql import functions as F

from tarn.plans import links, maintain
from tarn.sources import generate
from tarn.sources.languages import BUILTIN

FILES = {
    "web/a.js": "import { b } from './b.js';\nimport { i } from './lib';\nimport late from './late';\nb(); i(late);\n",
    "web/b.js": "export const b = () => 1;\n",
    "web/lib/index.js": "export const i = 1;\n",
    "pkg/__init__.py": "from . import one, two\n",
    "pkg/one.py": "import pkg.two as t\nfrom .deep.low import f\nt.g(f)\n",
    "pkg/two.py": "def g(x): return x\n",
    "pkg/deep/__init__.py": "",
    "cs/A.cs": "using Acme.Far;\nnamespace Acme\n{\n public class A { B b; Far f; }\n}\n",
    "cs/B.cs": "namespace Acme\n{\n public class B { }\n}\n",
    "go/m/main.go": "package main\nimport \"ex.com/m/util\"\nfunc main() { util.Do(); Helper() }\n",
    "go/m/more.go": "package main\nfunc Helper() {}\n",
    "go/m/util/u.go": "package util\nfunc Do() {}\n",
    "rs/src/lib.rs": "mod one;\nuse crate::two::f;\n",
    "rs/src/one.rs": "use crate::two::f;\n",
    "c/x.c": "#include \"y.h\"\n",
}


def table(spark, texts):
    ext = lambda n: "." + n.rsplit(".", 1)[1]
    return spark.createDataFrame([(n, ext(n), BUILTIN.extensions[ext(n)], t) for n, t in texts.items()], maintain.SOURCE)


def rows(df):
    return sorted((tuple(map(str, (r[c] for c in sorted(df.columns)))) for r in df.collect()))


def same(repository, files, modules):
    said, found, outside = links.linked(files, modules)
    for name, expected in zip(maintain.TABLES, [*said.tables().values(), found, outside], strict=True):
        assert rows(repository.table(name)) == rows(expected), name


def test_every_kind_of_change(spark, tmp_path):
    modules = spark.createDataFrame([("go/m", "ex.com/m")], "dir string, module string")
    now = dict(FILES)
    kept = maintain.Repository(spark, str(tmp_path / "r"), buckets=8)
    assert kept.version == -1
    kept.create(table(spark, now), modules)
    same(kept, table(spark, now), modules)
    steps = [
        ({"web/b.js": "export const b = () => 2;\n"}, [], {"web/b.js"}, None),
        ({"web/b.js": "export const b = () => 2;\n"}, [], set(), set()),
        ({"web/late/index.ts": "export default 1;\n", "c/include/y.h": "int f();\n", "pkg/deep/low.py": "def f(): pass\n", "rs/src/two.rs": "pub fn f() {}\n", "cs/Far.cs": "namespace Acme.Far\n{\n public class Far { }\n}\n"}, [], {"web/late/index.ts", "c/include/y.h", "pkg/deep/low.py", "rs/src/two.rs", "cs/Far.cs"}, None),
        ({"cs/B.cs": "namespace Acme\n{\n public class C { }\n}\n", "go/m/more.go": "package main\nfunc Other() {}\n"}, ["pkg/two.py", "web/lib/index.js", "none.js"], {"cs/B.cs", "go/m/more.go"}, None),
        ({"pkg/two/__init__.py": "def g(x): return 1\n"}, ["cs/Far.cs", "go/m/util/u.go", "rs/src/lib.rs"], {"pkg/two/__init__.py"}, None),
    ]
    for n, (texts, removed, parsed, relinked) in enumerate(steps):
        now |= texts
        for name in removed:
            now.pop(name, None)
        done = kept.update(table(spark, texts), spark.createDataFrame([(x,) for x in removed], "id string"), modules)
        assert {r["id"] for r in done.parsed.collect()} == parsed
        if relinked is not None:
            assert {r["id"] for r in done.relinked.collect()} == relinked
        same(kept, table(spark, now), modules)
    assert kept.version == 4
    assert kept.table("coded", 0).filter("id = 'web/b.js'").head()["content"].endswith("=> 1;\n")


def test_one_file_of_five_hundred(spark, tmp_path):
    project = generate.project(spark, 500)
    kept = maintain.Repository(spark, str(tmp_path / "r"), buckets=16)
    kept.create(project)
    one = project.filter("id = 'm3/f80.mjs'").withColumn("content", F.concat(F.lit("import { fn9 } from '../m0/f9.mjs';\nfn9();\n"), "content"))
    done = kept.update(one)
    assert [r["id"] for r in done.parsed.collect()] == ["m3/f80.mjs"] == [r["id"] for r in done.relinked.collect()]
    same(kept, project.filter("id <> 'm3/f80.mjs'").unionByName(one), None)
    # one bucket was written
    assert spark.read.parquet(f"{tmp_path}/r/manifest/1").filter("version = 1").count() == 1
