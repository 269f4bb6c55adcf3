"""From files to a typed graph: what each import resolves to, and what is used of it."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.graph import merge_edges
from ..operators.measures import first_match
from ..session import cut
from ..sources.languages import BUILTIN, Grammar
from . import parse

#: Columns of a link: one row for each name that a source takes from a target.
LINK = ("source", "target", "kind", "spec", "line", "name", "local", "count", "side")


@dataclass
class Parsed:
    """What files say, each by itself: coded (id, lang, code, blank, loc, ...), statements, defined, offered and spaced."""

    coded: DataFrame
    statements: DataFrame
    defined: DataFrame
    offered: DataFrame
    spaced: DataFrame

    @staticmethod
    def of(files: DataFrame, grammar: Grammar = BUILTIN) -> Parsed:
        coded = cut(parse.lexed(files, grammar))
        statements = cut(parse.imports(coded, grammar))
        defined = cut(parse.definitions(coded, grammar))
        offered = cut(parse.exports(coded, statements, defined, grammar))
        return Parsed(coded, statements, cut(parse.told(defined, offered)), offered, cut(parse.spaces(coded, grammar)))

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def only(self, ids: DataFrame) -> Parsed:
        """Of the files ``ids`` (id) alone."""
        keyed = lambda t: "file" if "file" in t.columns else "id"
        return Parsed(*[t.join(ids.select(F.col("id").alias(keyed(t))), keyed(t), "left_semi") for t in self.tables().values()])


def joined(*parts: Column) -> Column:
    """A path put together, with ``.`` and ``..`` worked out."""
    steps = F.split(F.concat_ws("/", *parts), "/")
    empty = F.array().cast("array<string>")
    done = F.aggregate(steps, empty, lambda got, x: F.when((x == "") | (x == "."), got).when(x == "..", F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0)))).otherwise(F.concat(got, F.array(x))))
    return F.array_join(done, "/")


def _ancestors(path: str = "id") -> Column:
    """The folders above a file, its own first and the root last."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, F.size(steps) - i), "/"))


def _above(dotted: Column, sep: str) -> Column:
    """A name and what it lies in, longest first."""
    steps = F.split(dotted, sep)
    return F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(steps, 1, k), sep.replace("\\", "")))


def _dotted(statements: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, names, target) of Python's ``statements``: the modules and submodules below the first root that has any.

    A name that is a submodule links to that; the module is linked for the others, with all names.
    """
    spec, here = F.col("spec"), F.element_at(_ancestors(), 1)
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    dotted = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    up = joined(here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    roots = F.when(dots > 0, F.array(up)).otherwise(F.array_distinct(F.concat(F.array(F.lit(""), F.lit("src")), _ancestors())))
    unnamed = F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("local"))).cast(parse.NAMES)
    each = statements.select("key", "id", "spec", "names", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(unnamed)).alias("part"))
    each = each.select("key", "names", "part", dotted.alias("dotted"), F.posexplode(roots).alias("root", "folder"))
    base, sub = joined(F.col("folder"), F.col("dotted")), joined(F.col("folder"), F.col("dotted"), F.col("part.name"))
    none = F.lit(None).cast("string")
    named, module = ~F.col("part.name").isin("", "*"), F.col("dotted") != ""
    found = F.array(F.when(named, F.concat(sub, F.lit(".py"))).otherwise(none), F.when(named, joined(sub, F.lit("__init__.py"))).otherwise(none), F.when(module, F.concat(base, F.lit(".py"))).otherwise(none), joined(base, F.lit("__init__.py")))
    rows = each.select("key", "names", "part", "root", F.posexplode(found).alias("place", "target")).join(ids.select(F.col("id").alias("target")), "target")
    best = rows.groupBy("key", "names", "part").agg(F.min(F.struct("root", "place", "target")).alias("b"))
    least = best.groupBy("key").agg(F.min("b.root").alias("root"))
    kept = best.join(least, "key").filter(F.col("b.root") == F.col("root"))
    return kept.select("key", F.when(F.col("b.place") < 2, F.array("part")).otherwise(F.col("names")).alias("names"), F.col("b.target").alias("target")).distinct()


def _crates(statements: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, crate): the nearest folder at or above a file with lib.rs or main.rs, however far up; ``src`` where there is none."""
    mine = statements.filter("how = 'rust'").select("id").distinct()
    tries = mine.select("id", F.posexplode(_ancestors()).alias("place", "folder")).select("id", "place", "folder", F.explode(F.array(F.lit("lib.rs"), F.lit("main.rs"))).alias("name"))
    met = tries.withColumn("target", joined(F.col("folder"), F.col("name"))).join(ids.select(F.col("id").alias("target")), "target")
    return mine.join(met.groupBy("id").agg(F.min_by("folder", "place").alias("crate")), "id", "left").na.fill("src", ["crate"])


def _candidates(grammar: Grammar) -> Column:
    """The paths that a statement may mean, in the order in which they are tried."""
    here, spec, how = F.element_at(_ancestors(), 1), F.col("spec"), F.col("how")
    scripts = grammar.languages["javascript"].exts if "javascript" in grammar.languages else ()
    base = F.when(spec.startswith("/"), joined(spec)).otherwise(joined(here, spec))
    js = F.array(base, *[F.concat(base, F.lit(e)) for e in scripts], *[F.concat(base, F.lit(f"/index{e}")) for e in scripts], *[F.when(base.rlike(r"\.(m?js|cjs)$"), F.concat(F.regexp_replace(base, r"\.(m?js|cjs)$", ""), F.lit(e))) for e in scripts])
    include = F.concat(F.array(joined(here, spec), joined(spec), joined(F.lit("include"), spec), joined(F.lit("src"), spec)), F.flatten(F.transform(_ancestors(), lambda d: F.array(joined(d, spec), joined(d, F.lit("include"), spec)))))
    stem = F.regexp_replace(F.element_at(F.split("id", "/"), -1), r"\.rs$", "")
    top = stem.isin("mod", "lib", "main")
    none = F.array().cast("array<string>")
    file = lambda *p: F.array(F.concat(joined(*p), F.lit(".rs")), joined(*p, F.lit("mod.rs")))
    mod = F.concat(file(here, spec), F.when(top, none).otherwise(file(here, stem, spec)))
    steps = F.split(spec, "::")
    head = F.element_at(steps, 1)
    # each further super is one folder up
    ups = F.size(F.split(F.regexp_extract(spec, r"^super(?:::super)*", 0), "::"))
    root = (
        F.when(head == "crate", F.col("crate"))
        .when(head == "super", joined(here, F.when(top, F.lit("..")).otherwise(F.lit("")), F.repeat(F.lit("../"), ups - 1)))
        .otherwise(F.when(top, here).otherwise(joined(here, stem)))
    )
    path = F.slice(steps, F.when(head == "super", ups + 1).otherwise(F.lit(2)), F.size(steps))
    used = F.when(F.size(path) > 0, F.flatten(F.transform(F.sequence(F.greatest(F.size(path), F.lit(1)), F.lit(1), F.lit(-1)), lambda k: file(root, F.array_join(F.slice(path, 1, k), "/"))))).otherwise(none)
    return (
        F.when((how == "script") & spec.rlike(r"^[./]"), js).when(how == "include", include).when(how == "file", F.array(joined(here, spec)))
        .when((how == "rust") & (F.col("kind") == "mod"), mod).when(how == "rust", used).otherwise(none)
    )


def resolved(statements: DataFrame, ids: DataFrame, grammar: Grammar = BUILTIN) -> DataFrame:
    """``statements`` that name files, with target: the first candidate path that is one of ``ids`` (id); in Python one for each module."""
    keyed = statements.filter("how not in ('namespace', 'go')").withColumn("key", F.xxhash64("id", "place", "nth", "spec"))
    plain = keyed.filter("how <> 'dotted'").join(_crates(statements, ids), "id", "left")
    places = plain.select("key", F.posexplode(F.array_distinct(_candidates(grammar))).alias("place", "target")).filter("target is not null")
    others = plain.drop("crate").join(first_match(places, ["key"], "place", ids.select(F.col("id").alias("target")), "target"), "key", "left").drop("key")
    python = keyed.filter("how = 'dotted'")
    hits = _dotted(python, ids).withColumnRenamed("names", "own")
    linked = python.join(hits, "key", "left").withColumn("names", F.coalesce("own", "names"))
    return others.unionByName(linked.select(others.columns))


def _count(body: Column, local: Column) -> Column:
    pattern = F.concat(F.lit(r"(?<![\w$.])"), F.regexp_replace(local, r"\$", r"\\\\\$"), F.lit(r"(?![\w$])"))
    return F.regexp_count(body, pattern).cast("long")


def references(links: DataFrame, coded: DataFrame, said: DataFrame) -> DataFrame:
    """Resolved statements as links: a row for each name, and how often it is used.

    In JavaScript its lines of ``import ... from`` don't count; in other languages the texts of
    import statements and what stands in strings.  A file's names are gathered before its body is joined, which so is read once.
    """
    unnamed = F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("local"))).cast(parse.NAMES)
    rows = links.select(F.col("id").alias("source"), "target", "kind", "spec", "line", "side", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(unnamed)).alias("n")).select("source", "target", "kind", "spec", "line", "side", "n.name", "n.local")
    wanted = rows.filter("local <> '' and kind in ('import', 'require', 'include', 'mod')").groupBy("source").agg(F.collect_set("local").alias("locals"))
    script = F.regexp_replace("code", r"(?m)^\s*(import|export)\b[^\n;]*?from\s*['\"][^'\"]+['\"];?", "")
    bodies = coded.select(F.col("id").alias("source"), F.when(F.col("lang") == "javascript", script).otherwise(F.col("blank")).alias("body"), "lang")
    used = wanted.join(bodies, "source").join(said.withColumnRenamed("id", "source"), "source", "left")
    stated = F.when(F.col("lang") == "javascript", F.lit("")).otherwise(F.coalesce("said", F.lit("")))
    counted = used.withColumn("stated", stated).select("source", F.explode(F.transform("locals", lambda x: F.struct(x.alias("local"), F.greatest(F.lit(0).cast("long"), _count(F.col("body"), x) - _count(F.col("stated"), x)).alias("count")))).alias("c")).select("source", "c.*")
    found = rows.join(counted, ["source", "local"], "left")
    count = F.when(F.col("kind").isin("import", "require"), F.coalesce("count", F.lit(0))).otherwise(0).cast("long")
    return found.withColumn("count", count).select(*LINK)


def members(links: DataFrame, coded: DataFrame) -> DataFrame:
    """(source, target, name, count): what is used of modules that are imported whole, as ``local.member``."""
    whole = links.filter("name = '*' and local <> '' and kind <> 'reexport'").select("source", "target", "local").distinct()
    body = F.when(F.col("lang") == "javascript", F.col("code")).otherwise(F.col("blank"))
    dotted = coded.select(F.col("id").alias("source"), F.explode(F.regexp_extract_all(body, F.lit(r"(?<![\w$.])([\w$]+\.[\w$]+)"), 1)).alias("m")).groupBy("source", "m").agg(F.count("*").alias("count"))
    split = dotted.select("source", F.split_part("m", F.lit("."), F.lit(1)).alias("local"), F.split_part("m", F.lit("."), F.lit(2)).alias("name"), "count")
    return whole.join(split, ["source", "local"]).select("source", "target", "name", "count")


def _named(rows: DataFrame, line: Column) -> DataFrame:
    """Links from (source, target, spec, name, local, count)."""
    return rows.select("source", "target", F.lit("import").alias("kind"), "spec", line.cast("int").alias("line"), "name", "local", "count", F.lit(False).alias("side"))


def by_type(own: Parsed, every: Parsed) -> tuple[DataFrame, DataFrame]:
    """(links, outside) of languages with namespaces: a file to those whose types it can see and names.

    A file sees its own namespace, all that this lies in, the namespaces that it imports and single types
    that it imports.  A type that several of them have is that of the first in this order.  A statement that
    means neither is outside.
    """
    spaced = own.spaced.withColumnRenamed("id", "source")
    types = every.defined.filter(parse.is_type(F.col("kind"))).join(every.spaced.filter("ns <> ''").withColumnRenamed("id", "file"), "file").select("lang", "ns", F.col("name").alias("type"), F.col("file").alias("target")).distinct()
    known = types.select("lang", F.col("ns").alias("known")).union(every.spaced.filter("ns <> ''").select("lang", "ns")).distinct()
    up = spaced.filter("ns <> ''").select("source", "lang", F.posexplode(_above(F.col("ns"), r"\.")).alias("place", "ns")).withColumn("only", F.lit(None).cast("string"))
    told = own.statements.filter("how = 'namespace'").select(F.col("id").alias("source"), "lang", F.regexp_replace(F.translate("spec", "\\", "."), r"\.\*$", "").alias("s"), F.translate("spec", "\\", ".").alias("spec"), "line", "place", "nth")
    cut_at = told.withColumns({"outer": F.regexp_extract("s", r"^(.+)\.[^.]*$", 1), "last": F.regexp_extract("s", r"([^.]*)$", 1)})
    spaces_met = cut_at.join(known.withColumnRenamed("known", "s").withColumn("is_space", F.lit(True)), ["lang", "s"], "left")
    single = types.select("lang", F.col("ns").alias("outer"), F.col("type").alias("last")).distinct().withColumn("is_type", F.lit(True))
    judged = cut(spaces_met.join(single, ["lang", "outer", "last"], "left"))
    order = (F.lit(1000) + F.col("place") * 100_000 + F.col("nth")).cast("int")
    seen = judged.filter("is_space").select("source", "lang", order.alias("place"), F.col("s").alias("ns"), F.lit(None).cast("string").alias("only"))
    direct = judged.filter("is_space is null and is_type").select("source", "lang", (order + F.lit(1_000_000_000)).alias("place"), F.col("outer").alias("ns"), F.col("last").alias("only"))
    visible = up.select("source", "lang", "place", "ns", "only").union(seen).union(direct)
    tokens = parse.words(own.coded.join(own.spaced.select("id"), "id", "left_semi")).select(F.col("id").alias("source"), F.col("token").alias("type"), "count")
    lang = spaced.select("source", "lang")
    met = tokens.join(lang, "source").join(types, ["lang", "type"]).join(visible, ["source", "lang", "ns"]).filter("only is null or only = type")
    first = F.min("place").over(Window.partitionBy("source", "type"))
    kept = met.withColumn("first", first).filter("place = first")
    mine = every.defined.filter(parse.is_type(F.col("kind"))).select(F.col("file").alias("source"), F.col("name").alias("type")).distinct().withColumn("mine", F.lit(1))
    counted = kept.join(mine, ["source", "type"], "left").withColumn("count", F.col("count") - F.coalesce("mine", F.lit(0))).filter("count > 0 and source <> target").select("source", "target", F.col("type").alias("name"), "count").distinct()
    spec = F.array_join(F.array_sort(F.collect_set("name").over(Window.partitionBy("source", "target"))), ", ")
    outside = judged.filter("is_space is null and is_type is null").select(F.col("source").alias("id"), "lang", "spec", F.lit("import").alias("kind"))
    return _named(counted.withColumns({"spec": spec, "local": F.col("name")}), F.lit(1)), outside


def nearest_modules(gone: DataFrame, modules: DataFrame) -> DataFrame:
    """(dir, module, rank) of the modules (dir, module) that are the nearest above any Go file, in the order of their first files."""
    above = gone.select("id", F.posexplode(_ancestors()).alias("place", "dir")).join(modules, "dir")
    nearest = above.groupBy("id").agg(F.min_by(F.struct("dir", "module"), "place").alias("m"))
    return nearest.groupBy("m.dir", "m.module").agg(F.min("id").alias("rank"))


def by_package(own: Parsed, every: Parsed, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, outside) of Go: imports below a module (dir, module) to the files of that folder that define what is used of
    them, or to its first file.  Of modules that fit one import the one that comes first counts."""
    gone = every.coded.filter("lang = 'go'").select("id", text.folder(F.col("id")).alias("folder"))
    sources = own.statements.filter("how = 'go'").withColumn("key", F.xxhash64("id", "place", "nth", "spec"))
    named = sources.withColumn("module", F.explode(_above(F.col("spec"), "/"))).join(nearest_modules(gone, modules), "module")
    first = named.groupBy("key").agg(F.min_by(F.struct("dir", "module"), "rank").alias("m"))
    below = F.regexp_replace(F.concat_ws("/", "m.dir", F.expr("substring(spec, length(m.module) + 2, 4096)")), "^/|/$", "")
    version = F.regexp_replace("spec", r"/v\d+$", "")
    alias = F.coalesce(F.get("names", F.lit(0))["local"], F.element_at(F.split(version, "/"), -1))
    wanted = sources.join(first, "key").select("key", F.col("id").alias("source"), "spec", "line", F.when(below == "", "(raíz)").otherwise(below).alias("folder"), alias.alias("alias"))
    plain = gone.filter(~F.col("id").endswith("_test.go"))
    folders = plain.groupBy("folder").agg(F.min("id").alias("least"))
    wanted = cut(wanted.join(folders, "folder"))
    used = own.coded.filter("lang = 'go'").select(F.col("id").alias("source"), F.explode(F.regexp_extract_all("blank", F.lit(r"(?<![\w$.])(\w+\.[A-Za-z_]\w*)"), 1)).alias("m")).groupBy("source", "m").agg(F.count("*").alias("count"))
    used = used.select("source", F.split_part("m", F.lit("."), F.lit(1)).alias("alias"), F.split_part("m", F.lit("."), F.lit(2)).alias("name"), "count")
    owned = every.defined.join(plain.withColumnRenamed("id", "file"), "file").select(F.col("file").alias("target"), "name", "folder").distinct()
    hits = cut(wanted.join(used, ["source", "alias"]).join(owned, ["folder", "name"]).select("key", "source", "target", "spec", "line", "name", F.concat_ws(".", "alias", "name").alias("local"), "count"))
    bare = wanted.join(hits.select("key").distinct(), "key", "left_anti").select("source", F.col("least").alias("target"), "spec", "line", F.lit("").alias("name"), F.lit("").alias("local"), F.lit(0).cast("long").alias("count"))
    outside = sources.join(wanted.select("key"), "key", "left_anti").select("id", "lang", "spec", "kind")
    return _named(hits.drop("key").unionByName(bare).filter("source <> target"), F.col("line")), outside


def siblings(own: Parsed, every: Parsed) -> DataFrame:
    """Go links within a folder: names of four characters or more that a file uses and another of its folder defines, and it itself doesn't."""
    folder = text.folder(F.col("id"))
    gone = every.coded.filter("lang = 'go'").select("id", folder.alias("folder"))
    defined = every.defined.select("file", F.col("name").alias("token")).distinct()
    offered = defined.filter((F.length("token") >= 4) & ~F.col("file").endswith("_test.go")).join(gone.withColumnRenamed("id", "file"), "file").withColumnRenamed("file", "target")
    words = parse.words(own.coded.filter("lang = 'go'")).join(gone, "id").withColumnRenamed("id", "source")
    met = words.join(offered, ["folder", "token"]).filter("source <> target").join(defined.withColumnRenamed("file", "source"), ["source", "token"], "left_anti")
    spec = F.concat(F.lit("paquete "), F.element_at(F.split("folder", "/"), -1))
    return _named(met.select("source", "target", spec.alias("spec"), F.col("token").alias("name"), F.col("token").alias("local"), "count"), F.lit(1))


def link(every: Parsed, modules: DataFrame | None = None, grammar: Grammar = BUILTIN, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links of names, edges to packages) of parsed files, or of ``sources`` (id) among them.

    Only tables of ``Parsed`` are read, so that a file whose text is the same needn't be parsed again when others change.
    """
    own = every if sources is None else every.only(sources)
    ids = every.coded.select("id", "lang")
    statements = cut(resolved(own.statements, ids, grammar))
    said = parse.statement_text(own.coded.filter("lang <> 'javascript'"), grammar)
    typed, typed_out = by_type(own, every)
    links = references(statements.filter("target is not null and target <> id"), own.coded, said).unionByName(typed).unionByName(siblings(own, every))
    if modules is None:
        modules = ids.sparkSession.createDataFrame([], "dir string, module string")
    packed, packed_out = by_package(own, every, modules)
    local = statements.filter("target is null and not spec rlike '^[./]' and kind <> 'mod' and how <> 'rust'").select("id", "lang", "spec", "kind")
    out = local.unionByName(typed_out).unionByName(packed_out)
    outside = out.select(F.col("id").alias("source"), F.concat(F.lit("pkg:"), text.package(F.col("spec"), F.col("lang"))).alias("target"), "kind").distinct()
    return cut(links.unionByName(packed)), cut(outside)


def linked(files: DataFrame, modules: DataFrame | None = None, grammar: Grammar = BUILTIN) -> tuple[Parsed, DataFrame, DataFrame]:
    """(what files say, links of names, edges to packages) of ``files`` (id, ext, lang, content)."""
    parsed = Parsed.of(files, grammar)
    return parsed, *link(parsed, modules, grammar)


def graph(files: DataFrame, modules: DataFrame | None = None, grammar: Grammar = BUILTIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with code, edges between files, edges to packages) of ``files`` (id, ext, lang, content)."""
    parsed, links, outside = linked(files, modules, grammar)
    return parsed.coded, cut(merge_edges(links)), outside
