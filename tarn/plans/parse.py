"""What each file's own text says, by the patterns of its language: code, comments, imports, definitions, exports.

Every table here is made of single files, so a file that changed is parsed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_lines
from ..sources.languages import BUILTIN, TYPES, Grammar

NAMES = "array<struct<name:string,local:string>>"


def _newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def lexed(files: DataFrame, grammar: Grammar = BUILTIN) -> DataFrame:
    """``files`` (id, lang, content, ...) with code (no comments, the same lines), blank (strings too are spaces),
    noted (line, comment) and loc, lines of code that aren't empty."""
    c = F.col
    known = files.join(F.broadcast(grammar.lexers(files.sparkSession)), "lang")
    cut_ = known.withColumn("__p", F.expr("regexp_extract_all(content, pieces, 0)"))
    hollow = lambda x: F.regexp_replace(x, r"[^\n]+", "")
    spaces = lambda x: F.regexp_replace(x, r"[^\n]", " ")
    told = lambda x, at: F.regexp_like(x, c(at))
    code = F.array_join(F.transform("__p", lambda x: F.when(told(x, "opens"), hollow(x)).otherwise(x)), "")
    blank = F.array_join(F.transform("__p", lambda x: F.when(told(x, "opens"), hollow(x)).when(told(x, "quoted"), spaces(x)).otherwise(x)), "")
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line:int,comment:string>>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        text = F.regexp_replace(x, c("opens"), F.lit(""))
        text = F.when(told(x, "blocked"), F.regexp_replace(text, c("closes"), F.lit(""))).otherwise(text)
        got = F.when(told(x, "opens"), F.concat(acc["got"], F.array(F.struct(acc["line"].alias("line"), text.alias("comment"))))).otherwise(acc["got"])
        return F.struct((acc["line"] + _newlines(x)).cast("int").alias("line"), got.alias("got"))

    done = cut_.withColumns({"code": code, "blank": blank, "noted": F.aggregate("__p", start, step)["got"]})
    loc = F.size(F.filter(F.split("code", "\n"), lambda x: F.trim(x) != ""))
    return done.withColumn("loc", loc).drop("__p", "pieces", "opens", "blocked", "closes", "quoted")


def comments(coded: DataFrame) -> DataFrame:
    """(id, line, comment) of ``lexed`` files: each comment without its signs, and its first line."""
    return coded.select("id", F.explode("noted").alias("c")).select("id", "c.line", "c.comment")


def _clause(c: Column) -> Column:
    """Names of a JavaScript clause: ``a, { b as c }`` or ``* as all``."""
    star = F.regexp_extract(c, r"\*\s+as\s+([\w$]+)", 1)
    inner = F.transform(F.split(F.regexp_extract(c, r"\{([^}]*)\}", 1), ","), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^type\s+", ""))
    inner = F.transform(F.filter(inner, lambda x: x != ""), lambda x: F.struct(F.regexp_replace(x, r"\sas\s.*$", "").alias("name"), F.regexp_replace(x, r"^.*\sas\s", "").alias("local")))
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}", ""), r"\*\s+as\s+[\w$]+", ""), ",", " "))
    one = lambda name, local: F.array(F.struct(name.alias("name"), local.alias("local"))).cast(NAMES)
    none = F.array().cast(NAMES)
    return F.concat(F.when(rest.rlike(r"^[\w$]+$"), one(F.lit("default"), rest)).otherwise(none), F.when(star != "", one(F.lit("*"), star)).otherwise(none), inner.cast(NAMES))


def _python(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.regexp_replace(c, r"[()\\]", " "), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("name"), F.when(x == "*", "").when(x.rlike(r"\sas\s"), F.regexp_extract(x, r"\sas\s(.*)$", 1)).otherwise(x).alias("local"))).cast(NAMES)


def imports(coded: DataFrame, grammar: Grammar = BUILTIN) -> DataFrame:
    """(id, lang, kind, spec, names, line, side, how, body): a row for each thing that a statement of ``lexed`` files imports.

    names are (name, local), ``*`` for a whole module, ``default`` for JavaScript's; how is the way in
    which spec is resolved.  The line is where the match begins, told by the pieces between
    matches, so that statements with the same text have lines of their own.
    """
    c = F.col
    met = coded.select("id", "lang", "code").join(F.broadcast(grammar.imports(coded.sparkSession)), "lang").filter(F.regexp_like("code", c("pattern")))
    pick = lambda n: F.expr(f"regexp_extract_all(code, pattern, {n})")
    none = F.array().cast("array<string>")
    met = met.withColumns({"whole": pick("0"), "specs": pick("spec_at"), "clauses": F.when(c("names_at") > 0, pick("names_at")).otherwise(none), "first": F.when(F.startswith("pattern", F.lit("(^")), pick("1")).otherwise(none)})
    rows = met.withColumn("lines", match_lines(c("code"), c("pattern"), c("whole"))).select("id", "lang", "place", "kind", "style", "multi", "each", "each_spec", "each_alias", "how", "lazy", F.posexplode(F.arrays_zip("whole", "specs", "clauses", "first", "lines")).alias("nth", "m"))
    # in JavaScript the sign before a statement may be a line's end: the statement's own line counts
    line = c("m.lines") + F.when(c("m.first").isNotNull(), _newlines(F.regexp_extract("m.whole", r"^[;\s}]*", 0))).otherwise(0)
    kind = F.when(c("lazy") & c("m.whole").rlike(r"^[ \t]"), "dynamic").otherwise(c("kind"))
    star = lambda local: F.array(F.struct(F.lit("*").alias("name"), local.alias("local"))).cast(NAMES)
    unnamed = F.array().cast(NAMES)
    one = lambda spec, names: F.struct(F.trim(spec).alias("spec"), names.alias("names"))
    module = lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+\w+$", "")
    alias = lambda x: F.when(x.rlike(r"\sas\s"), F.regexp_extract(x, r"(\w+)\s*$", 1)).otherwise(F.regexp_extract(x, r"(\w+)", 1))
    grouped = F.transform(F.arrays_zip(F.expr("regexp_extract_all(m.specs, each, each_spec)").alias("s"), F.expr("regexp_extract_all(m.specs, each, each_alias)").alias("a")), lambda x: one(x["s"], F.when(x["a"] != "", star(x["a"])).otherwise(unnamed)))
    several = F.filter(F.split("m.specs", ","), lambda x: F.trim(x) != "")
    clause = F.coalesce(c("m.clauses"), F.lit(""))
    names = (
        F.when(c("style") == "clause", _clause(clause))
        .when((c("style") == "star") & clause.startswith("*"), F.array(F.struct(F.lit("*").alias("name"), F.lit("").alias("local"))).cast(NAMES))
        .when(c("style") == "star", F.transform(_clause(clause), lambda x: F.struct(x["name"].alias("name"), F.lit("").alias("local"))).cast(NAMES))
        .when(c("style") == "python", _python(clause))
        .otherwise(unnamed)
    )
    each = (
        F.when(c("each").isNotNull(), grouped)
        .when(c("style") == "pyimport", F.transform(several, lambda x: one(module(x), star(alias(F.trim(x))))))
        .when(c("multi"), F.transform(several, lambda x: one(x, unnamed)))
        .otherwise(F.array(one(c("m.specs"), names)))
    )
    found = rows.select("id", "lang", kind.alias("kind"), F.explode(each).alias("e"), line.cast("int").alias("line"), (c("style") == "side").alias("side"), "how", "place", "nth")
    return found.select("id", "lang", "kind", "e.spec", "e.names", "line", "side", "how", "place", "nth")


def statement_text(coded: DataFrame, grammar: Grammar = BUILTIN) -> DataFrame:
    """(id, said): the texts of all import statements of a file, whose words aren't uses."""
    met = coded.select("id", "lang", "code").join(F.broadcast(grammar.imports(coded.sparkSession)), "lang")
    each = met.select("id", F.array_join(F.expr("regexp_extract_all(code, pattern, 0)"), "\n").alias("t")).filter("t <> ''")
    return each.groupBy("id").agg(F.array_join(F.collect_list("t"), "\n").alias("said"))


def definitions(coded: DataFrame, grammar: Grammar = BUILTIN) -> DataFrame:
    """(file, name, kind, line, exported): what each line of ``lexed`` files defines, by the first pattern that fits it."""
    c = F.col
    met = coded.select("id", "lang", "code").join(F.broadcast(grammar.definitions(coded.sparkSession)), "lang")
    group = lambda x, at: F.expr(f"regexp_extract({x}, pattern, {at})")
    lines = met.select("id", "lang", "place", "pattern", "name_at", "kind", "kind_at", "rule", "group_at", F.filter(F.transform(F.split("code", "\n"), lambda x, i: F.struct(i.alias("p"), x.alias("x"))), lambda l: F.regexp_like(l["x"], c("pattern"))).alias("l")).select("*", F.explode("l").alias("e")).select("*", c("e.p").alias("p"), c("e.x").alias("x")).drop("l", "e")
    name = group("x", "name_at")
    kind = F.when(c("kind_at") > 0, F.lower(group("x", "kind_at"))).otherwise(c("kind"))
    kind = F.when(kind.startswith("record"), "record").when(kind.isin("fn", "func"), "function").when(kind == "mod", "module").when(kind.isin("const", "static"), "const").otherwise(kind)
    x = c("x")
    visible = (
        F.when(c("rule") == "noUnderscore", ~name.startswith("_")).when(c("rule") == "capitalized", name.rlike("^[A-Z]"))
        .when(c("rule") == "public", x.rlike(r"\bpublic\b") | ~x.rlike(r"\b(private|protected)\b"))
        .when(c("rule") == "group", F.when(c("group_at") > 0, group("x", "group_at") != "").otherwise(False)).otherwise(True)
    )
    found = lines.select(c("id").alias("file"), c("p"), "place", F.struct(name.alias("name"), kind.alias("kind"), visible.alias("exported")).alias("d")).filter("d.name <> ''")
    first = found.groupBy("file", "p").agg(F.min_by("d", "place").alias("d"))
    return first.select("file", "d.name", "d.kind", (c("p") + 1).cast("int").alias("line"), "d.exported")


def exports(coded: DataFrame, statements: DataFrame, defined: DataFrame, grammar: Grammar = BUILTIN) -> DataFrame:
    """(file, name): what a file offers: exported definitions, export lists, ``default``, and names exported again."""
    met = coded.select("id", "lang", "code").join(F.broadcast(grammar.exports(coded.sparkSession)), "lang")
    caught = met.select(F.col("id").alias("file"), "what", F.explode(F.expr("regexp_extract_all(code, pattern, name_at)")).alias("x"))
    listed = caught.filter("what = 'list'").select("file", F.explode(F.split("x", ",")).alias("x")).select("file", F.trim(F.regexp_replace("x", r"^[\s\S]*\sas\s+", "")).alias("name"))
    again = statements.filter("kind = 'reexport'").select(F.col("id").alias("file"), F.explode("names.name").alias("name")).filter("name <> '*'")
    named = caught.filter("what = 'name'").select("file", F.col("x").alias("name"))
    own = defined.filter("exported").select("file", "name")
    return own.union(named).union(listed).union(again).filter("name <> ''").distinct()


def told(defined: DataFrame, offered: DataFrame) -> DataFrame:
    """``defined`` with exported also for what an export list names."""
    mark = offered.withColumn("__listed", F.lit(True))
    return defined.join(mark, ["file", "name"], "left").withColumn("exported", F.col("exported") | F.coalesce("__listed", F.lit(False))).select("file", "name", "kind", "line", "exported")


def spaces(coded: DataFrame, grammar: Grammar = BUILTIN) -> DataFrame:
    """(id, lang, ns): the namespace that a file declares, steps parted by points; empty where it declares none."""
    met = coded.select("id", "lang", "code").join(F.broadcast(grammar.namespaces(coded.sparkSession)), "lang")
    return met.select("id", "lang", F.replace(F.expr("regexp_extract(code, pattern, 1)"), F.col("sep"), F.lit(".")).alias("ns"))


def words(coded: DataFrame) -> DataFrame:
    """(id, token, count): identifiers outside comments and strings."""
    return coded.select("id", F.explode(F.regexp_extract_all("blank", F.lit(r"[A-Za-z_$][\w$]*"), 0)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("count"))


def dynamic_uses(coded: DataFrame, grammar: Grammar = BUILTIN, most: int = 12) -> DataFrame:
    """(id, dyn): lines that the graph can't follow, the first ``most``, each by the first pattern that fits it."""
    c = F.col
    met = coded.select("id", "lang", "code").join(F.broadcast(grammar.dynamic(coded.sparkSession)), "lang")
    hits = met.select("id", "place", "what", F.explode(F.filter(F.transform(F.split("code", "\n"), lambda x, i: F.when(F.regexp_like(x, c("pattern")), i + 1)), lambda i: i.isNotNull())).alias("line"))
    first = hits.groupBy("id", "line").agg(F.min_by("what", "place").alias("what"))
    return first.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("line", "what"))), 1, most).alias("dyn"))


def is_type(kind: Column) -> Column:
    return kind.isin(*TYPES)
