"""A repository's tables: files with their measures, edges, history and findings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cochange, graph, history, measures, risk
from ..session import cut
from ..sources import files as tree
from ..sources.languages import BUILTIN, Grammar
from . import bridges, duplicates, insights, links, parse, relations, signals, wording

#: Languages whose files in one folder see each other, so that a cycle there tells nothing.
NAMESPACED = ("csharp", "java", "kotlin", "scala", "php", "go")
#: Dependents that are followed, and listed, of a file; fewer in a large repository.
CAP, CAP_LARGE, LARGE, IDS, IDS_MANY, MANY = 2500, 800, 3000, 300, 30, 400
TOUCHED = "id string, commits long, c30 long, c90 long, c365 long, first timestamp, last timestamp, owner string, owner_share double, bus_factor long, fixes long, fix_rate double, fix_low double, fix_high double, add long, del long, months array<long>, trend string"
#: What a file can have far more of than others, and how that is called.
OUTLIERS = (("c90", "churn"), ("loc", "loc"), ("fan_in", "fanIn"))


@dataclass
class World:
    files: DataFrame
    edges: DataFrame
    packages: DataFrame
    cycles: DataFrame
    communities: DataFrame
    impact: DataFrame
    tested: DataFrame
    symbols: DataFrame
    recursion: DataFrame
    bridges: DataFrame
    folders: DataFrame
    coupling: DataFrame
    findings: DataFrame
    health: DataFrame
    warnings: DataFrame
    pairs: DataFrame | None = None
    timeline: DataFrame | None = None
    shares: DataFrame | None = None
    told: DataFrame | None = None
    about: DataFrame | None = None
    groups: DataFrame | None = None
    members: DataFrame | None = None
    constants: DataFrame | None = None
    homonyms: DataFrame | None = None

    def health_score(self) -> int:
        return self.health.first()["score"]

    def write(self, path: str) -> None:
        """Each table as Parquet under ``path``."""
        for f in fields(self):
            if (df := getattr(self, f.name)) is not None:
                df.write.mode("overwrite").parquet(f"{path}/{f.name}")


def coverage(edges: DataFrame, files: DataFrame, tested: DataFrame) -> DataFrame:
    """(id, coverage): prueba, directa (a test imports it), indirecta (a test reaches it) or ninguna."""
    tests = files.filter("is_test").select(F.lit(1).alias("seed"), F.col("id").alias("node"))
    reached = graph.reach(edges, tests).select(F.col("node").alias("id")).distinct().withColumn("reached", F.lit(True))
    direct = tested.select("id").distinct().withColumn("direct", F.lit(True))
    named = F.when(F.col("is_test"), "prueba").when(F.col("direct"), "directa").when(F.col("reached"), "indirecta").otherwise("ninguna")
    return files.join(direct, "id", "left").join(reached, "id", "left").select("id", named.alias("coverage"))


def told_cycles(found: DataFrame, files: DataFrame) -> DataFrame:
    """``found`` (node, component) without cycles of NAMESPACED languages that lie in one folder."""
    about = found.join(files.select(F.col("id").alias("node"), "lang", "dir"), "node")
    plain = about.groupBy("component").agg(F.bool_and(F.col("lang").isin(*NAMESPACED)).alias("spaced"), F.count_distinct("dir").alias("dirs")).filter("spaced and dirs = 1")
    return found.join(plain, "component", "left_anti")


def touched(dated: DataFrame, now: Column) -> DataFrame:
    """TOUCHED from touches (file_key, path, status, i, ts, author, msg, add, del) whose file still is there, by its newest path."""
    current = dated.groupBy("file_key").agg(F.max_by("path", "i").alias("id"), F.max_by("status", "i").alias("end")).filter("end <> 'D'").select("file_key", "id")
    active = history.activity(dated, "file_key", "ts", now)
    known = history.bus_factor(history.shares(dated, "file_key", "author"), "file_key", "author").drop("authors")
    fixes = history.fix_rate(dated, "file_key", F.col("msg").rlike(text.FIX)).select("file_key", "fixes", F.col("rate").alias("fix_rate"), F.col("low").alias("fix_low"), F.col("high").alias("fix_high"))
    lines = dated.groupBy("file_key").agg(F.coalesce(F.sum("add"), F.lit(0)).cast("long").alias("add"), F.coalesce(F.sum("del"), F.lit(0)).cast("long").alias("del"))
    fixes = fixes.join(lines, "file_key")
    months = F.array(*[F.col(f"m{i}") for i in range(6)])
    trend = history.monthly(dated, "file_key", "ts", now).select("file_key", "trend", months.alias("months"))
    joined = current.join(active, "file_key").join(known, "file_key").join(fixes, "file_key").join(trend, "file_key", "left").na.fill("estable", ["trend"])
    return joined.select("id", "commits", "c30", "c90", "c365", "first", "last", "owner", "owner_share", "bus_factor", "fixes", "fix_rate", "fix_low", "fix_high", "add", "del", F.coalesce("months", F.array_repeat(F.lit(0).cast("long"), 6)).alias("months"), "trend")


def flags() -> Column:
    """A file's flags, in order."""
    c = F.col
    holds = (
        ("ciclo", c("in_cycle")), ("huérfano", c("role") == "orphan"), ("hub", c("role") == "hub"),
        ("sin-pruebas", ~c("is_test") & (c("fan_in") >= 2) & (c("coverage") == "ninguna")),
        ("duplicado", c("dup_sev") == "costosa"), ("propietario-único", c("sole_owner")),
        ("hotspot", (c("c90") >= 3) & (c("fan_in") >= 2)), ("sin-commit", c("status").isin("modified", "untracked", "added")),
        ("generado", c("gen").isNotNull()), ("ejemplo", c("aux")), ("reflexión", c("dynamic")), ("recursión", c("recursive")),
    )
    return F.array_compact(F.array(*[F.when(h, F.lit(name)) for name, h in holds]))


def placed(code: DataFrame) -> DataFrame:
    """(id, pct_c90, pct_loc, pct_fan_in, pct_commits, outlier): each file's place among all, and of what it has far more than others."""
    ranked = ("c90", "loc", "fan_in", "commits")
    out = measures.outliers(cut(code.select("id", *ranked)), dict(OUTLIERS))
    for value in ranked:
        out = measures.ranks(out, value, f"pct_{value}")
    return out.select("id", *[f"pct_{v}" for v in ranked], "outlier")


def folder_rollup(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dir, files, lines, risk, hot, c90, owner) and (from, to, count) of files outside tests."""
    code = files.filter("not is_test")
    rolled = code.groupBy("dir").agg(F.count("*").alias("files"), F.sum("loc").alias("lines"), F.floor(F.avg("score") + 0.5).alias("risk"), F.count_if(F.col("state") == "caliente").alias("hot"), F.sum("c90").alias("c90"))
    most = code.filter("owner is not null").groupBy("dir", "owner").agg(F.count("*").alias("n")).groupBy("dir").agg(F.min_by("owner", F.struct(-F.col("n"), F.col("owner"))).alias("owner"))
    ends = files.select("id", "dir")
    apart = edges.join(ends.select(F.col("id").alias("source"), F.col("dir").alias("from")), "source").join(ends.select(F.col("id").alias("target"), F.col("dir").alias("to")), "target").filter(F.col("from") != F.col("to"))
    return rolled.join(most, "dir", "left"), apart.groupBy("from", "to").agg(F.count("*").alias("count"))


def build(
    spark: SparkSession, sources: DataFrame, *, modules: DataFrame | None = None, commits: DataFrame | None = None, touches: DataFrame | None = None,
    status: DataFrame | None = None, overrides: DataFrame | None = None, aux: tuple[str, ...] = (), aux_off: bool = False, now: str | None = None,
    grammar: Grammar = BUILTIN, parsed: tuple[links.Parsed, DataFrame, DataFrame] | None = None,
    units: DataFrame | None = None, literals: DataFrame | None = None, named: DataFrame | None = None,
) -> World:
    """The world of ``sources`` (id, ext, lang, content), with a history if there is one.

    ``overrides`` (source, target, kind, origin) adds edges, ``aux`` patterns of auxiliary folders;
    ``now`` is the history's last moment unless given.  ``grammar`` has the languages; ``parsed`` is what
    ``links.linked`` gave for the same sources, if that is known already.  ``units``, ``literals`` and ``named`` constants
    (``duplicates.find``) give groups of copies, which then count for risk, flags, findings and health.
    """
    said, linked, packages = parsed or links.linked(sources, modules, grammar)
    coded = said.coded
    noted = cut(parse.comments(coded))
    base = coded.select("id", "lang", "loc", F.size(F.split("content", "\n")).alias("lines"), text.folder(F.col("id")).alias("dir"), grammar.is_test(F.col("lang"), F.col("id")).alias("is_test"), text.generated(F.col("id"), F.col("content")).alias("gen"))
    beside = F.lit(False) if aux_off else F.col("id").rlike("|".join([text.AUXILIARY, *aux]))
    base = base.withColumn("aux", ~F.col("is_test") & beside)
    enough = base.agg((F.count_if(~F.col("aux") & ~F.col("is_test")) >= 3).alias("enough"))
    base = cut(base.crossJoin(F.broadcast(enough)).withColumn("aux", F.col("aux") & F.col("enough")).drop("enough"))
    related, warnings = signals.relations(signals.declared(noted), base)
    plain = sources.join(base.filter("not is_test").select("id"), "id", "left_semi")
    met = cut(bridges.bridges(bridges.routes(plain), bridges.calls(plain)))
    none = F.array().cast("array<string>")
    edges = graph.merge_edges(linked).withColumn("origin", F.lit("code"))
    extra = lambda df, refs, lines: df.select("source", "target", "kind", refs.alias("refs"), lines.alias("lines"), none.alias("specs"), none.alias("symbols"), "origin")
    edges = edges.union(extra(related.withColumn("origin", F.lit("code")), F.lit(0).cast("long"), F.array("line")))
    over = met.groupBy("source", "target").agg(F.count("*").alias("refs"), F.array_sort(F.collect_set("line")).alias("lines")).select("*", F.lit("bridge").alias("kind"), F.lit("code").alias("origin"))
    edges = edges.union(extra(over, F.col("refs"), F.col("lines")))
    if overrides is not None:
        added, _ = relations.overridden(edges.limit(0), base, overrides)
        edges = edges.union(extra(added, F.lit(0).cast("long"), F.array().cast("array<int>")))
    edges = cut(edges)
    tests = base.filter("is_test").select("id")
    n_files = base.count()
    flat = cut(edges.filter("kind <> 'relation'").join(tests.withColumnRenamed("id", "source"), "source", "left_anti").select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", "refs"))
    cycles = cut(told_cycles(graph.cycles(flat.filter("kind <> 'dynamic'").select("src", "dst")), base))
    tested = cut(relations.tested_by(edges, tests))
    defined = said.defined
    recursion = cut(signals.recursion(coded, defined.join(tests.withColumnRenamed("id", "file"), "file", "left_anti")))
    exports = said.offered.groupBy(F.col("file").alias("id")).agg(F.count_distinct("name").alias("exports"))
    again = flat.filter("kind = 'reexport'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("reexports"))
    covered = coverage(edges.filter("kind <> 'relation'").select(F.col("source").alias("src"), F.col("target").alias("dst")), base, tested)
    marked = signals.tags(noted).groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    joined = base.join(graph.degrees(base, flat), "id")
    in_cycle = cycles.select(F.col("node").alias("id"), F.lit(True).alias("in_cycle")).distinct()
    for more in (exports, again, covered, in_cycle, parse.dynamic_uses(coded, grammar), signals.summary(noted), marked, recursion.select("id", F.lit(True).alias("recursive")).distinct()):
        joined = joined.join(more, "id", "left")
    has_git = touches is not None and commits is not None
    pairs = timeline = shared = together = None
    if has_git:
        dated = cut(history.replay(touches).join(commits, "i"))
        last = F.lit(now).cast("timestamp") if now else F.lit(dated.agg(F.max("ts")).first()[0])
        seen = cut(touched(dated, last))
        current = dated.groupBy("file_key").agg(F.max_by("path", "i").alias("id"), F.max_by("status", "i").alias("end")).filter("end <> 'D'").select("file_key", "id")
        alive = dated.join(current, "file_key").join(base.select("id"), "id", "left_semi").select("i", "id")
        linked_ = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
        together = cut(cochange.pair_counts(alive, "i", "id")) if units is not None else None
        skipped = base.filter(F.col("is_test") | F.col("gen").isNotNull() | F.col("aux")).select("id")
        pairs = cut(cochange.strongest(cochange.hidden(cochange.associated(alive, "i", "id", transactions=commits), linked_, skipped)))
        shared = cut(history.shares(dated.join(current, "file_key"), "id", "author"))
        change = dated.groupBy("i").agg(F.count_if(F.col("status").isin("A", "C")).alias("new"), F.count_if(F.col("status") == "D").alias("gone"), F.sum("add").alias("plus"), F.sum("del").alias("minus"))
        timeline = history.timeline(change.withColumns({"step": F.col("new") - F.col("gone"), "size": (F.col("plus") - F.col("minus")).cast("double")}), "i", F.col("step"), F.col("size"))
    else:
        seen, last = spark.createDataFrame([], TOUCHED), F.current_timestamp()
    known = status.select(F.col("path").alias("id"), "status") if status is not None else spark.createDataFrame([], "id string, status string")
    joined = joined.join(seen, "id", "left").join(known, "id", "left")
    full = joined.na.fill(0, ["exports", "reexports", "commits", "c30", "c90", "c365", "fixes"]).na.fill(False, ["in_cycle", "recursive"]).na.fill("", ["summary"])
    sole = (F.coalesce("bus_factor", F.lit(0)) == 1) & (F.col("commits") >= 3)
    copied = None
    if units is not None:
        copied = duplicates.find(units, cut(full.select("id", "is_test", "gen", "aux", "loc", "commits", "owner")), literals=literals, named=named, together=together)
        per = copied.files.select(F.col("file").alias("id"), F.col("lines").alias("dup_lines"), F.col("pct").alias("dup_pct"), F.col("sev").alias("dup_sev"), F.col("groups").alias("dup_groups"), F.col("cost").alias("dup_cost"))
        full = full.join(per, "id", "left").na.fill(0, ["dup_lines", "dup_pct", "dup_groups", "dup_cost"]).na.fill("latente", ["dup_sev"])
    else:
        full = full.withColumns({"dup_pct": F.lit(0.0), "dup_sev": F.lit("latente")})
    full = full.withColumns({
        "dynamic": ~F.col("is_test") & F.col("dyn").isNotNull(), "sole_owner": sole, "skipped": F.col("is_test") | F.col("gen").isNotNull() | F.col("aux"),
        "role": graph.role(F.col("is_test"), F.col("fan_in"), F.col("fan_out"), F.col("fan_out"), F.col("exports"), F.col("reexports")),
    })
    tracked = F.coalesce("status", F.when(F.col("commits") == 0, "untracked").otherwise("clean")) if has_git else F.lit("clean")
    lived = history.state(tracked, history.days_ago(F.col("first"), last), history.days_ago(F.col("last"), last), F.col("c30"), F.col("c90"), F.col("role") == "orphan")
    bare = F.when(~F.col("is_test") & (F.col("role") == "orphan"), "huérfano").otherwise("estable")
    full = full.withColumn("status", tracked if has_git else F.lit(None).cast("string")).withColumn("state", lived if has_git else bare)
    scored = cut(risk.risk(full.withColumn("flags", flags()), has_git=has_git, has_dupes=copied is not None))
    scored = cut(scored.join(placed(scored.filter("not is_test")), "id", "left"))
    hub = scored.select("id", "fan_in")
    ends = flat.join(hub.select(F.col("id").alias("src"), F.col("fan_in").alias("h1")), "src").join(hub.select(F.col("id").alias("dst"), F.col("fan_in").alias("h2")), "dst")
    weight = (1 + 0.15 * F.least("refs", F.lit(5))) / F.log2(2 + F.greatest("h1", "h2"))
    between = related.select(F.col("source").alias("src"), F.col("target").alias("dst")).join(hub.select(F.col("id").alias("src"), F.col("fan_in").alias("h1")), "src").join(hub.select(F.col("id").alias("dst"), F.col("fan_in").alias("h2")), "dst")
    weights = ends.select("src", "dst", weight.alias("weight")).union(between.select("src", "dst", (1.6 / F.log2(2 + F.greatest("h1", "h2"))).alias("weight")))
    if pairs is not None:
        weights = weights.union(pairs.select("a", "b", F.col("strength") * 1.5))
    labels = cut(graph.communities(cut(weights)))
    impacts = cut(graph.impact(flat.select("src", "dst"), base.select("id"), cap=CAP_LARGE if n_files > LARGE else CAP, ids=IDS_MANY if n_files > MANY else IDS))
    told = linked.filter("kind = 'reexport'").select("source", "target", "name")
    uses = linked.filter("kind not in ('reexport', 'dynamic') and name not in ('', '*')").select("source", "target", "name", "count").union(links.members(linked, coded)).union(linked.filter("kind = 'dynamic'").select("source", "target", F.lit("*").alias("name"), F.lit(1).cast("long").alias("count")))
    public = defined.filter("exported").select("file", "name", "kind", "line").dropDuplicates(["file", "name"])
    used = graph.trace(told, uses, public.select("file", "name")).join(tests.withColumnRenamed("id", "user"), "user", "left_anti").groupBy("file", "name").agg(F.sum("count").alias("total"), F.count("*").alias("users"))
    symbols = cut(public.join(used, ["file", "name"], "left").na.fill(0, ["total", "users"]))
    folders, coupling = folder_rollup(scored, flat.select(F.col("src").alias("source"), F.col("dst").alias("target")))
    folders, coupling = cut(folders), cut(coupling)
    groups = members = constants = homonyms = None
    if copied is not None:
        members, constants, homonyms = copied.members, copied.constants, copied.homonyms
        groups = cut(duplicates.extracted(copied.groups, members, coupling, base.select("dir").distinct()))
    findings = insights.findings(scored, cycles=cycles, edges=flat, pairs=pairs, symbols=symbols, recursion=recursion, groups=None if groups is None else (groups, members), literals=None if constants is None else constants.withColumn("value", F.col("key")))
    said_, about = wording.told(
        scored, cycles=cycles, edges=edges.join(tests.withColumnRenamed("id", "source"), "source", "left_anti"), pairs=pairs, symbols=symbols, recursion=recursion,
        groups=groups, members=members, constants=constants, homonyms=homonyms, now=last if has_git else None,
    )
    counts = risk.health_counts(scored, cycles=cycles, pairs=pairs, groups=groups, literals=constants)
    return World(scored, edges, packages, cycles, labels, impacts, tested, symbols, recursion, met, folders, coupling, cut(findings), cut(risk.health(counts)), warnings, pairs, timeline, shared, cut(said_), cut(about), groups, members, constants, homonyms)


def from_tree(spark: SparkSession, root: str, grammar: Grammar = BUILTIN, **more) -> World:
    found = tree.modules(root, grammar)
    modules = spark.createDataFrame(found, "dir string, module string") if found else None
    return build(spark, tree.source_tree(spark, root, grammar), modules=modules, grammar=grammar, **more)


def sets(world: World, saved: DataFrame | None = None) -> DataFrame:
    """(set_key, id): every named set of a world: folders, modules, authors, languages, states, risks, coverage, roles, flags, tags, packages, saved ones, hot and much used files."""
    files, code = world.files, world.files.filter("not is_test")
    steps = F.split("dir", "/")
    upper = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    keyed = lambda df, kind, col: df.filter(F.col(col).isNotNull()).select(F.concat(F.lit(f"{kind}:"), F.col(col).cast("string")).alias("set_key"), "id")
    out = keyed(code.select("id", F.explode(upper).alias("d")).filter("d not in ('(raíz)', '(externo)')"), "dir", "d")
    for kind, col in (("lang", "lang"), ("state", "state"), ("risk", "level"), ("cov", "coverage"), ("role", "role")):
        out = out.union(keyed(code, kind, col))
    if world.shares is not None:
        out = out.union(keyed(world.shares.filter("share >= 0.2").join(code.select("id"), "id", "left_semi"), "author", "author"))
    out = out.union(keyed(code.select("id", F.explode("flags").alias("f")), "flag", "f")).union(keyed(files.select("id", F.explode("tags").alias("t")), "tag", "t"))
    out = out.union(keyed(world.communities.select(F.col("node").alias("id"), "community"), "mod", "community"))
    out = out.union(world.packages.select(F.col("target").alias("set_key"), F.col("source").alias("id")))
    out = out.union(code.filter("c90 >= 3").select(F.lit("hot").alias("set_key"), "id")).union(code.filter("fan_in >= 3").select(F.lit("many").alias("set_key"), "id"))
    if saved is not None:
        out = out.union(saved.select(F.concat(F.lit("saved:"), "name").alias("set_key"), "id"))
    return out.distinct()
