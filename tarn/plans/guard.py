"""Before and after a change: what to know first, a print of the structure, and what got worse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import check
from ..session import cut
from ..sources import history
from . import relations, world

#: Rules that compare signatures: (kind of signature, rule, how grave a new one is).
SIGNED = (("cycle", "ciclo nuevo", "revisar"), ("dup", "duplicación nueva", "revisar"), ("bridge", "puente nuevo", "nota"))


def signatures(*, cycles: DataFrame | None = None, groups: DataFrame | None = None, bridges: DataFrame | None = None, like: DataFrame) -> DataFrame:
    """(kind, signature, id): a row for each file of a cycle (node, component), of a clone group (group, name, file) and of a bridge (source, target)."""
    spark = like.sparkSession
    out = [spark.createDataFrame([], "kind string, signature string, id string")]
    if cycles is not None:
        whole = cycles.groupBy("component").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "|"), 256).alias("signature"))
        out.append(cycles.join(whole, "component").select(F.lit("cycle").alias("kind"), "signature", F.col("node").alias("id")))
    if groups is not None:
        if "test" in groups.columns:  # copies among tests alone are no worry
            groups = groups.filter("not test")
        each = groups.select("group", "name", "file").distinct()
        whole = each.groupBy("group", "name").agg(F.concat_ws("|", F.coalesce(F.first("name"), F.lit("(anónima)")), F.array_join(F.array_sort(F.collect_set("file")), ",")).alias("signature")).select("group", "signature")
        out.append(each.join(whole, "group").select(F.lit("dup").alias("kind"), "signature", F.col("file").alias("id")))
    if bridges is not None:
        out.append(bridges.select(F.lit("bridge").alias("kind"), F.concat("source", F.lit("→"), "target").alias("signature"), F.col("source").alias("id")).distinct())
    return reduce(DataFrame.union, out)


def fingerprint(files: DataFrame) -> DataFrame:
    """(id, risk, fan_in, covered, dynamic, loc, skipped, test): what ``check`` compares of scored files."""
    return files.select("id", F.col("score").alias("risk"), "fan_in", (F.col("coverage") != "ninguna").alias("covered"), F.col("dynamic").alias("dynamic"), "loc", "skipped", F.col("is_test").alias("test"))


def compare(before: DataFrame, after: DataFrame, signed_before: DataFrame, signed_after: DataFrame, health: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(rule, sev, id, signature): all that a change made worse, from two prints, their signatures and both healths.

    A new duplicate counts only where one of its files is new or changed its size.  ``resuelto`` rows
    are cycles and duplicates that are gone.
    """
    found = check(before, after).select("rule", "sev", "id", F.lit(None).cast("string").alias("signature"))
    old, new = (s.select("kind", "signature").distinct() for s in (signed_before, signed_after))
    sizes = after.select("id", F.col("loc").alias("now")).join(before.select("id", F.col("loc").alias("was")), "id", "left")
    touched = sizes.filter("was is null or was <> now").select("id")
    fresh = signed_after.join(old, ["kind", "signature"], "left_anti")
    live = fresh.join(touched, "id", "left_semi").select("kind", "signature").distinct()
    counted = fresh.filter("kind <> 'dup'").unionByName(fresh.filter("kind = 'dup'").join(live, ["kind", "signature"], "left_semi"))
    named = counted.groupBy("kind", "signature").agg(F.min("id").alias("id"))
    rule = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r, _ in SIGNED])
    sev = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, _, s in SIGNED])
    gone = signed_before.filter("kind <> 'bridge'").join(new, ["kind", "signature"], "left_anti").groupBy("kind", "signature").agg(F.min("id").alias("id"))
    out = found.union(named.select(rule, sev, "id", "signature")).union(gone.select(F.lit("resuelto"), F.lit("info"), "id", "signature"))
    if None not in health and health[1] - health[0] <= -3:
        out = out.union(after.sparkSession.createDataFrame([("salud", "revisar", None, None)], "rule string, sev string, id string, signature string"))
    return out


def level(found: DataFrame) -> str:
    """A review's level: alto with a new cycle or three findings to look at, medio with any, else bajo."""
    n = found.filter("sev = 'revisar'").agg(F.count("*").alias("n"), F.count_if(F.col("rule") == "ciclo nuevo").alias("cycles")).first()
    return "alto" if n["cycles"] or n["n"] >= 3 else "medio" if n["n"] else "bajo"


def reviewers(files: DataFrame, changed: DataFrame, most: int = 3) -> DataFrame:
    """(owner, files): who owns most of the changed files (id)."""
    owned = files.join(changed, "id", "left_semi").filter("owner is not null").groupBy("owner").agg(F.count("*").alias("files"))
    return owned.orderBy(F.col("files").desc(), "owner").limit(most)


def facts(files: DataFrame, impacts: DataFrame, changed: DataFrame) -> DataFrame:
    """What to know of each of the ``changed`` files (id) before it is changed: known, role, score, state, owner, impact."""
    about = files.select("id", "role", "score", "level", "state", "owner", "fan_in", "coverage", "gen", "aux", "in_cycle", "dynamic")
    reach = impacts.select(F.col("node").alias("id"), "total", "direct", "depth", "capped", F.slice("ids", 1, 8).alias("dependents"))
    joined = changed.select("id").distinct().join(about, "id", "left").join(reach, "id", "left")
    return joined.withColumn("known", F.col("role").isNotNull())


def warnings(told: DataFrame, pairs: DataFrame | None = None, members: DataFrame | None = None, bridges: DataFrame | None = None, cycles: DataFrame | None = None) -> DataFrame:
    """(id, kind, other): what ``facts`` warn of; other is the file that it is about, where it is about one."""
    none = F.lit(None).cast("string")
    flag = lambda kind, holds: F.when(holds, F.lit(kind))
    own = F.array_compact(
        F.array(
            flag("desconocido", ~F.col("known")),
            flag("generado", F.col("gen").isNotNull()),
            flag("ejemplo", F.col("aux")),
            flag("reflexión", F.col("dynamic")),
            flag("impacto cortado", F.col("capped")),
            flag("sin pruebas", (F.col("coverage") == "ninguna") & (F.col("fan_in") >= 1)),
        )
    )
    asked = told.select("id")
    out = [told.select("id", F.explode(own).alias("kind"), none.alias("other"))]
    if cycles is not None:
        a, b = cycles.select(F.col("node").alias("id"), "component"), cycles.select(F.col("node").alias("other"), "component")
        out.append(asked.join(a, "id").join(b, "component").filter("id <> other").select("id", F.lit("ciclo"), "other"))
    if pairs is not None:
        either = pairs.filter("hidden").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p")).select("p.*")
        out.append(either.join(asked, "id", "left_semi").select("id", F.lit("cambia con"), "other"))
    if members is not None:
        mine = members.select("group", F.col("file").alias("id")).distinct().join(asked, "id", "left_semi")
        out.append(mine.join(members.select("group", F.col("file").alias("other")).distinct(), "group").filter("id <> other").select("id", F.lit("copia"), "other").distinct())
    if bridges is not None:
        ends = bridges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(bridges.select("target", "source")).distinct()
        out.append(ends.join(asked, "id", "left_semi").select("id", F.lit("por HTTP"), "other"))
    return reduce(DataFrame.union, out)


def plan(files: DataFrame, impacts: DataFrame, tested: DataFrame, changed: DataFrame, **more: DataFrame) -> dict[str, DataFrame]:
    """facts, ripple (id, direct), tests to run and warnings for the ``changed`` files (id)."""
    told = facts(files, impacts, changed)
    each = impacts.join(changed.select(F.col("id").alias("node")), "node", "left_semi").select("direct", F.posexplode("ids").alias("p", "id"))
    ripple = each.join(changed, "id", "left_anti").groupBy("id").agg(F.bool_or(F.col("p") < F.col("direct")).alias("direct"))
    return {"facts": told, "ripple": ripple, "tests": relations.impact_tests(impacts, tested, changed), "warnings": warnings(told, **more)}


def measured(spark: SparkSession, root: str, ref: str = "HEAD") -> tuple[world.World, world.World, DataFrame, DataFrame]:
    """(before, after, findings, changed) of the tree at ``root`` against ``ref``.  Both trees are measured without history, as the base has none."""
    changed = history.changed_since(spark, root, ref)
    with history.base_tree(root, ref) as base:
        old, new = world.from_tree(spark, base), world.from_tree(spark, root)
        signed = [signatures(cycles=w.cycles, bridges=w.bridges, like=w.files) for w in (old, new)]
        found = compare(fingerprint(old.files), fingerprint(new.files), *signed, (old.health_score(), new.health_score()))
        found = cut(found)
    return old, new, found, changed
