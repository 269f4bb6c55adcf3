"""What edges say about files: tests and what they test, cardinality, overrides, languages, modules of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.history import days_ago


def tested_by(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, test): the tests (id) whose own edges (source, target, kind), relations aside, lead to a file."""
    return edges.filter("kind <> 'relation'").join(tests.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"), F.col("source").alias("test")).distinct()


def cardinality(edges: DataFrame, exports: DataFrame) -> DataFrame:
    """``edges`` (source, target, kind, refs, symbols) with used, exports and ratio: how much of what the target exports (id, n) it uses.

    ``*`` alone uses all; ratio is null where nothing is exported.  Relations have none of it.
    """
    named = F.filter("symbols", lambda s: s != "*")
    joined = edges.filter("kind <> 'relation'").join(exports.select(F.col("id").alias("target"), F.col("n").alias("exports")), "target", "left").na.fill(0, ["exports"])
    used = F.when(F.size(named) > 0, F.size(named)).when(F.array_contains("symbols", "*"), F.col("exports")).otherwise(0)
    ratio = F.when(F.col("exports") > 0, F.floor(F.col("used") / F.col("exports") * 100 + 0.5) / 100)
    return joined.withColumn("used", used.cast("long")).withColumn("ratio", ratio)


def overridden(edges: DataFrame, nodes: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ignored): ``edges`` (source, target, kind, origin) with those of ``overrides`` whose ends are ``nodes`` (id); the others are ignored."""
    ends = lambda of, how: of.join(nodes.select(F.col("id").alias("source")), "source", how)
    there = ends(overrides, "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    columns = ["source", "target", F.coalesce("kind", F.lit("relation")).alias("kind"), F.coalesce("origin", F.lit("manual")).alias("origin")]
    return edges.select("source", "target", "kind", "origin").union(there.select(*columns)), overrides.select("source", "target").exceptAll(there.select("source", "target"))


def languages(files: DataFrame) -> DataFrame:
    """(lang, files), most first in order."""
    return files.groupBy("lang").agg(F.count("*").alias("files"))


def module_of_tests(edges: DataFrame, tests: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, community): a test belongs where the first file that it leads to, by edge, and that is no test does; -1 for none."""
    aside = tests.select(F.col("id").alias("target"))
    first = edges.join(tests.select(F.col("id").alias("source")), "source", "left_semi").join(aside, "target", "left_anti").groupBy("source").agg(F.min_by("target", F.struct("target", "kind")).alias("target"))
    named = first.join(communities.select(F.col("node").alias("target"), "community"), "target", "left")
    return tests.select("id").join(named.select(F.col("source").alias("id"), "community"), "id", "left").select("id", F.coalesce(F.col("community").cast("string"), F.lit("-1")).alias("community"))


def impact_tests(impacts: DataFrame, tested: DataFrame, changed: DataFrame) -> DataFrame:
    """(test, why, of, via): tests to run for the ``changed`` files (id): their own, then those of who depends on them.

    ``impacts`` has node, ids and direct; ``tested`` id and test.  A test has one reason, the nearest: ``of`` is the changed file, ``via`` the one that it tests.
    """
    own = changed.select(F.col("id").alias("of"), "id", F.lit(0).alias("rank"))
    far = impacts.join(changed.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("node").alias("of"), "direct", F.posexplode("ids").alias("p", "id"))
    reached = own.union(far.select("of", "id", F.when(F.col("p") < F.col("direct"), 1).otherwise(2).alias("rank")))
    met = reached.join(tested, "id").groupBy("test").agg(F.min(F.struct("rank", "of", "id")).alias("r"))
    why = F.when(F.col("r.rank") == 0, "prueba directa").when(F.col("r.rank") == 1, "prueba de quien depende").otherwise("afectada indirectamente")
    return met.select("test", why.alias("why"), F.col("r.of").alias("of"), F.col("r.id").alias("via"))


def months(rows: DataFrame, item: str, ts: str, now: Column, *, last: int = 40, bins: int = 12) -> DataFrame:
    """(item, bin, n): the ``last`` touches of each item in the ``bins`` months of 30 days before ``now``, oldest 0."""
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.col(ts).desc()))
    age = F.floor(days_ago(F.col(ts), now) / 30)
    kept = rows.withColumn("__place", place).filter(F.col("__place") <= last).withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") < bins))
    return kept.groupBy(item, (bins - 1 - F.col("age")).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def author_totals(rows: DataFrame, author: str) -> DataFrame:
    """(author, commits)."""
    return rows.groupBy(author).agg(F.count("*").alias("commits"))
