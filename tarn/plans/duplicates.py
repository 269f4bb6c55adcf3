"""Copies in a repository: groups of equal and similar units, what each costs to keep, literals that want a name, and homonyms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clones
from ..session import cut

#: How a unit without a name is called; units of fewer tokens or lines are no units; occurrences shown of a literal.
ANONYMOUS, TOKENS, LINES, SHOWN = "(anónima)", 40, 5, 12
LITERALS = "value string, kind string, file string, line int"


@dataclass
class Duplicates:
    """groups: group, id, name, type, sim, lines, tokens, copies, files, same_file, test, co_rate, co_count, owners, sev, score.
    members: group, unit, file, name, start, end, test.  files: file, lines, pct, groups, sev, cost.  constants: key, value,
    kind, count, files, sev, at, existing.  homonyms: name, file, start, files, units."""

    groups: DataFrame
    members: DataFrame
    files: DataFrame
    constants: DataFrame
    homonyms: DataFrame


def sized(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, file, name, kind, start, end, test, loc, len, hash, raw_hash, rep, tokens) of units worth comparing.

    ``units`` has unit (unique), file, name, kind, start, end (inclusive), tokens (names and literals made alike) and raw (tokens
    as they are, one text); ``files`` id, is_test, gen and aux.  Small units go, and those of files that aren't
    known, or are generated or auxiliary.  rep is the first unit, by file and line, of the same tokens.
    """
    known = files.filter(F.col("gen").isNull() & ~F.col("aux")).select(F.col("id").alias("file"), F.col("is_test").alias("test"))
    loc, length = F.col("end") - F.col("start") + 1, F.size(F.coalesce("tokens", F.array().cast("array<string>")))
    large = units.join(known, "file").filter((loc >= LINES) & (length >= TOKENS))
    hashed = large.select(
        "unit", "file", F.when((F.col("name") != "") & (F.col("name") != ANONYMOUS), F.col("name")).alias("name"), "kind", "start", "end", "test",
        loc.alias("loc"), length.alias("len"), F.sha2(F.array_join("tokens", " "), 256).alias("hash"), F.sha2(F.coalesce("raw", F.lit("")), 256).alias("raw_hash"), "tokens",
    )
    hashed = cut(hashed)
    first = hashed.groupBy("hash").agg(F.min_by("unit", F.struct("file", "start", "unit")).alias("rep"))
    return cut(hashed.join(first, "hash"))


def grouped(units: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, groups) from ``sized`` units.  One unit of each class of equal ones is compared with others, so copies make no
    pairs; units that overlap in a file are no copies of each other, and of nested ones the longest stays."""
    reps = units.filter("unit = rep")
    pairs = cut(clones.apart(clones.near_sets(cut(clones.shingle_sets(reps, "unit", F.col("tokens"))), similarity=similarity), reps))
    linked = cut(clones.groups(pairs))
    named = units.join(linked.withColumnRenamed("unit", "rep"), "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    members = cut(clones.outermost(named.drop("tokens", "rep")))
    told = clones.summary(members, pairs, units.select("unit", "rep")).drop("sim")
    # all pairs of a group count, those of units that lay in longer ones too
    sims = pairs.join(linked.withColumnRenamed("unit", "a"), "a").groupBy("group").agg(F.floor(F.min("sim") * 100 + 0.5).alias("least"))
    alike = F.when(F.col("type") == "similar", F.coalesce("least", F.lit(100)) / 100).otherwise(1.0)
    return members, told.join(sims, "group", "left").withColumn("sim", alike).drop("least")


def costed(groups: DataFrame, members: DataFrame, files: DataFrame, together: DataFrame | None = None) -> DataFrame:
    """``groups`` with id (d0 is the dearest), co_rate, co_count, owners, sev and score.

    ``files`` has id, commits and owner, null both where there is no history; ``together`` (a, b, count) counts common
    commits.  Without a history no group is known to cost anything.
    """
    by = files.select(F.col("id").alias("file"), F.col("commits").cast("long").alias("commits"), "owner")
    owners = members.select("group", "file").distinct().join(by, "file").groupBy("group").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    out = groups.join(owners, "group", "left")
    if together is not None:
        out = out.join(clones.co_rate(members, together, by.filter("commits > 0").select("file", "commits")), "group", "left")
    else:
        out = out.withColumns({"co_rate": F.lit(None).cast("double"), "co_count": F.lit(None).cast("long")})
    out = out.na.fill(0, ["co_rate", "co_count"])
    score = clones.cost(F.col("lines"), F.col("copies"), F.col("co_rate"), F.size("owners"), F.col("test"), F.col("files"))
    return clones.ranked(cut(out.withColumns({"sev": clones.severity(F.col("test"), F.col("co_rate"), F.col("co_count")), "score": score})))


def constants(literals: DataFrame, named: DataFrame, files: DataFrame) -> DataFrame:
    """(key, value, kind, count, files, sev, at, existing): literals that are repeated, tests aside.

    ``literals`` (value, kind, file, line) with kind num or str, ``named`` the same with name: constants that hold one.  ``at`` has the
    first SHOWN occurrences; existing is the first constant of the value by file and line.
    """
    key = F.concat_ws(":", "kind", "value")
    own = files.filter(~F.col("is_test") & F.col("gen").isNull() & ~F.col("aux")).select(F.col("id").alias("file"))
    rows = literals.join(own, "file", "left_semi").withColumn("key", key)
    found = cut(clones.repeated_literals(rows, "key", "file").drop("sample"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("file", "line"))
    first = rows.join(found.select("key"), "key", "left_semi").withColumn("p", place).filter(F.col("p") <= SHOWN)
    at = first.groupBy("key").agg(F.min("value").alias("value"), F.min("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("file", "line"))).alias("at"))
    return clones.named_constant(found.join(at, "key"), named.withColumn("key", key).select("key", "file", "name", "line"), "key")


def homonyms(units: DataFrame, members: DataFrame) -> DataFrame:
    """(name, file, start, files, units): names of units in two files or more that aren't copies, tests and callbacks aside; start is the first in the file."""
    alone = units.filter(~F.col("test") & F.col("name").isNotNull() & (F.coalesce("kind", F.lit("")) != "callback")).join(members.select("unit"), "unit", "left_anti")
    alone = cut(alone.select("name", "file", "start"))
    per = alone.groupBy("name", "file").agg(F.count("*").alias("n"), F.min("start").alias("start"))
    found = clones.homonyms(alone, "name", "file").withColumnRenamed("owner", "file")
    counts = per.groupBy("name").agg(F.sum("n").alias("units"))
    return found.join(per.drop("n"), ["name", "file"]).join(counts, "name").select("name", "file", "start", "files", "units")


def find(units: DataFrame, files: DataFrame, *, literals: DataFrame | None = None, named: DataFrame | None = None, together: DataFrame | None = None) -> Duplicates:
    """All of the above from units, literals and named constants; ``files`` has id, is_test, gen, aux, loc, commits and owner."""
    spark = units.sparkSession
    compared = sized(units, files)
    members, groups = grouped(compared)
    groups = cut(costed(groups, members, files, together))
    per = clones.duplicated(members, groups, files.select(F.col("id").alias("file"), "loc"))
    literals = literals if literals is not None else spark.createDataFrame([], LITERALS)
    named = named if named is not None else spark.createDataFrame([], LITERALS + ", name string")
    shown = members.select("group", "unit", "file", "name", "start", "end", "test")
    return Duplicates(groups, shown, cut(per), cut(constants(literals, named, files)), cut(homonyms(compared, members)))


def extracted(groups: DataFrame, members: DataFrame, coupling: DataFrame, folders: DataFrame) -> DataFrame:
    """``groups`` with dir, file, warn and suggest, the words for where the copies could be put once."""
    placed = clones.suggestion(groups, members, coupling, folders).withColumnRenamed("file", "to")
    first = members.groupBy("group").agg(F.element_at(F.split(F.min("file"), "/"), -1).alias("first"))
    name = F.coalesce("name", F.lit("compartido"))
    how = F.when(F.col("type") == "similar", " Las copias difieren un poco: unifica primero las diferencias como parámetros.").when(F.col("type") == "parametrizado", " Solo cambian los nombres: se puede extraer tal cual.").otherwise(" Son idénticas: extracción directa.")
    moved = F.concat(F.lit("Mueve "), name, F.lit("() a "), "to", F.lit(" y importa desde "), F.col("files").cast("string"), F.when(F.col("files") > 1, " archivos.").otherwise(" archivo."), how)
    local = F.concat(F.lit("Extrae una función local en "), "first", F.lit(" y llámala desde cada copia."))
    out = groups.join(placed, "group", "left").join(first, "group", "left")
    return out.withColumn("suggest", F.when(F.col("same_file"), local).otherwise(moved)).withColumn("warn", F.when(~F.col("same_file"), F.transform("warn", lambda to: F.concat("dir", F.lit(" ya depende de "), to, F.lit(": importarlo desde ahí crearía una dependencia circular"))))).drop("first")
