"""Findings that point at files: one DataFrame for each rule, put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How grave findings are, in order.
SEVERITIES = ("alta", "media", "info")


def _first(rows: DataFrame, kind: str, sev: Column, order: list[Column], most: int | None, id_col: str = "id") -> DataFrame:
    """(kind, sev, id, place) of the ``most`` first rows in order; all where there is no bound, which are placed 1."""
    if most is None:
        return rows.select(F.lit(kind).alias("kind"), sev.alias("sev"), F.col(id_col).alias("id"), F.lit(1).alias("place"))
    top = rows.select(sev.alias("sev"), F.col(id_col).alias("id"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate([*order, F.col(id_col)])]).alias("o")).orderBy("o").limit(most)
    return top.select(F.lit(kind).alias("kind"), "sev", "id", F.row_number().over(Window.orderBy("o")).alias("place"))


def file_findings(files: DataFrame, *, hot: int = 3) -> DataFrame:
    """(kind, sev, id, place) from scored files, skipped ones aside.

    The four riskiest hotspots; untested files that two or more use and that are no hotspots; files of
    four commits and 40 lines or more that one person knows and that are no hotspots; orphans;
    generated, dynamic and recursive files; and what isn't committed.
    """
    own, c = files.filter(~F.col("skipped")), F.col
    hotspot = (c("c90") >= hot) & (c("fan_in") >= 2)
    lit = lambda s: F.lit(s)
    found = [
        _first(own.filter(hotspot), "hotspot", F.when(c("level") == "alto", "alta").otherwise("media"), [-c("score")], 4),
        _first(own.filter(~hotspot & (c("fan_in") >= 2) & (c("coverage") == "ninguna")), "pruebas", lit("media"), [], None),
        _first(own.filter(~hotspot & c("sole_owner") & (c("commits") >= 4) & (c("loc") >= 40)), "dueño", lit("media"), [], None),
        _first(own.filter(c("role") == "orphan"), "huérfano", lit("info"), [], None),
    ]
    for kind, holds, of in (("generado", "gen is not null", files), ("reflexión", "dynamic", own), ("recursión", "recursive", own), ("trabajo", "status in ('modified', 'untracked', 'added')", files)):
        if {"gen", "dynamic", "recursive", "status"} <= set(files.columns):
            found.append(_first(of.filter(holds), kind, lit("info"), [], None))
    return reduce(DataFrame.unionByName, found)


def cycle_findings(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, weakest_src, weakest_dst): of each cycle the edge in it that is used least."""
    c = lambda x: cycles.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    inner = edges.join(c("src"), "src").join(c("dst"), "dst").filter("c_src = c_dst")
    weakest = inner.groupBy(F.col("c_src").alias("component")).agg(F.min(F.struct("refs", "src", "dst")).alias("w"))
    return weakest.select("component", F.col("w.src").alias("weakest_src"), F.col("w.dst").alias("weakest_dst"))


def pair_findings(pairs: DataFrame) -> DataFrame:
    """The four strongest hidden pairs, both sides of each."""
    top = _first(pairs.filter("hidden").withColumn("id", F.concat_ws("|", "a", "b")), "acoplamiento", F.when(F.col("strength") >= 0.8, "alta").otherwise("media"), [-F.col("count") * F.col("strength")], 4)
    return top.withColumn("id", F.explode(F.split("id", r"\|")))


def group_findings(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The five dearest groups of copies that cost (group, sev, score), and all latent ones, by their files (group, file)."""
    dear = _first(groups.filter("sev = 'costosa'"), "duplicación", F.when(F.col("score") >= 60, "alta").otherwise("media"), [-F.col("score")], 5, "group")
    found = dear.unionByName(_first(groups.filter("sev = 'latente'"), "duplicación", F.lit("info"), [], None, "group"))
    files = members.select(F.col("group").alias("id"), "file").distinct()
    return found.join(files, "id").select("kind", "sev", F.col("file").alias("id"), "place")


def literal_findings(literals: DataFrame, value: str, names: DataFrame | None = None) -> DataFrame:
    """The four literals (value, count, files, sev) in most files, and the two names (name, owner, files) in most."""
    found = _first(literals, "constante", F.col("sev"), [-F.col("files"), -F.col("count")], 4, value)
    if names is None:
        return found
    return found.unionByName(_first(names.select("name", "files").distinct(), "homónimo", F.lit("info"), [-F.col("files")], 2, "name"))


def findings(files: DataFrame, *, cycles: DataFrame, edges: DataFrame, pairs: DataFrame | None = None, symbols: DataFrame | None = None, recursion: DataFrame | None = None, groups: tuple[DataFrame, DataFrame] | None = None, literals: DataFrame | None = None) -> DataFrame:
    """(kind, sev, id, place, rank): all rules over a repository's tables; rank 0 is the gravest."""
    out = [file_findings(files)]
    weakest = cycle_findings(cycles, edges)
    ring = F.dense_rank().over(Window.orderBy("component"))
    numbered = weakest.withColumn("place", ring)
    out.append(cycles.join(numbered, "component").select(F.lit("ciclo").alias("kind"), F.lit("alta").alias("sev"), F.col("node").alias("id"), "place"))
    if pairs is not None:
        out.append(pair_findings(pairs))
    if symbols is not None:
        shown = files.filter("not skipped and role not in ('entry', 'orphan')").select(F.col("id").alias("file"))
        out.append(symbols.filter("total = 0").join(shown, "file", "left_semi").select(F.lit("exports").alias("kind"), F.lit("info").alias("sev"), F.col("file").alias("id"), F.lit(1).alias("place")).distinct())
    if groups is not None:
        out.append(group_findings(*groups))
    if literals is not None:
        out.append(literal_findings(literals, "value"))
    rank = F.coalesce(*[F.when(F.col("sev") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)])
    return reduce(DataFrame.unionByName, out).withColumn("rank", rank)
