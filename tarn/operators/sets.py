"""Named sets of rows, and the regions that they cut each other into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem

#: Sets that one region table can tell apart.
MOST = 6


def membership(rows: DataFrame, id_col: str, sets: dict[str, Column]) -> DataFrame:
    """(set_key, id): the rows that each predicate holds for, from one scan."""
    keys = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in sets.items()]))
    return rows.select(F.explode(keys).alias("set_key"), F.col(id_col).alias("id"))


def labelled(rows: DataFrame, id_col: str, kind: str, labels: Column) -> DataFrame:
    """(set_key, id): a set ``kind:label`` for each of a row's labels."""
    return rows.select(F.col(id_col).alias("id"), F.explode(labels).alias("l")).select(F.concat(F.lit(f"{kind}:"), "l").alias("set_key"), "id").distinct()


def masks(members: DataFrame, keys: list[str]) -> DataFrame:
    """(id, mask): bit i is set if the id is in the set keys[i]."""
    if not 0 < len(keys) <= MOST:
        raise ValueError(f"1 to {MOST} sets")
    bit = F.coalesce(*[F.when(F.col("set_key") == k, F.lit(1 << i)) for i, k in enumerate(keys)])
    return members.filter(F.col("set_key").isin(keys)).groupBy("id").agg(F.bit_or(bit).alias("mask"))


def regions(members: DataFrame, keys: list[str]) -> DataFrame:
    """(mask, n): how many ids are in exactly the sets that the mask tells."""
    return masks(members, keys).groupBy("mask").agg(F.count("*").alias("n"))


def upset(region: DataFrame, keys: list[str], rows: int = 14) -> DataFrame:
    """The ``rows`` largest regions with a column of dots for each set."""
    dots = [(F.col("mask").bitwiseAND(1 << i) != 0).alias(f"in_{i}") for i in range(len(keys))]
    return region.orderBy(F.col("n").desc(), "mask").limit(rows).select("mask", "n", *dots)


def sizes(members: DataFrame) -> DataFrame:
    """(kind, set_key, n): sizes of all sets that aren't empty; the kind is what stands before the colon."""
    return members.groupBy("set_key").agg(F.count_distinct("id").alias("n")).select(F.split_part("set_key", F.lit(":"), F.lit(1)).alias("kind"), "set_key", "n")


#: The families in which sets are offered: name, kinds, members at least, and the keys if not all of a kind are offered.
FAMILIES = (
    ("Carpetas", ("dir",), 2, ()), ("Módulos detectados", ("mod",), 2, ()), ("Autores", ("author",), 1, ()), ("Lenguajes", ("lang",), 1, ()),
    ("Riesgo y pruebas", ("risk", "cov", "many", "hot"), 1, ("risk:alto", "risk:medio", "cov:ninguna", "cov:directa", "cov:indirecta", "many", "hot")),
    ("Banderas", ("flag",), 1, ()), ("Estados", ("state",), 1, ()), ("Paquetes externos", ("pkg",), 2, ()), ("Mis conjuntos", ("saved",), 1, ()), ("Etiquetas @set", ("tag",), 1, ()),
)


def catalog(members: DataFrame) -> DataFrame:
    """(family, place, set_key, n): the sets that are offered, in ten families, each from the largest on; folders, modules and
    packages of one file aren't, nor the root folder."""
    found = sizes(members).filter("set_key not in ('dir:(raíz)', 'dir:(externo)')")
    family = F.coalesce(*[F.when(F.col("kind").isin(*kinds) & (F.col("n") >= least) & (F.col("set_key").isin(*keys) if keys else F.lit(True)), name) for name, kinds, least, keys in FAMILIES])
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.col("n").desc(), "set_key"))
    return found.withColumn("family", family).filter("family is not null").select("family", place.alias("place"), "set_key", "n")


def label(key: Column, name: Column | None = None) -> Column:
    """A set key as people read it; ``name`` is what a module, an author or a language is called, if that is known."""
    rest = F.regexp_replace(key, "^[^:]*:", "")
    told = F.coalesce(name, rest) if name is not None else rest
    kind = F.split_part(key, F.lit(":"), F.lit(1))
    # How each kind of set is called.
    before = {"dir": "", "state": "estado ", "risk": "riesgo ", "flag": "", "role": "", "tag": "@set ", "saved": "★ ", "pkg": ""}
    out = F.when(kind == "hot", "cambia seguido").when(kind == "many", "muchos dependientes").when(key == "cov:ninguna", "sin pruebas").when(kind == "cov", F.concat(F.lit("prueba "), rest))
    out = out.when(kind == "mod", told if name is not None else F.concat(F.lit("módulo "), rest)).when(kind.isin("author", "lang"), told)
    out = out.when(kind == "deps", F.concat(F.lit("de qué depende "), stem(rest))).when(kind == "reach", F.concat(F.lit("a quién afecta "), stem(rest)))
    for k, b in before.items():
        out = out.when(kind == k, F.concat(F.lit(b), rest))
    return out.otherwise(key)


#: Picks of sets that answer a question together.
RECIPES = ("folder-module", "critical", "knowledge", "layers", "langs")


def picks(members: DataFrame, name: str) -> list[str]:
    """The keys that a recipe takes, two to three; none where there aren't enough.

    critical: high risk, no tests, many users.  knowledge: the three authors of most files.  layers: the
    three packages that most files use.  langs: the first three languages.  folder-module: the folder
    of most files, one within another or of three files, and the two modules that have most of them.
    """
    top = lambda df, order, n=3: [r["set_key"] for r in df.orderBy(*order, "set_key").limit(n).collect()]
    if name == "critical":
        return ["risk:alto", "cov:ninguna", "many"]
    by_size = sizes(members)
    if name == "folder-module":
        # a folder's own files, without those of folders in it
        deeper = members.filter("set_key like 'dir:%'").select("id", "set_key", F.length("set_key").alias("n"))
        own = deeper.groupBy("id").agg(F.max_by("set_key", "n").alias("set_key")).groupBy("set_key").agg(F.count("*").alias("n"))
        folder = top(own.filter("set_key like '%/%' or n >= 3"), [F.col("n").desc()], 1)
        if not folder:
            return []
        inside = members.filter(F.col("set_key") == folder[0]).select("id")
        large = by_size.filter("kind = 'mod' and n >= 2").select("set_key")
        shared = members.join(large, "set_key", "left_semi").join(inside, "id", "left_semi").groupBy("set_key").agg(F.count_distinct("id").alias("n"))
        found = top(shared, [F.col("n").desc()], 2)
        return folder + found if found else []
    if name == "langs":
        found = top(members.filter("set_key like 'lang:%'").groupBy("set_key").agg(F.min("id").alias("first")), [F.col("first")])
    else:
        kind, least = {"knowledge": ("author", 1), "layers": ("pkg", 2)}[name]
        found = top(by_size.filter((F.col("kind") == kind) & (F.col("n") >= least)), [F.col("n").desc()])
    return found if len(found) >= 2 else []


def recipe(members: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """(regions, keys) of one of RECIPES; the only rows that the driver sees are those keys."""
    keys = picks(members, name)
    return (regions(members, keys) if keys else members.select(F.lit(0).alias("mask"), F.lit(0).cast("long").alias("n")).limit(0)), keys
