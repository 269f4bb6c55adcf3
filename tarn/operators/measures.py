"""Ranks, outliers, inequality and unions of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import half_up
from ..session import cut


def robust_z(rows: DataFrame, value: str, most: float = 3.5) -> DataFrame:
    """``rows`` with z, 0.6745 times the distance from the median in units of the median distance, and outlier."""
    middle = rows.agg(F.median(value).alias("__median"))
    away = rows.crossJoin(F.broadcast(middle))
    mad = away.agg(F.median(F.abs(F.col(value) - F.col("__median"))).alias("__mad"))
    off = F.col(value) - F.col("__median")
    z = F.when(F.col("__mad") > 0, 0.6745 * off / F.col("__mad")).when(off > 0, 3.6).otherwise(0.0)
    return away.crossJoin(F.broadcast(mad)).withColumn("__z", z).withColumn("z", half_up(F.col("__z"))).withColumn("outlier", F.col("__z") > most).drop("__median", "__mad", "__z")


def outliers(rows: DataFrame, named: dict[str, str], column: str = "outlier", most: float = 3.5) -> DataFrame:
    """``rows`` with ``column``: the names of the values (value to name) whose robust z is over ``most``, all told by two looks at the rows."""
    middle = rows.agg(*[F.median(v).alias(f"__m_{v}") for v in named])
    away = rows.crossJoin(F.broadcast(middle))
    mad = away.agg(*[F.median(F.abs(F.col(v) - F.col(f"__m_{v}"))).alias(f"__d_{v}") for v in named])
    off = {v: F.col(v) - F.col(f"__m_{v}") for v in named}
    z = {v: F.when(F.col(f"__d_{v}") > 0, 0.6745 * off[v] / F.col(f"__d_{v}")).when(off[v] > 0, 3.6).otherwise(0.0) for v in named}
    told = F.array_compact(F.array(*[F.when(z[v] > most, name) for v, name in named.items()]))
    return away.crossJoin(F.broadcast(mad)).withColumn(column, told).drop(*[f"__{x}_{v}" for x in "md" for v in named])


def gini(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, gini): inequality of ``value`` in each group, to two digits; 0 where it sums to 0."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    sums = rows.withColumn("__i", place).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("__sum"), F.sum(F.col("__i") * F.col(value)).alias("__weighted"))
    g = 2 * F.col("__weighted") / (F.col("n") * F.col("__sum")) - (F.col("n") + 1) / F.col("n")
    return sums.select(group, "n", F.when(F.col("__sum") > 0, half_up(g)).otherwise(0.0).alias("gini"))


def interval_union(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, islands, covered): intervals that overlap or touch are one; ``covered`` sums their lengths."""
    before = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col(start) > F.max(end).over(before)).cast("int"), F.lit(1))
    numbered = rows.withColumn("__new", new).withColumn("__island", F.sum("__new").over(Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy(group, "__island").agg(F.min(start).alias("s"), F.max(end).alias("e"))
    return islands.groupBy(group).agg(F.count("*").alias("islands"), F.sum(F.col("e") - F.col("s")).alias("covered"))


def numbered(rows: DataFrame, place: str, *order: Column) -> DataFrame:
    """``rows`` with ``place``, 0 and up by ``order``, with no task for all rows: ranges of the order are numbered each by
    itself, and each begins where those before it end.  Rows of equal order keep together, one before the other as it falls."""
    spread = cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spread.groupBy("__p").agg(F.count("*").alias("n")).select("__p", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return spread.withColumn("__inside", inside).join(F.broadcast(starts), "__p").withColumn(place, F.col("__before") + F.col("__inside")).drop("__p", "__inside", "__before")


def ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 100 * (how many are less, and half of those equal) / all, rounded half up; rows without a value have none.

    Equal values are counted first, so that only distinct ones are put in order.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("__n").over(Window.partitionBy())
    placed = counts.withColumn(name, F.floor(100 * (upto - F.col("__n") / 2) / whole + 0.5).cast("long")).drop("__n")
    return rows.join(placed, value, "left")


def greedy(rows: DataFrame, id_col: str, size: str, *, most: int, budget: int) -> DataFrame:
    """(id_col, size): rows of ``most`` or less in order of id_col, each taken if it still fits into ``budget``.

    Each round takes, by running totals over ranges of rows, all up to the first that doesn't fit, and
    goes on behind it with what is small enough for the rest of the budget.
    """
    left = cut(rows.select(id_col, size).filter(F.col(size) <= most))
    taken = left.limit(0)
    while budget > 0:
        spread = cut(left.repartitionByRange(id_col).withColumn("__p", F.spark_partition_id()))
        before = F.coalesce(F.sum("s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = spread.groupBy("__p").agg(F.sum(size).alias("s")).withColumn("before", before).filter(F.col("before") <= budget).select("__p", "before")
        upto = F.sum(size).over(Window.partitionBy("__p").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0))
        running = cut(spread.join(F.broadcast(starts), "__p").withColumn("upto", F.col("before") + upto).select(id_col, size, "upto"))
        fits = running.filter(F.col("upto") <= budget).select(id_col, size, "upto")
        end = fits.agg(F.max("upto").alias("used"), F.max(id_col).alias("last")).first()
        if end["used"] is None and running.isEmpty():
            break
        taken = cut(taken.union(fits.select(id_col, size)))
        budget -= end["used"] or 0
        stop = running.filter(F.col("upto") > (end["used"] or 0)).agg(F.min(id_col).alias("i")).first()["i"]
        if stop is None:
            break
        left = cut(left.filter((F.col(id_col) > stop) & (F.col(size) <= budget)))
        if left.isEmpty():
            break
    return taken


def longest_prefix(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str, sep: str = "/") -> DataFrame:
    """``rows`` with ``prefix``, the longest of ``prefixes`` that is the path or a folder above it."""
    parts = F.split(path, sep)
    uppers = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    met = rows.select(path, F.explode(uppers).alias(prefix)).distinct().join(prefixes.select(prefix).distinct(), prefix)
    best = met.groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(best, path, "left")


def first_match(candidates: DataFrame, key: list[str], place: str, targets: DataFrame, target: str) -> DataFrame:
    """(key, target): of each key's candidates, in the order of ``place``, the first that is a target."""
    return candidates.join(targets.select(target).distinct(), target).groupBy(*key).agg(F.min_by(target, place).alias(target))
