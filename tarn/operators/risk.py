"""Risk of a file and health of the whole, explained by their parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import level

#: The weight of each part of risk.
WEIGHTS = {"fan_in": 0.28, "churn": 0.26, "cycle": 0.16, "untested": 0.14, "owner": 0.10, "size": 0.06, "dup": 0.08}
#: What a finding takes off health, and the most that its kind can.
PENALTIES = {"cycle": (12, 30), "hidden": (4, 12), "untested": (2, 8), "high_risk": (3, 12), "owner": (3, 9), "orphan": (2, 6), "dup": (5, 15), "constant": (2, 6)}


def risk(files: DataFrame, *, has_git: bool = True, has_dupes: bool = True) -> DataFrame:
    """``files`` with parts (0 to 1 each), score (0 to 100) and level.

    Reads id, fan_in, c90, in_cycle, coverage, sole_owner, loc, dup_pct, dup_sev, skipped and is_test; skipped
    files (tests, generated and auxiliary ones) score 0.  fan_in and c90 are shares of the greatest of all files but tests.
    """
    weights = {k: w for k, w in WEIGHTS.items() if (has_git or k not in ("churn", "owner")) and (has_dupes or k != "dup")}
    most = files.filter(~F.col("is_test")).agg(F.greatest(F.lit(4), F.max("fan_in")).alias("__in"), F.greatest(F.lit(4), F.max("c90")).alias("__c90"))
    joined = files.crossJoin(F.broadcast(most))
    share = F.col("fan_in") / F.col("__in")
    parts = {
        "fan_in": share,
        "churn": F.col("c90") / F.col("__c90"),
        "cycle": F.when(F.col("in_cycle"), 1.0).otherwise(0.0),
        "untested": F.when((F.col("coverage") == "ninguna") & (F.col("fan_in") >= 1), 0.5 + 0.5 * share).when(F.col("coverage") == "indirecta", 0.25 * share).otherwise(0.0),
        "owner": F.when(F.col("sole_owner"), 1.0).otherwise(0.0),
        "size": F.col("loc") / 300,
        "dup": F.col("dup_pct") * F.when(F.col("dup_sev") == "costosa", 1.6).otherwise(0.6),
    }
    clamped = {k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(parts[k], F.lit(0.0)))) for k in weights}
    total = sum(weights.values())
    score = sum((clamped[k] * (w / total) for k, w in weights.items()), F.lit(0.0)) * 100
    scored = joined.withColumn("parts", F.struct(*[c.alias(k) for k, c in clamped.items()])).withColumn("score", F.when(F.col("skipped"), 0).otherwise(F.floor(F.round(score, 6) + 0.5)).cast("int"))
    return scored.withColumn("level", level(F.col("score"))).drop("__in", "__c90")


def health_counts(files: DataFrame, *, cycles: DataFrame | None = None, pairs: DataFrame | None = None, groups: DataFrame | None = None, literals: DataFrame | None = None, hot: int = 3) -> DataFrame:
    """(kind, count) for ``health``: from scored files (skipped ones aside), cycles (component), pairs (hidden), groups (sev) and literals (sev)."""
    used, hotspot = F.col("fan_in") >= 2, (F.col("c90") >= hot) & (F.col("fan_in") >= 2)
    kinds = {
        "untested": used & (F.col("coverage") == "ninguna"),
        "high_risk": F.col("level") == "alto",
        "owner": hotspot & F.col("sole_owner"),
        "orphan": F.col("role") == "orphan",
    }
    counts = files.filter(~F.col("skipped")).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    told = [counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*map(F.col, kinds)))).alias("kind", "count"))]
    one = lambda df, kind, n: told.append(df.agg(n.alias("count")).select(F.lit(kind).alias("kind"), "count"))
    if cycles is not None:
        one(cycles, "cycle", F.count_distinct("component"))
    if pairs is not None:
        one(pairs, "hidden", F.count_if("hidden"))
    if groups is not None:
        one(groups, "dup", F.count_if(F.col("sev") == "costosa"))
    if literals is not None:
        one(literals, "constant", F.count_if(F.col("sev") == "media"))
    return reduce(DataFrame.unionByName, told)


def health(counts: DataFrame) -> DataFrame:
    """(score, grade) from (kind, count): 100 less each kind's penalty, which is capped."""
    penalty = F.coalesce(*[F.when(F.col("kind") == k, F.least(F.lit(cap), F.col("count") * each)) for k, (each, cap) in PENALTIES.items()], F.lit(0))
    total = counts.agg((100 - F.coalesce(F.sum(penalty), F.lit(0))).alias("score"))
    return total.select(F.greatest(F.lit(0).cast("long"), "score").alias("score")).select("score", grade(F.col("score")).alias("grade"))


def grade(score: Column) -> Column:
    return F.when(score >= 75, "sana").when(score >= 50, "atención").otherwise("frágil")
