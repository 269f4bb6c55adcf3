"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F



def half_up(x: Column, digits: int = 2) -> Column:
    """Rounded with halves going up, negative ones too."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k out of n, to two digits; (0, 1) where n is 0."""
    p = k / n
    base = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    low = F.when(n > 0, half_up(F.greatest(F.lit(0.0), mid - half))).otherwise(0.0)
    return low, F.when(n > 0, half_up(F.least(F.lit(1.0), mid + half))).otherwise(1.0)


def association(count: Column, ca: Column, cb: Column, total: Column) -> dict[str, Column]:
    """Support, both confidences and lift of a pair, to two digits, and its strength."""
    support = count / total
    return {
        "strength": half_up(count / F.least(ca, cb)),
        "support": half_up(support),
        "conf_ab": half_up(count / ca),
        "conf_ba": half_up(count / cb),
        "lift": half_up(support / ((ca / total) * (cb / total))),
    }


def percentile_rank(value: str, *partition: str) -> Column:
    """100 * (how many are less, and half of those equal) / all, rounded half up."""
    alike = Window.partitionBy(*partition, value)
    ordered = Window.partitionBy(*partition).orderBy(value)
    whole = Window.partitionBy(*partition)
    less, equal, n = F.rank().over(ordered) - 1, F.count("*").over(alike), F.count("*").over(whole)
    return F.floor(100 * (less + equal / 2) / n + 0.5).cast("long")


def grade(n: Column, high: int = 12, middle: int = 5) -> Column:
    """How far a statement from n observations can be trusted."""
    return F.when(n >= high, "alta").when(n >= middle, "media").otherwise("baja")


def level(score: Column, high: int = 55, middle: int = 30) -> Column:
    return F.when(score >= high, "alto").when(score >= middle, "medio").otherwise("bajo")
