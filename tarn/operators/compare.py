"""Before and after: differences of two snapshots, and the checks a change has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, *, risk: int = 8) -> DataFrame:
    """(id, change, from, to): rows of (id, risk, state) that came, went, grew riskier or changed state."""
    a = before.select("id", F.col("risk").alias("r0"), F.col("state").alias("s0"), F.lit(True).alias("was"))
    b = after.select("id", F.col("risk").alias("r1"), F.col("state").alias("s1"), F.lit(True).alias("is"))
    both = a.join(b, "id", "full_outer")
    text = lambda c: F.col(c).cast("string")
    change = lambda name, x, y: F.struct(F.lit(name).alias("change"), x.alias("from"), y.alias("to"))
    none = F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            F.when(F.col("was").isNull(), change("añadido", none, text("s1"))),
            F.when(F.col("is").isNull(), change("eliminado", text("s0"), none)),
            F.when(F.col("r1") - F.col("r0") >= risk, change("riesgo", text("r0"), text("r1"))),
            F.when(F.col("s1") != F.col("s0"), change("estado", text("s0"), text("s1"))),
        )
    )
    return both.select("id", F.explode(found).alias("c")).select("id", "c.change", "c.from", "c.to")


def check(before: DataFrame, after: DataFrame, *, risk: int = 8, high: int = 55, fan_in: int = 3, loc: int = 8) -> DataFrame:
    """(id, rule, sev): what a change did to files (id, risk, fan_in, loc, covered, dynamic, skipped, test).

    Skipped files are tests, generated and auxiliary ones; they are passed over, but one that went and was used is told unless it was a test.
    """
    names = ("risk", "fan_in", "loc", "covered", "dynamic", "skipped", "test")
    a = before.select("id", *[F.col(n).alias(f"{n}0") for n in names], F.lit(True).alias("was"))
    b = after.select("id", *[F.col(n).alias(f"{n}1") for n in names], F.lit(True).alias("is"))
    both = a.join(b, "id", "full_outer")
    own = ~F.coalesce("skipped1", F.lit(False))
    stays, new = F.col("was") & F.col("is") & own, F.col("was").isNull() & own
    rule = lambda name, sev: F.struct(F.lit(name).alias("rule"), sev.alias("sev"))
    review, note = F.lit("revisar"), F.lit("nota")
    crossed = (F.col("risk1") >= high) & (F.col("risk0") < high)
    found = F.array_compact(
        F.array(
            F.when(stays & ((F.col("risk1") - F.col("risk0") >= risk) | crossed), rule("riesgo", F.when(F.col("risk1") >= high, review).otherwise(note))),
            F.when(stays & (F.col("fan_in1") - F.col("fan_in0") >= fan_in), rule("dependientes", note)),
            F.when(stays & F.col("dynamic1") & ~F.col("dynamic0"), rule("reflexión", note)),
            F.when(new & ~F.col("covered1") & (F.col("loc1") >= loc), rule("sin pruebas", review)).when(new, rule("nuevo", note)),
            F.when(F.col("is").isNull() & (F.col("fan_in0") > 0) & ~F.col("test0"), rule("eliminado en uso", review)),
        )
    )
    return both.select("id", F.explode(found).alias("f")).select("id", "f.rule", "f.sev")


def verdict(found: DataFrame) -> DataFrame:
    """(verdict, revisar, nota): revisar if any finding asks for it."""
    counts = found.agg(F.count_if(F.col("sev") == "revisar").alias("revisar"), F.count_if(F.col("sev") == "nota").alias("nota"))
    return counts.select(F.when(F.col("revisar") > 0, "revisar").otherwise("ok").alias("verdict"), "revisar", "nota")


def fresh(before: DataFrame, after: DataFrame, signature: str) -> DataFrame:
    """Rows of ``after`` whose signature ``before`` lacks: new cycles, duplicates or bridges."""
    return after.join(before.select(signature).distinct(), signature, "left_anti")
