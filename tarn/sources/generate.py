"""Synthetic projects: modules of 25 files that import each other, as large as asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_MODULE = 25


def project(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(id, ext, lang, content) of ``n`` files with 1 to 5 imports each, 70 % of them of a file just before.

    Everything comes from hashes of the file's number, so a project is the same however it is dealt.
    """
    i = F.col("i")

    def draw(k: int, below) -> F.Column:
        return F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), below)

    count = 1 + draw(0, F.lit(5))
    near = lambda k: F.greatest(F.lit(0).cast("long"), i - 1 - draw(10 + k, F.lit(30)))
    far = lambda k: draw(20 + k, F.greatest(i, F.lit(1)))
    picks = F.array(*[F.when((k < count) & (i > 0), F.when(draw(30 + k, F.lit(10)) < 7, near(k)).otherwise(far(k))) for k in range(5)])
    imported = F.array_distinct(F.filter(picks, lambda t: t.isNotNull() & (t < i)))
    name = lambda t: F.concat(F.lit("m"), F.floor(t / PER_MODULE).cast("string"), F.lit("/f"), t.cast("string"), F.lit(".mjs"))
    statement = lambda t: F.format_string("import { fn%d } from '../%s';\n", t, name(t))
    call = lambda t: F.format_string("  fn%d(x, %d);\n", t, t)
    body = F.concat(
        F.array_join(F.transform("imported", statement), ""),
        F.format_string("export function fn%d(a, b) {\n  const x = a + b * %d;\n", i, i % 7),
        F.array_join(F.transform("imported", call), ""),
        F.format_string("  return x > %d ? x : -x;\n}\n", i % 11),
    )
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("imported", imported)
    return rows.select(name(i).alias("id"), F.lit(".mjs").alias("ext"), F.lit("javascript").alias("lang"), body.alias("content"))
