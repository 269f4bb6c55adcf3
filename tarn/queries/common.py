"""What the registered queries share: reading tables, and registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import dealt, shares

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _followed(lines: DataFrame, parts: int, name: Callable[[str], Column]) -> DataFrame:
    """(src, dst, n): of each thing in ``lines`` (o, place, x) the two that come after it in most orders o; ``name`` tells which of equals is first.

    All of an order is in one bucket, so what is counted by order stays in its task; sums of buckets are what is dealt.
    """
    listed = dealt(lines, "o", parts).groupBy("bucket", "o").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("all"))
    # a join by order would be dealt anew; each line meets those behind it in its own row
    first = listed.select("bucket", "o", "all", F.posexplode("all").alias("at", "p"))
    both = first.select("bucket", "o", "p", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("q"))
    each = both.filter("p.place < q.place and p.x <> q.x").select("bucket", "o", F.col("p.x").alias("src"), F.col("q.x").alias("dst")).distinct()
    met = each.groupBy("bucket", "src", "dst").agg(F.count("*").alias("k"))
    counted = met.select("src", "dst", "k").repartition(parts, "src").groupBy("src", "dst").agg(F.sum("k").alias("n"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("n").desc(), name("dst")))
    return counted.withColumn("place", place).filter("place <= 2").select(name("src").alias("src"), name("dst").alias("dst"), "n")


def brand_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): each brand and the two that it meets most in later lines of an order."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("place"), "l_partkey")
    parts = shares(lines.count(), spark)
    brands = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("x"))
    both = lines.repartition(parts, "l_partkey").join(brands.repartition(parts, "l_partkey"), "l_partkey")
    return _followed(both.select("o", "place", "x"), parts, F.col)


#: The brand graph in SQL, as common table expressions that end with g(src, dst, n).
G = """lp AS (SELECT l_orderkey AS o, l_linenumber AS n, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT x.b AS src, y.b AS dst, count(DISTINCT x.o) AS n FROM lp x JOIN lp y ON x.o = y.o AND x.n < y.n AND x.b <> y.b GROUP BY ALL),
g AS MATERIALIZED (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM w) WHERE r <= 2)"""


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): each part and the two parts that follow it in most orders; as many nodes as there are parts."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("x"))
    return _followed(lines, shares(lines.count(), spark), lambda x: F.concat(F.lit("p"), F.col(x).cast("string")))


#: The part graph in SQL, as common table expressions that end with g(src, dst, n).
P = """lp AS (SELECT l_orderkey AS o, l_linenumber AS n, 'p' || l_partkey AS b FROM lineitem),
w AS (SELECT x.b AS src, y.b AS dst, count(DISTINCT x.o) AS n FROM lp x JOIN lp y ON x.o = y.o AND x.n < y.n AND x.b <> y.b GROUP BY ALL),
g AS MATERIALIZED (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM w) WHERE r <= 2)"""
