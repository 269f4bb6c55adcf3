"""Registered queries of the reference's own operators, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import cochange
from .queries import answers, findings, graphs, history, repositories, texts, worlds

_PARTS = (history, graphs, texts, worlds, answers, repositories, findings)
QUERIES = {name: query for part in _PARTS for name, query in part.register.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.register.oracles.items()}


def entry(spark: SparkSession) -> DataFrame:
    """Parts that are ordered together: the strongest pairs of all."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    return cochange.strongest(cochange.associated(lines, "l_orderkey", "l_partkey", strength=0.0))
