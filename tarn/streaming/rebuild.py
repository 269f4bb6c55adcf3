"""A stream of arriving files that keeps a table rebuilt."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def follow(spark: SparkSession, stream: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Adds what has arrived to ``target``/rows and rebuilds ``target``/world from all rows, until the
    stream has no more.  A batch is written under its number and a batch that is tried again replaces
    itself, so the same input gives the same table; the number is the world's revision."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        everything = spark.read.parquet(f"{target}/rows").filter(F.col("batch") <= number)
        build(everything.drop("batch")).withColumn("revision", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/world/{number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, n, last, revision) from the files at ``path``, read as a stream."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    parent, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(parent)
    build = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    follow(spark, stream, build, base, f"{base}/checkpoint")
    worlds = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/world")
    newest = worlds.agg(F.max("revision").alias("revision"))
    return worlds.join(F.broadcast(newest), "revision").select("user_id", "n", "last", "revision")
