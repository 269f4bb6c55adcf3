"""Session settings, and cutting the lineage of iterative plans."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tarn", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` has more settings, dots written as two underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which a cluster's machines share.  Where it is unset and all
    tasks run on this machine, as in tests, a temporary one is taken; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-tarn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there from then on.

    A written table and not checkpoint(), because a checkpoint keeps its plan's partitioning: through
    rounds of joins that description doubles each time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task is given where its memory goes by them.
ROWS = 150_000


def shares(rows: int, spark: SparkSession) -> int:
    """Into how many parts ``rows`` rows are dealt, so that a task's share stays the same however large the table is."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS))


def bucket(key: Column, parts: int) -> Column:
    """Which of some small buckets, 16 to a part, ``key`` is in; a part has several, so that parts are about equal."""
    return F.pmod(F.xxhash64(key), F.lit(16 * parts))


def dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """``rows`` with the ``bucket`` of their ``key``, a task for each of ``parts`` buckets.

    What is grouped by bucket from here on stays in its task.  Hashing the buckets once more would
    give some tasks several of them, and the fullest ever more as parts are added.
    """
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartitionById(parts, "bucket")
