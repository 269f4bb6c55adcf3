"""Tables in the folder that driver and executors share, to cut lineage and to read a result twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where none is set a temporary folder takes its place if all
    tasks run on this machine, as in tests; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-tarn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    The files stay until the folder is cleared, as a checkpoint's do: the caller's result reads them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarn-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: Column) -> Column:
    """What tells a row's text from any other of the same id; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs``, columns as they are, without the rows whose id and text's digest are in ``gone`` (id, mark).

    Ids alone don't do: one that repeats may belong to a text that stays.  A null id equals a null one.
    ``gone`` grows with the documents, so it isn't broadcast at any size: both sides are dealt by id and
    digest, which spreads a group of copies.
    """
    marks = gone.select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).hint("shuffle_hash")
    return docs.join(marks, docs[id_col].eqNullSafe(marks["__id"]) & (digest(docs[text_col]) == marks["__mark"]), "left_anti")


#: Rows in one Arrow batch of texts: some MB of usual documents.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's 10,000 rows an Arrow batch for operators that pass whole texts to Python.

    Very long texts are bound by spark.sql.execution.arrow.maxBytesPerBatch, 64 MB a batch.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
