"""Exact deduplication by progressive refinement, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import digest, table, without_rows

#: Characters of the normalised text that the second level hashes.
PREFIX = 64
_SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha, mark): rows of ``docs`` whose normalised text's length and prefix another row has too.

    Level 1 keeps rows whose length is shared, level 2 those whose length and prefix hash are shared;
    only survivors' texts are hashed whole (SHA-256).  The surviving keys are written as tables, so each
    join has a bare shuffle on both sides and a hot key's rows, which the levels count with partial
    sums, are split by Spark's skew join.
    """
    text = normalised(F.col(text_col))
    key = docs.select(F.length(text).alias("len"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("pre"))
    first = table(key.groupBy("len", "pre").agg(F.count("*").alias("n")), "lengths")
    by_len = first.groupBy("len").agg(F.sum("n").alias("all")).filter("all > 1").select("len")
    by_pre = table(first.join(by_len, "len", "left_semi").filter("n > 1").select("len", "pre"), "shared_prefixes")
    # the third level reads a text only if its length and prefix are shared; Spark plans it as a join on what the row itself has
    own = docs.select(F.col(id_col).alias("id"), F.length(text).alias("len"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("pre"), F.col(text_col).alias("text"))
    return table(own.join(by_pre, ["len", "pre"], "left_semi").select("id", F.sha2(normalised(F.col("text")), 256).alias("sha"), digest(F.col("text")).alias("mark")), "hashed")


def _groups(hashed: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) of texts that occur twice or more."""
    grouped = hashed.groupBy(F.col("sha").alias("text_sha256")).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return table(grouped.filter("group_size > 1"), "groups")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_sha256, keep_id and group_size of each normalised text that occurs twice or more in ``docs``.

    keep_id is the smallest id; null where all ids of the group are null.
    """
    return _groups(_hashed(docs, id_col, text_col))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal normalised texts the row with the smallest id stays; a null text counts as empty.  Rows
    that repeat an id and its text are the same document and stay or go together; a null id never is
    the smallest while another is there, and in a group of null ids only, keep_id is null and all
    stay.  Columns but these two aren't read.  An empty table gives no rows.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    joined = rows.join(groups, "text_sha256", "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col(id_col))
    return joined.select(id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, without those that ``report`` drops.

    Rows are dropped by id and text together: an id that repeats may belong to a text that goes and to
    one that stays.  Of rows with null ids those go whose text a row with an id has too.
    """
    hashed = _hashed(docs, id_col, text_col)
    met = hashed.join(_groups(hashed), hashed["sha"] == F.col("text_sha256"))
    gone = met.filter(F.col("keep_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep_id")))
    return without_rows(docs, table(gone.select("id", "mark").distinct(), "dropped"), id_col, text_col)
