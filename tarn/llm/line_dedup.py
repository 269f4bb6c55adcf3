"""Removal of lines that spread over many sites, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Base-2 logarithm of a sketch's registers; its relative standard error is 1.04 / 2**(LG_K / 2).
LG_K = 6
#: Standard errors on either side of the threshold within which a line is counted exactly.
SIGMAS = 4


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def _counts(line: Column) -> Column:
    return F.trim(line) != ""


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line): hashes of the lines of ``lines`` (line, site) that ``min_sites`` distinct sites have, or more.

    A HyperLogLog sketch of each line's sites, merged by the aggregation's partial sums, tells lines
    far below and far above the threshold; those within SIGMAS standard errors are counted exactly.
    """
    error = SIGMAS * 1.04 / 2 ** (LG_K / 2)
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    guessed = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    told = table(guessed.filter(F.col("sites") >= min_sites * (1 - error)), "guessed")
    near = told.filter(F.col("sites") <= min_sites * (1 + error)).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return told.filter(F.col("sites") > min_sites * (1 + error)).select("line").union(exact.select("line"))


def remove_spread_lines(docs: DataFrame, *, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Drops from each text all lines that ``min_sites`` distinct sites have, or more.

    Returns id_col, n_lines, n_removed and kept (the lines left, newline-joined) for each row.  Lines
    are split at ``\\n`` and told apart by xxhash64 of the whole line; those of nothing but spaces are
    kept.  A null text is empty (one empty line); a null site counts for none, but its texts lose
    lines as any other.  Rows that repeat an id, null ids among them, are each judged by what their own
    lines are.  Other columns aren't read.  An empty table gives no rows.
    """
    line = F.explode(F.array_distinct(F.transform(F.filter(_lines(text_col), _counts), lambda x: F.xxhash64(x)))).alias("line")
    own = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), line)
    spread = table(spread_lines(own.select("line", "site"), min_sites), "spread")
    hits = own.select("id", "line").join(spread, "line", "left_semi").groupBy("id").agg(F.collect_set("line").alias("gone"))
    hits = table(hits, "hits").withColumnRenamed("id", "hit")
    rows = docs.select(F.col(id_col).alias("id"), _lines(text_col).alias("lines"))
    joined = rows.join(hits.hint("shuffle_hash"), rows["id"].eqNullSafe(hits["hit"]), "left")
    gone = F.coalesce("gone", F.array().cast("array<long>"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~(_counts(x) & F.array_contains(gone, F.xxhash64(x)))))
    out = joined.select("id", F.size("lines").cast("long").alias("n_lines"), left.alias("left"))
    return out.select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("left")).alias("n_removed"), F.array_join("left", "\n").alias("kept"))
