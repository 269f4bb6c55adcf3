"""Sharding by a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

ROUNDS = 6


class Feistel:
    """A keyed permutation of 0..n-1.

    The network permutes 2**(2*half) numbers, the least such power that holds n (half 1 at least); a
    number that leaves 0..n-1 is permuted again until it is back inside, which takes under four steps
    on average and always ends, as the network is itself a permutation.
    """

    def __init__(self, n: int, seed: int = 0):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        state, keys = seed & (1 << 64) - 1, []
        for _ in range(ROUNDS):
            state = state + 0x9E3779B97F4A7C15 & (1 << 64) - 1
            keys.append(np.uint64(state))
        self.keys = keys

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = x + key
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (z ^ (z >> np.uint64(31))) & self.mask

    def _network(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._mix(right, key)
        return left << np.uint64(self.half) | right

    def _network_back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._mix(left, key), left
        return left << np.uint64(self.half) | right

    def _walk(self, rows: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(rows).astype(np.uint64))
        while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row number in the shuffled order."""
        return self._walk(rows, self._network)

    def back(self, places: np.ndarray) -> np.ndarray:
        """The row number at each place: what a reader of one shard needs to find its rows."""
        return self._walk(places, self._network_back)


def number_rows(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Adds gapless row numbers from 0 in the order of ``order``; rows equal in it may swap.

    Ranges of the order are sorted side by side; only each range's count, one row for a partition,
    is gathered to turn places within a range into global ones.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part, place = f"__part_{name}", f"__place_{name}"
    held = table(ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = {r[part]: r["n"] for r in held.groupBy(part).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for key in sorted(counts):
        starts.append((key, total))
        total += counts[key]
    start = f"__start_{name}"
    offsets = spark.createDataFrame(starts, f"`{part}` int, `{start}` long")
    return held.join(F.broadcast(offsets), part).withColumn(name, F.col(start) + F.col(place)).drop(part, place, start)


def shard(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Puts every row into shards 0..n_shards-1 under the law ``rows``: counts at most one apart.

    Returns id_col, size (UTF-8 bytes and 8; a null text has none), text_crc32 (of the bytes; a null
    text counts as empty), law, shard, slot (gapless from 0 in each shard) and grown_shard (null: this
    law moves rows when shards are added).  Rows are numbered by (id, size, crc), so a rerun gives the
    same places; rows equal in all three are interchangeable.  A null id sorts first.  Other columns
    aren't read.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = number_rows(slim, [id_col, "size", "text_crc32"], "__row")
    n = rows.count()

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, seed).forward(row.to_numpy()))

    at: Column = F.col("__at")
    return (
        rows.withColumn("__at", place("__row"))
        .select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"), F.floor(at / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
