"""What changes together: pairs of items that occur in the same transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import association
from ..session import bucket, shares


def _dealt(touches: DataFrame, tx: str, item: str, groups: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(bucket, tx, item), each once, dealt by buckets of transactions, and the number of parts; with ``groups`` (item, group) an item's group too.

    What is grouped by bucket and transaction from here on stays in its task, whose share doesn't grow with the table.
    """
    parts = shares(touches.count(), touches.sparkSession)
    rows = touches.select(F.col(tx).alias("tx"), F.col(item).alias("item")).dropna()
    if groups is not None:
        rows = rows.join(groups.select("item", "group").dropna().repartition(parts, "item").distinct(), "item")
    return rows.withColumn("bucket", bucket(F.col("tx"), parts)).repartition(parts, "bucket").distinct(), parts


def _pairs(rows: DataFrame, parts: int, least: int, most: int) -> DataFrame:
    own = ["group"] if "group" in rows.columns else []
    listed = rows.groupBy("bucket", "tx", *own).agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items").between(least, most))
    # a join by transaction would be dealt anew; each item meets those behind it in its own row
    first = listed.select("bucket", *own, "items", F.posexplode("items").alias("at", "a"))
    met = first.select("bucket", *own, "a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))
    # counted in each bucket first, so that a frequent pair comes to its task once a bucket
    counted = met.groupBy("bucket", *own, "a", "b").agg(F.count("*").alias("n"))
    return counted.select(*own, "a", "b", "n").repartition(parts, "a", "b").groupBy(*own, "a", "b").agg(F.sum("n").alias("count"))


def _each(rows: DataFrame, parts: int) -> DataFrame:
    """(item, n), dealt by items into as many parts; what is joined with it by item is dealt likewise."""
    counted = rows.groupBy("bucket", "item").agg(F.count("*").alias("n"))
    return counted.select("item", "n").repartition(parts, "item").groupBy("item").agg(F.sum("n").alias("n"))


def pair_counts(touches: DataFrame, tx: str, item: str, *, least: int = 2, most: int = 25, groups: DataFrame | None = None) -> DataFrame:
    """(a, b, count) for a < b: transactions of ``least`` to ``most`` distinct items that have both.

    The bound on a transaction's items bounds the pairs it makes; larger ones are no sign of coupling.
    With ``groups`` (item, group) only items of one group meet, the bounds are on a group's items in a transaction, and
    rows are (group, a, b, count).
    """
    return _pairs(*_dealt(touches, tx, item, groups), least, most)


def item_counts(touches: DataFrame, tx: str, item: str) -> DataFrame:
    """(item, n): in how many transactions each item is."""
    return _each(*_dealt(touches, tx, item))


def associated(touches: DataFrame, tx: str, item: str, *, count: int = 2, strength: float = 0.5, least: int = 2, most: int = 25, transactions: DataFrame | None = None) -> DataFrame:
    """Pairs with at least ``count`` common transactions and ``strength``, and their association:
    a, b, count, strength, support, conf_ab, conf_ba, lift.  Support and lift are of all ``transactions``
    (tx), those that touch nothing among them; of those in ``touches`` where they aren't given."""
    rows, parts = _dealt(touches, tx, item)
    each = _each(rows, parts)
    total = rows.select("bucket", "tx").distinct().agg(F.count("*").alias("total")) if transactions is None else transactions.agg(F.count_distinct(tx).alias("total"))
    pairs = _pairs(rows, parts, least, most).filter(F.col("count") >= count)
    # as it is shown, rounded, the strength is compared
    both = pairs.join(each.select(F.col("item").alias("a"), F.col("n").alias("ca")), "a").join(each.select(F.col("item").alias("b"), F.col("n").alias("cb")), "b")
    named = association(F.col("count"), F.col("ca"), F.col("cb"), F.col("total"))
    found = both.crossJoin(F.broadcast(total)).select("a", "b", "count", *[c.alias(n) for n, c in named.items()])
    return found.filter(F.col("strength") >= strength)


def hidden(pairs: DataFrame, links: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``hidden``: true where ``links`` (a, b), either way round, don't have the pair and
    neither side is in ``skipped`` (id): tests, generated and auxiliary files."""
    known = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("known", F.lit(True))
    found = pairs.join(known, ["a", "b"], "left").withColumn("hidden", F.col("known").isNull()).drop("known")
    for side in "ab" if skipped is not None else "":
        aside = skipped.select(F.col("id").alias(side)).distinct().withColumn("aside", F.lit(True))
        found = found.join(aside, side, "left").withColumn("hidden", F.col("hidden") & F.col("aside").isNull()).drop("aside")
    return found


def strongest(pairs: DataFrame, n: int = 60) -> DataFrame:
    """The ``n`` pairs of most count times strength."""
    return pairs.orderBy((F.col("count") * F.col("strength")).desc(), "a", "b").limit(n)
