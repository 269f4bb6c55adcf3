"""Measures of a change history: owners, activity, trends, running totals and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import half_up, wilson
from ..session import cut

DAY_MS = 86_400_000


def shares(rows: DataFrame, item: str, author: str) -> DataFrame:
    """(item, author, commits, share, place): each author's rounded share of an item's rows, most first."""
    counted = rows.groupBy(item, author).agg(F.count("*").alias("commits"))
    share = half_up(F.col("commits") / F.sum("commits").over(Window.partitionBy(item)))
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.col("commits").desc(), author))
    return counted.select(item, author, "commits", share.alias("share"), place.alias("place"))


def bus_factor(shared: DataFrame, item: str, author: str, share: float = 0.7) -> DataFrame:
    """(item, owner, owner_share, authors, bus_factor): authors, most first, until their shares reach ``share``."""
    upto = F.sum("share").over(Window.partitionBy(item).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    running = shared.withColumn("before", F.coalesce(upto, F.lit(0.0)))
    return running.groupBy(item).agg(
        F.max(F.when(F.col("place") == 1, F.col(author))).alias("owner"),
        F.max(F.when(F.col("place") == 1, F.col("share"))).alias("owner_share"),
        F.count("*").alias("authors"),
        F.count_if(half_up(F.col("before")) < share).alias("bus_factor"),
    )


def days_ago(ts: Column, now: Column) -> Column:
    """Whole and part days of 24 hours from ``ts`` to ``now``."""
    return (F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))) / DAY_MS


def activity(rows: DataFrame, item: str, ts: str, now: Column, windows: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """(item, commits, c30, c90, c365, first, last)."""
    recent = [F.count_if(days_ago(F.col(ts), now) <= d).alias(f"c{d}") for d in windows]
    return rows.groupBy(item).agg(F.count("*").alias("commits"), *recent, F.min(ts).alias("first"), F.max(ts).alias("last"))


def monthly(rows: DataFrame, item: str, ts: str, now: Column, bins: int = 6) -> DataFrame:
    """(item, m0.., slope, trend): rows in each of the last ``bins`` 30 days, oldest first, and their direction."""
    bin_ = F.floor(days_ago(F.col(ts), now) / 30)
    counts = rows.withColumn("bin", bin_).filter(F.col("bin").between(0, bins - 1)).groupBy(item).agg(*[F.count_if(F.col("bin") == bins - 1 - i).alias(f"m{i}") for i in range(bins)])
    mid = (bins - 1) / 2
    spread = sum((i - mid) ** 2 for i in range(bins))
    slope = sum((F.col(f"m{i}") * (i - mid) for i in range(bins)), F.lit(0.0)) / spread
    trend = F.when(slope > 0.25, "subiendo").when(slope < -0.25, "bajando").otherwise("estable")
    return counts.withColumn("slope", half_up(slope)).withColumn("trend", trend)


def fix_rate(rows: DataFrame, item: str, fix: Column) -> DataFrame:
    """(item, n, fixes, rate, low, high): how many rows are fixes, with their Wilson interval."""
    counted = rows.groupBy(item).agg(F.count("*").alias("n"), F.count_if(fix).alias("fixes"))
    low, high = wilson(F.col("fixes"), F.col("n"))
    return counted.select(item, "n", "fixes", half_up(F.col("fixes") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def timeline(rows: DataFrame, order: str, add: Column, size: Column) -> DataFrame:
    """``rows`` with nf and loc, running totals of ``add`` and ``size`` by ``order``; loc is shown as 0 or more.

    Rows of one place of the order are summed first, so a day or a commit is one row of one window; the
    running total goes over those alone.
    """
    points = rows.groupBy(order).agg(F.sum(add).alias("add"), F.sum(size).alias("size"))
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return points.select(order, "add", F.sum("add").over(running).alias("nf"), F.greatest(F.lit(0.0), F.sum("size").over(running)).alias("loc"))


def clamped(rows: DataFrame, item: str, order: str, change: str) -> DataFrame:
    """``rows`` with net: a running sum of ``change`` that never falls below 0.

    max(0, previous + change) at each step is the plain running sum less the least it has ever been
    below 0, which two windows tell.
    """
    upto = Window.partitionBy(item).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.withColumn("__sum", F.sum(change).over(upto))
    return plain.withColumn("net", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(upto))).drop("__sum")


def size_at(net: DataFrame, item: str, order: str, size: str, upto: Column) -> DataFrame:
    """(item, size): the last ``size`` up to ``upto``; items that begin later are left out."""
    return net.filter(F.col(order) <= upto).groupBy(item).agg(F.max_by(size, order).alias(size))


def as_of(values: DataFrame, asks: DataFrame, item: str, order: str, value: str, *, slices: int = 64) -> DataFrame:
    """``asks`` (item, order, ...) with value: what ``values`` (item, order, value) last said of the item up to then; null before.

    Both are put in one line and each ask takes the last value before or at it, all asks at once.  An item that
    has most of the rows isn't one task: its line is cut into ``slices`` by the order, each is looked through by
    itself, and what a slice begins with comes from the last value of the slices before, a row each.
    Of several values at one place the greatest counts.  The order is a number or a time.
    """
    number = lambda c: c.cast("double") if dict(values.dtypes)[order] not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(c.cast("timestamp")).cast("double")
    told = values.filter(F.col(value).isNotNull()).groupBy(item, order).agg(F.max(value).alias("__v"))
    ends = told.select(number(F.col(order)).alias("o")).union(asks.select(number(F.col(order)).alias("o"))).agg(F.min("o").alias("__lo"), F.max("o").alias("__hi"))
    asked = asks.withColumn("__ask", F.struct(*[F.col(c) for c in asks.columns]))
    lines = told.select(item, order, F.col("__v"), F.lit(None).cast(asked.schema["__ask"].dataType).alias("__ask"), F.lit(0).alias("__kind"))
    lines = lines.unionByName(asked.select(item, order, F.lit(None).cast(told.schema["__v"].dataType).alias("__v"), "__ask", F.lit(1).alias("__kind")))
    place = F.least(F.lit(slices - 1), F.floor((number(F.col(order)) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-9)) * slices)).cast("int")
    sliced = cut(lines.crossJoin(F.broadcast(ends)).withColumn("__slice", place).drop("__lo", "__hi"))
    within = Window.partitionBy(item, "__slice").orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    near = sliced.withColumn("__near", F.last("__v", ignorenulls=True).over(within)).filter("__kind = 1")
    lasts = sliced.filter("__kind = 0").groupBy(item, "__slice").agg(F.max_by("__v", order).alias("__last"))
    every = lasts.unionByName(near.select(item, "__slice").distinct().withColumn("__last", F.lit(None).cast(told.schema["__v"].dataType))).groupBy(item, "__slice").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(item).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).select(F.col(item).alias("__item"), F.col("__slice").alias("__s"), "__carried")
    met = near.join(carried, near[item].eqNullSafe(F.col("__item")) & (near["__slice"] == F.col("__s")), "left")
    return met.select("__ask.*", F.coalesce("__near", "__carried").alias(value))


def sizes_at(net: DataFrame, asks: DataFrame, loc: DataFrame, item: str, order: str, size: str) -> DataFrame:
    """``asks`` with shown: an item's lines (item, loc) as they were then, scaled by its running size (item, order, size).

    The share is the size then of the last one, 1 at most; a last size of 0 counts as 1.  Before its first touch an
    item shows 0; one without any touch shows all its lines.
    """
    final = net.groupBy(item).agg(F.max_by(size, order).alias("__final")).withColumn("__known", F.lit(True))
    then = as_of(net, asks, item, order, size).join(final, item, "left").join(loc.select(item, "loc"), item, "left")
    last = F.when(F.col("__final") == 0, 1).otherwise(F.col("__final"))
    share = F.when(F.col(size).isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col(size) / last))
    lines = F.coalesce("loc", F.lit(0))
    return then.withColumn("shown", F.when(F.col("__known"), lines * share).otherwise(lines.cast("double"))).drop("__final", "__known", size, "loc")


def state(status: Column, first_days: Column, last_days: Column, c30: Column, c90: Column, orphan: Column) -> Column:
    """A file's state, the first that holds."""
    return (
        F.when(status.isin("modified", "added"), "modificado")
        .when((status == "untracked") | (first_days < 14), "nuevo")
        .when((c30 >= 3) | (c90 >= 6), "caliente")
        .when(orphan, "huérfano")
        .when(last_days > 180, "dormido")
        .when(last_days > 60, "estable")
        .otherwise("activo")
    )


def replay(touches: DataFrame) -> DataFrame:
    """``touches`` (i, status, path, from_path, ...) with file_key, which renames keep.

    A path's lives begin with an A, C or R, or with its first touch.  A life that begins with an R goes
    on from the life that its old path had then; following those links, halved in each round, leads to
    the first.  file_key is that life's path and commit.
    """
    born = F.col("status").isin("A", "C", "R") | F.lag("i").over(Window.partitionBy("path").orderBy("i", "status")).isNull()
    marked = touches.withColumn("born", F.when(born, F.col("i")))
    lives = marked.withColumn("life", F.max("born").over(Window.partitionBy("path").orderBy("i", "status").rowsBetween(Window.unboundedPreceding, 0)))
    lives = cut(lives.drop("born"))
    starts = lives.select("path", "life").distinct()
    moves = lives.filter("status = 'R'").select("path", "life", "from_path", "i")
    old = starts.select(F.col("path").alias("from_path"), F.col("life").alias("from_life"))
    came = moves.join(old, "from_path").filter("from_life < i").groupBy("path", "life", "from_path").agg(F.max("from_life").alias("from_life"))
    here = F.struct("path", "life")
    links = starts.join(came, ["path", "life"], "left").select(here.alias("here"), F.coalesce(F.when(F.col("from_path").isNotNull(), F.struct(F.col("from_path").alias("path"), F.col("from_life").alias("life"))), here).alias("root"))
    links = cut(links)
    while True:
        next_ = links.select(F.col("here").alias("root"), F.col("root").alias("further"))
        moved = cut(links.join(next_, "root", "left").select("here", "root", F.coalesce("further", "root").alias("now")))
        links = moved.select("here", F.col("now").alias("root"))
        if moved.filter("root <> now").isEmpty():
            break
    key = links.select("here.path", "here.life", F.concat_ws("@", "root.path", F.col("root.life").cast("string")).alias("file_key"))
    return lives.join(key, ["path", "life"]).drop("life")
