"""Queries of co-change, owners, activity and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import grade, half_up, percentile_rank
from ..operators import cochange, history, measures
from .common import Registry, read

register = Registry()

PAIRS = """t AS (SELECT DISTINCT l_orderkey AS tx, l_partkey AS item FROM lineitem),
s AS (SELECT *, count(*) OVER (PARTITION BY tx) AS n FROM t),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS count FROM s x JOIN s y ON x.tx = y.tx AND x.item < y.item WHERE x.n BETWEEN 2 AND 25 GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT item, count(*) AS n FROM t GROUP BY item),
tot AS (SELECT count(DISTINCT tx) AS total FROM t),
c AS (SELECT a, b, count, floor(count / least(x.n, y.n) * 100 + 0.5) / 100 AS strength, floor(count / total * 100 + 0.5) / 100 AS support,
  floor(count / x.n * 100 + 0.5) / 100 AS conf_ab, floor(count / y.n * 100 + 0.5) / 100 AS conf_ba, floor((count / total) / ((x.n / total) * (y.n / total)) * 100 + 0.5) / 100 AS lift
  FROM p JOIN e x ON x.item = a JOIN e y ON y.item = b, tot WHERE floor(count / least(x.n, y.n) * 100 + 0.5) / 100 >= 0.05)"""


def _associated(spark: SparkSession, d: str) -> DataFrame:
    return cochange.associated(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", strength=0.05)


@register(f"WITH {PAIRS} SELECT * FROM c")
def cochange_assoc(spark: SparkSession, d: str) -> DataFrame:
    return _associated(spark, d)


@register(f"""WITH {PAIRS} SELECT c.a, c.b, c.count, c.strength, x.p_brand IS DISTINCT FROM y.p_brand AS hidden FROM c JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b""")
def cochange_hidden(spark: SparkSession, d: str) -> DataFrame:
    pairs = _associated(spark, d)
    brand = read(spark, d, "part").select("p_partkey", "p_brand")
    a, b = (brand.select(F.col("p_partkey").alias(x), F.col("p_brand").alias(f"brand_{x}")) for x in "ab")
    links = pairs.select("a", "b").join(a, "a").join(b, "b").filter("brand_a = brand_b").select("a", "b")
    return cochange.hidden(pairs, links).select("a", "b", "count", "strength", "hidden")


@register(f"WITH {PAIRS} SELECT * FROM c ORDER BY count * strength DESC, a, b LIMIT 60")
def cochange_top(spark: SparkSession, d: str) -> DataFrame:
    return cochange.strongest(_associated(spark, d))


@register("""WITH m AS (SELECT max(l_shipdate) AS now FROM lineitem),
l AS (SELECT p_brand, l_suppkey, l_shipdate >= now - INTERVAL 90 DAY AS recent FROM lineitem JOIN part ON l_partkey = p_partkey, m),
u AS (SELECT p_brand, arg_min(l_suppkey, (-n, l_suppkey)) AS owner, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(r) AS BIGINT) AS c90 FROM (SELECT p_brand, l_suppkey, count(*) AS n, count(*) FILTER (recent) AS r FROM l GROUP BY ALL) GROUP BY p_brand)
SELECT p_brand AS dir, count(*) AS files, any_value(lines) AS lines, floor(avg(p_size) + 0.5) AS risk, count(*) FILTER (p_size >= 40) AS hot, any_value(c90) AS c90, any_value(owner) AS owner FROM part JOIN u USING (p_brand) GROUP BY p_brand""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    part, lines = read(spark, d, "part"), read(spark, d, "lineitem")
    now = lines.agg(F.max("l_shipdate").alias("now"))
    own = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dir")), "l_partkey").crossJoin(F.broadcast(now))
    per = own.groupBy("dir", "l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_shipdate") >= F.col("now") - F.expr("interval 90 days")).alias("r"))
    owners = per.groupBy("dir").agg(F.sum("n").alias("lines"), F.sum("r").alias("c90"), F.min_by("l_suppkey", F.struct(-F.col("n"), F.col("l_suppkey"))).alias("owner"))
    rolled = part.groupBy(F.col("p_brand").alias("dir")).agg(F.count("*").alias("files"), F.floor(F.avg("p_size") + 0.5).cast("double").alias("risk"), F.count_if(F.col("p_size") >= 40).alias("hot"))
    return rolled.join(owners, "dir").select("dir", "files", "lines", "risk", "hot", "c90", "owner")


@register("""WITH t AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT x.b AS source, y.b AS target, count(*) AS count FROM t x JOIN t y ON x.o = y.o AND x.p < y.p AND x.b <> y.b GROUP BY ALL""")
def folder_coupling(spark: SparkSession, d: str) -> DataFrame:
    brand = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("b"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().join(brand, "l_partkey")
    x, y = (lines.select("l_orderkey", F.col("l_partkey").alias(f"p{s}"), F.col("b").alias(s)) for s in ("source", "target"))
    return x.join(y, "l_orderkey").filter("psource < ptarget and source <> target").groupBy("source", "target").agg(F.count("*").alias("count"))


SHARES = """r AS (SELECT c_nationkey AS item, l_suppkey AS author FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
n AS (SELECT item, author, count(*) AS commits FROM r GROUP BY ALL),
s AS (SELECT item, author, commits, floor(commits / sum(commits) OVER (PARTITION BY item) * 100 + 0.5) / 100 AS share, row_number() OVER (PARTITION BY item ORDER BY commits DESC, author) AS place FROM n)"""


def _shares(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(orders, "l_orderkey").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return history.shares(rows.select(F.col("c_nationkey").alias("item"), F.col("l_suppkey").alias("author")), "item", "author")


@register(f"WITH {SHARES} SELECT * FROM s")
def author_share(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)


@register(f"""WITH {SHARES}, b AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY item ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT item, max(author) FILTER (place = 1) AS owner, max(share) FILTER (place = 1) AS owner_share, count(*) AS authors, count(*) FILTER (floor(before * 100 + 0.5) / 100 < 0.7) AS bus_factor FROM b GROUP BY item""")
def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return history.bus_factor(_shares(spark, d), "item", "author")


def _now(df: DataFrame, ts: str) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.max(ts).alias("now"))))


@register("""SELECT user_id AS item, count(*) AS commits, count(*) FILTER (age <= 30) AS c30, count(*) FILTER (age <= 90) AS c90, count(*) FILTER (age <= 365) AS c365, min(ts) AS first, max(ts) AS last
FROM (SELECT user_id, ts, (epoch_ms(max(ts) OVER ()) - epoch_ms(ts)) / 86400000 AS age FROM events) GROUP BY user_id""")
def churn_windows(spark: SparkSession, d: str) -> DataFrame:
    return history.activity(_now(read(spark, d, "events"), "ts"), "user_id", "ts", F.col("now")).withColumnRenamed("user_id", "item")


@register("""WITH b AS (SELECT o_orderpriority AS item, floor((epoch_ms(max(o_orderdate) OVER ()) - epoch_ms(o_orderdate)) / 86400000 / 30) AS bin FROM orders),
m AS (SELECT item, count(*) FILTER (bin = 5) AS m0, count(*) FILTER (bin = 4) AS m1, count(*) FILTER (bin = 3) AS m2, count(*) FILTER (bin = 2) AS m3, count(*) FILTER (bin = 1) AS m4, count(*) FILTER (bin = 0) AS m5 FROM b WHERE bin BETWEEN 0 AND 5 GROUP BY item),
s AS (SELECT *, (m0 * -2.5 + m1 * -1.5 + m2 * -0.5 + m3 * 0.5 + m4 * 1.5 + m5 * 2.5)::DOUBLE / 17.5 AS raw FROM m)
SELECT * EXCLUDE raw, floor(raw * 100 + 0.5) / 100 AS slope, CASE WHEN raw > 0.25 THEN 'subiendo' WHEN raw < -0.25 THEN 'bajando' ELSE 'estable' END AS trend FROM s""")
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return history.monthly(_now(read(spark, d, "orders"), "o_orderdate"), "o_orderpriority", "o_orderdate", F.col("now")).withColumnRenamed("o_orderpriority", "item")


@register("""WITH c AS (SELECT user_id AS item, count(*) AS n, count(*) FILTER (event_type = 'error') AS fixes FROM events GROUP BY user_id),
w AS (SELECT *, fixes / n AS p, 1 + 1.96::DOUBLE * 1.96::DOUBLE / n AS base FROM c),
h AS (SELECT *, (p + 1.96::DOUBLE * 1.96::DOUBLE / (2 * n)) / base AS mid, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4 * n * n)) / base AS half FROM w)
SELECT item, n, fixes, floor(p * 100 + 0.5) / 100 AS rate, floor(greatest(0, mid - half) * 100 + 0.5) / 100 AS low, floor(least(1, mid + half) * 100 + 0.5) / 100 AS high FROM h""")
def fix_rate_wilson(spark: SparkSession, d: str) -> DataFrame:
    return history.fix_rate(read(spark, d, "events"), "user_id", F.col("event_type") == "error").withColumnRenamed("user_id", "item")


@register("""WITH a AS (SELECT o_custkey, max(now) AS now, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) FILTER (age <= 30) AS c30, count(*) FILTER (age <= 90) AS c90 FROM
  (SELECT *, max(o_orderdate) OVER () AS now, (epoch_ms(max(o_orderdate) OVER ()) - epoch_ms(o_orderdate)) / 86400000 AS age FROM orders) GROUP BY o_custkey),
s AS (SELECT c_custkey AS item, (epoch_ms(now) - epoch_ms(first)) / 86400000 AS f, (epoch_ms(now) - epoch_ms(last)) / 86400000 AS l, coalesce(c30, 0) AS c30, coalesce(c90, 0) AS c90, a.o_custkey IS NULL AS orphan FROM customer LEFT JOIN a ON c_custkey = o_custkey)
SELECT item, CASE WHEN f < 14 THEN 'nuevo' WHEN c30 >= 3 OR c90 >= 6 THEN 'caliente' WHEN orphan THEN 'huérfano' WHEN l > 180 THEN 'dormido' WHEN l > 60 THEN 'estable' ELSE 'activo' END AS state FROM s""")
def lifecycle_state(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    seen = history.activity(_now(orders, "o_orderdate"), "o_custkey", "o_orderdate", F.col("now"))
    now = orders.agg(F.max("o_orderdate").alias("now"))
    rows = read(spark, d, "customer").join(seen.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").crossJoin(F.broadcast(now))
    state = history.state(F.lit(None).cast("string"), history.days_ago(F.col("first"), F.col("now")), history.days_ago(F.col("last"), F.col("now")), F.coalesce("c30", F.lit(0)), F.coalesce("c90", F.lit(0)), F.col("commits").isNull())
    return rows.select(F.col("c_custkey").alias("item"), state.alias("state"))


PARTS = "u AS (SELECT p_partkey AS item, p_brand AS grp, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"


def _uses(spark: SparkSession, d: str) -> DataFrame:
    used = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("n"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("grp")).join(used, "item", "left").na.fill(0, ["n"])


@register(f"""WITH {PARTS} SELECT item, n, CAST(floor(100 * (rank() OVER (PARTITION BY grp ORDER BY n) - 1 + count(*) OVER (PARTITION BY grp, n) / 2) / count(*) OVER (PARTITION BY grp) + 0.5) AS BIGINT) AS pct FROM u""")
def pct_rank(spark: SparkSession, d: str) -> DataFrame:
    return _uses(spark, d).select("item", "n", percentile_rank("n", "grp").alias("pct"))


@register(f"""WITH {PARTS}, m AS (SELECT *, median(n) OVER () AS med FROM u), a AS (SELECT *, median(abs(n - med)) OVER () AS mad FROM m),
z AS (SELECT item, n, CASE WHEN mad > 0 THEN 0.6745::DOUBLE * (n - med) / mad WHEN n > med THEN 3.6 ELSE 0 END AS raw FROM a) SELECT item, n, floor(raw * 100 + 0.5) / 100 AS z, raw > 3.5 AS outlier FROM z""")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    return measures.robust_z(_uses(spark, d).select("item", "n"), "n")


@register("""WITH s AS (SELECT c_nationkey AS grp, c_custkey, CAST(round(sum(o_totalprice)) AS BIGINT) AS v FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v) AS i FROM s)
SELECT grp, count(*) AS n, floor((2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*)) * 100 + 0.5) / 100 AS gini FROM i GROUP BY grp""")
def gini(spark: SparkSession, d: str) -> DataFrame:
    spent = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("v"))
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("grp")).join(spent, "c_custkey")
    return measures.gini(rows, "grp", "v")


@register("""WITH p AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS add, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS size FROM orders GROUP BY day)
SELECT day, add, CAST(sum(add) OVER (ORDER BY day) AS BIGINT) AS nf, CAST(sum(size) OVER (ORDER BY day) AS DOUBLE) AS loc FROM p""")
def timeline_running(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.round("o_totalprice").cast("long").alias("size"))
    out = history.timeline(rows, "day", F.lit(1), F.col("size"))
    return out.select("day", "add", "nf", F.col("loc").cast("double").alias("loc"))


CHANGES = """r AS (SELECT o_custkey AS item, o_orderkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice) AS BIGINT) AS change FROM orders),
q AS (SELECT *, sum(change) OVER (PARTITION BY item ORDER BY i) AS s FROM r),
c AS (SELECT item, i, CAST(s - least(0, min(s) OVER (PARTITION BY item ORDER BY i)) AS BIGINT) AS net FROM q)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    change = F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1) * F.round("o_totalprice").cast("long")
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("i"), change.alias("change"))
    return history.clamped(rows, "item", "i", "change").select("item", "i", "net")


@register(f"WITH {CHANGES} SELECT * FROM c")
def net_size(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


@register(f"WITH {CHANGES} SELECT item, arg_max(net, i) AS net FROM c WHERE i <= 5000 GROUP BY item")
def size_at(spark: SparkSession, d: str) -> DataFrame:
    return history.size_at(_changes(spark, d), "item", "i", "net", F.lit(5000))


@register("""WITH r AS (SELECT l_suppkey AS item, CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS s, CAST(l_shipdate AS DATE) - DATE '1992-01-01' + CAST(l_quantity AS INTEGER) AS e FROM lineitem),
o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY item ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY item ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT item, count(*) AS islands, CAST(sum(e - s) AS BIGINT) AS covered FROM (SELECT item, island, min(s) AS s, max(e) AS e FROM g GROUP BY ALL) GROUP BY item""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    start = F.datediff("l_shipdate", F.lit("1992-01-01"))
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), start.alias("s"), (start + F.col("l_quantity").cast("int")).alias("e"))
    return measures.interval_union(rows, "item", "s", "e")


@register("""WITH c AS (SELECT o_orderpriority AS item, o_orderdate AS t, o_orderkey AS k FROM orders)
SELECT item, k, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY t DESC, k DESC) AS place FROM c) WHERE place <= 40""")
def last_forty(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("item"), F.col("o_orderkey").alias("k"), place.alias("place")).filter("place <= 40")


@register("""SELECT user_id AS item, count(*) AS n, CASE WHEN count(*) >= 12 THEN 'alta' WHEN count(*) >= 5 THEN 'media' ELSE 'baja' END AS conf FROM events GROUP BY user_id""")
def confidence_grade(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "events").groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("n"))
    return counts.withColumn("conf", grade(F.col("n")))
