"""Queries of repositories kept, measured at dates and compared, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clones, history
from ..plans import maintain
from ..session import shared_folder
from .common import Registry, read

register = Registry()


def _part_files(parts: DataFrame, price: Column) -> DataFrame:
    """(id, ext, lang, content): each part as a script that imports the next dearer one of its brand and size."""
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    ranked = Window.partitionBy("p_brand", "p_size").orderBy("price", "p_partkey")
    chained = parts.withColumn("price", price).withColumn("next", name(F.lead("p_partkey").over(ranked)))
    own = name(F.col("p_partkey"))
    needs = F.when(F.col("next").isNotNull(), F.format_string("import { %s } from './%s.js';\n%s(1);\n", "next", "next", "next")).otherwise("")
    text = F.concat(needs, F.format_string("export const %s = (x) => x;\n", own))
    return chained.select(F.format_string("%s/%s.js", F.translate("p_brand", "#", "_"), own).alias("id"), F.lit(".js").alias("ext"), F.lit("javascript").alias("lang"), text.alias("content"))


@register("""WITH p AS (SELECT 'p' || p_partkey AS part, p_partkey AS k, translate(p_brand, '#', '_') AS b, p_size AS z, CASE WHEN p_size % 10 = 0 THEN p_retailprice * (1 + p_partkey % 3) ELSE p_retailprice END AS price FROM part WHERE p_partkey % 97 <> 0),
c AS (SELECT b, part, lead(part) OVER (PARTITION BY b, z ORDER BY price, k) AS next FROM p)
SELECT b || '/' || part || '.js' AS source, b || '/' || next || '.js' AS target, next AS name, CAST(1 AS BIGINT) AS count FROM c WHERE next IS NOT NULL""")
def maintained_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a kept repository of parts after some prices rose and some parts went: only files whose text changed are parsed."""
    parts = read(spark, d, "part")
    kept = maintain.Repository(spark, f"{shared_folder(spark)}/repository-{uuid.uuid4().hex}")
    kept.create(_part_files(parts, F.col("p_retailprice")))
    left = parts.filter("p_partkey % 97 <> 0")
    gone = _part_files(parts.filter("p_partkey % 97 = 0"), F.col("p_retailprice")).select("id")
    risen = F.when(F.col("p_size") % 10 == 0, F.col("p_retailprice") * (1 + F.col("p_partkey") % 3)).otherwise(F.col("p_retailprice"))
    kept.update(_part_files(left, risen), gone)
    return kept.table("links").select("source", "target", "name", "count")


@register("""WITH g AS (SELECT o_custkey AS item, o_orderdate AS ts, CAST(floor(sum(o_totalprice)) AS BIGINT) AS price FROM orders GROUP BY ALL),
n AS (SELECT item, ts, CAST(sum(price) OVER (PARTITION BY item ORDER BY ts) AS BIGINT) AS size FROM g), f AS (SELECT item, arg_max(size, ts) AS final FROM n GROUP BY item),
a AS (SELECT DISTINCT o_custkey AS item, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT user_id, ts FROM events)
SELECT a.item, a.ts, CASE WHEN f.item IS NULL THEN coalesce(c_custkey % 500, 0)::DOUBLE WHEN n.size IS NULL THEN 0 ELSE coalesce(c_custkey % 500, 0) * least(1, n.size / CASE final WHEN 0 THEN 1 ELSE final END) END AS shown
FROM a ASOF LEFT JOIN n ON n.item = a.item AND a.ts >= n.ts LEFT JOIN f ON f.item = a.item LEFT JOIN customer ON c_custkey = a.item""")
def sizes_at_dates(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files that grow with their orders: their lines as they were at every shipping date and event of theirs."""
    orders = read(spark, d, "orders")
    days = orders.groupBy(F.col("o_custkey").alias("item"), F.col("o_orderdate").alias("ts")).agg(F.floor(F.sum("o_totalprice")).alias("price"))
    net = days.withColumn("size", F.sum("price").over(Window.partitionBy("item").orderBy("ts"))).select("item", "ts", "size")
    shipped = read(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("item")), "l_orderkey").select("item", F.col("l_shipdate").alias("ts"))
    asks = shipped.union(read(spark, d, "events").select("user_id", "ts")).distinct()
    loc = read(spark, d, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_custkey") % 500).alias("loc"))
    return history.sizes_at(net, asks, loc, "item", "ts", "size")


UNITS = """u AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS unit, l_partkey AS file, l_returnflag || l_linestatus AS grp, CAST(datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) // 7 AS INTEGER) AS start, l_quantity FROM lineitem),
m AS (SELECT grp || '-' || file // 10 AS grp, file, unit, start, start + CAST(l_quantity AS INTEGER) AS "end" FROM u)"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    """(group, unit, file, start, end): lines as ranges of weeks of their part, which overlap; groups by flags and tens of parts."""
    lines = read(spark, d, "lineitem")
    start = F.floor(F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")) / 7).cast("int")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    group = F.concat_ws("-", F.concat("l_returnflag", "l_linestatus"), F.floor(F.col("l_partkey") / 10).cast("string"))
    ident = F.xxhash64(*order)
    return lines.select(group.alias("group"), ident.alias("unit"), F.col("l_partkey").alias("file"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))


@register(f"""WITH {UNITS}, s AS (SELECT grp, count(*) AS n FROM m GROUP BY grp),
k AS (SELECT m.* FROM m JOIN s USING (grp) WHERE n > 60 OR NOT EXISTS (SELECT 1 FROM m x WHERE x.grp = m.grp AND x.file = m.file AND x.start <= m.start AND x."end" >= m."end" AND x."end" - x.start > m."end" - m.start)),
l AS (SELECT grp FROM k GROUP BY grp HAVING count(*) > 1), o AS (SELECT k.* FROM k JOIN l USING (grp)), d AS (SELECT DISTINCT file, unnest(range(start, "end" + 1)) AS line FROM o),
g AS (SELECT file, count(DISTINCT grp) AS n_groups, CAST(max(length(grp) * 5) AS INTEGER) AS cost, bool_or(grp LIKE 'R%') AS dear FROM o GROUP BY file), e AS (SELECT file, count(*) AS lines FROM d GROUP BY file)
SELECT file, lines, floor(least(1, lines / greatest(1, CASE coalesce(p_size, 0) WHEN 0 THEN lines ELSE p_size * 20 END)) * 100 + 0.5) / 100 AS pct, n_groups AS groups, CASE WHEN dear THEN 'costosa' ELSE 'latente' END AS sev, cost FROM e JOIN g USING (file) LEFT JOIN part ON p_partkey = file""")
def duplicated_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Covered lines of each part, from ranges of groups without those that lie in a longer one of their group and part."""
    members = clones.outermost(_units(spark, d))
    groups = members.select("group").distinct().select("group", F.when(F.col("group").startswith("R"), "costosa").otherwise("latente").alias("sev"), (F.length("group") * 5).alias("score"))
    files = read(spark, d, "part").select(F.col("p_partkey").alias("file"), (F.col("p_size") * 20).alias("loc"))
    return clones.duplicated(members, groups, files)


@register("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS file, l_quantity AS q, CAST(datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS start FROM lineitem),
o AS (SELECT l_orderkey AS unit, min(part) AS part, min(file) AS file, min(start) AS start, max(start) AS "end" FROM r GROUP BY 1)
SELECT x.unit AS a, y.unit AS b FROM o x JOIN o y ON x.part = y.part AND x.unit < y.unit WHERE NOT (x.file = y.file AND x.start <= y."end" AND y.start <= x."end")""")
def pairs_apart(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the same first part as copies, without those that overlap in time at the same first supplier."""
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    units = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("file"), F.min(day).alias("start"), F.max(day).alias("end"))
    a, b = (units.select("part", F.col("unit").alias(x)) for x in "ab")
    return clones.apart(a.join(b, "part").filter("a < b").select("a", "b"), units)
