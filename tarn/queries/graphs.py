"""Queries of graph operators, over the brand graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..session import cut
from .common import G, P, Registry, brand_graph, part_graph, read

register = Registry()


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


DEGREES = f"""{G}, v AS (SELECT src AS id FROM g UNION SELECT dst FROM g),
i AS (SELECT dst AS id, count(*) AS fan_in FROM g GROUP BY dst), o AS (SELECT src AS id, count(*) AS fan_out FROM g GROUP BY src),
k AS (SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM v LEFT JOIN i USING (id) LEFT JOIN o USING (id))"""


@register(f"WITH {DEGREES} SELECT *, CASE WHEN fan_in + fan_out > 0 THEN floor(fan_out / (fan_in + fan_out) * 100 + 0.5) / 100 ELSE 0 END AS instability FROM k")
def degree(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d)
    return graph.degrees(_nodes(edges), edges)


@register(f"""WITH {DEGREES} SELECT id, CASE WHEN fan_in = 0 AND fan_out = 0 THEN 'orphan' WHEN fan_in = 0 THEN 'entry' WHEN fan_in >= 3 THEN 'hub' WHEN fan_out = 0 THEN 'leaf' ELSE 'module' END AS role FROM k""")
def role(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d)
    found = graph.role(F.lit(False), F.col("fan_in"), F.col("fan_out"), F.col("fan_out"), F.lit(0), F.lit(0))
    return graph.degrees(_nodes(edges), edges).select("id", found.alias("role"))


@register(f"""WITH RECURSIVE {G}, c(a, b) AS (SELECT src, dst FROM g UNION SELECT c.a, g.dst FROM c JOIN g ON c.b = g.src)
SELECT x.a AS node, min(x.b) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1""")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(brand_graph(spark, d).select("src", "dst"))


@register(f"""WITH RECURSIVE {G}, v AS (SELECT src AS id FROM g UNION SELECT dst FROM g),
r(seed, node, depth) AS (SELECT id, id, 0 FROM v UNION SELECT r.seed, g.src, r.depth + 1 FROM r JOIN g ON g.dst = r.node WHERE r.depth < 26),
m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL)
SELECT seed AS node, count(*) AS total, count(*) FILTER (depth = 1) AS direct, max(depth) AS depth, false AS capped FROM m WHERE node <> seed GROUP BY seed""")
def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(brand_graph(spark, d)).select("src", "dst")
    return graph.impact(edges, _nodes(edges)).drop("ids", "levels")


@register(f"""WITH RECURSIVE {G}, c(a, b) AS (SELECT src, dst FROM g UNION SELECT c.a, g.dst FROM c JOIN g ON c.b = g.src)
SELECT 'deps:' || a AS set_key, b AS id FROM c WHERE a <> b UNION ALL SELECT 'reach:' || b, a FROM c WHERE a <> b""")
def reach_sets(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d).select("src", "dst")
    seeds = _nodes(edges).select(F.col("id").alias("seed"), F.col("id").alias("node"))
    named = lambda found, kind: found.filter("depth > 0 and node <> seed").select(F.concat(F.lit(f"{kind}:"), "seed").alias("set_key"), F.col("node").alias("id"))
    return named(graph.reach(edges, seeds), "deps").union(named(graph.reach(graph.backwards(edges), seeds), "reach"))


@register(f"""WITH RECURSIVE {G}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), e AS (SELECT min(src) AS a, max(src) AS z FROM g),
r(node, depth) AS (SELECT a, 0 FROM e UNION SELECT u.dst, r.depth + 1 FROM r JOIN u ON u.src = r.node WHERE r.depth < 26),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node),
s AS (SELECT u.dst AS node, min(u.src) AS before FROM u JOIN m x ON x.node = u.src JOIN m y ON y.node = u.dst WHERE x.depth = y.depth - 1 GROUP BY u.dst),
p(step, node) AS (SELECT depth, node FROM m JOIN e ON node = z UNION ALL SELECT p.step - 1, s.before FROM p JOIN s ON s.node = p.node WHERE p.step > 0)
SELECT CAST(step AS INTEGER) AS step, node FROM p""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d).select("src", "dst")
    ends = edges.agg(F.min("src").alias("a"), F.max("src").alias("z")).first()
    return graph.shortest_path(edges, ends["a"], ends["z"])


@register(f"""WITH {G}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), s AS (SELECT min(src) AS seed FROM g),
o AS (SELECT dst AS node FROM u JOIN s ON src = seed), t AS (SELECT DISTINCT u.dst AS node FROM u JOIN o ON u.src = o.node)
SELECT seed, seed AS node, 0 AS depth FROM s UNION ALL SELECT seed, node, 1 FROM s, o UNION ALL SELECT seed, node, 2 FROM s, t WHERE node <> seed AND node NOT IN (SELECT node FROM o)""")
def khop(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d).select("src", "dst")
    seed = edges.agg(F.min("src").alias("seed")).select("seed", F.col("seed").alias("node"))
    return graph.neighbourhood(edges, seed)


@register(f"""WITH RECURSIVE {G}, v AS (SELECT src AS id FROM g UNION SELECT dst FROM g), t AS (SELECT id FROM v ORDER BY id LIMIT 3),
r(node) AS (SELECT id FROM t UNION SELECT g.dst FROM r JOIN g ON g.src = r.node)
SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'prueba' WHEN id IN (SELECT g.dst FROM g JOIN t ON g.src = t.id) THEN 'directa' WHEN id IN (SELECT node FROM r) THEN 'indirecta' ELSE 'ninguna' END AS coverage FROM v""")
def coverage_bfs(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d).select("src", "dst")
    nodes = _nodes(edges)
    tests = nodes.orderBy("id").limit(3)
    reached = graph.reach(edges, tests.select(F.lit("t").alias("seed"), F.col("id").alias("node"))).select(F.col("node").alias("id"), "depth")
    named = F.when(F.col("depth") == 0, "prueba").when(F.col("depth") == 1, "directa").when(F.col("depth") > 1, "indirecta").otherwise("ninguna")
    return nodes.join(reached, "id", "left").select("id", named.alias("coverage"))


def supply_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): parts and the suppliers that sold them more than once; parts without any are nodes too."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sold = read(spark, d, "lineitem").groupBy(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst")).agg(F.count("*").alias("n")).filter("n > 1")
    edges = sold.select("src", "dst", F.log2(F.col("n") + 1).alias("weight"))
    nodes = read(spark, d, "part").select(name("p", "p_partkey").alias("id")).union(read(spark, d, "supplier").select(name("s", "s_suppkey")))
    return edges, nodes


@register()
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Label propagation goes on from its own labels, which SQL has no word for; tests hold it against a sequential run on the same graph."""
    edges, nodes = supply_graph(spark, d)
    return graph.cohesion(edges, graph.communities(edges, nodes))


@register(f"""WITH {DEGREES.replace(G, P)} SELECT *, CASE WHEN fan_in + fan_out > 0 THEN floor(fan_out / (fan_in + fan_out) * 100 + 0.5) / 100 ELSE 0 END AS instability,
CASE WHEN fan_in = 0 AND fan_out = 0 THEN 'orphan' WHEN fan_in = 0 THEN 'entry' WHEN fan_in >= 3 THEN 'hub' WHEN fan_out = 0 THEN 'leaf' ELSE 'module' END AS role FROM k""")
def part_roles(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(part_graph(spark, d))
    return graph.degrees(_nodes(edges), edges).withColumn("role", graph.role(F.lit(False), F.col("fan_in"), F.col("fan_out"), F.col("fan_out"), F.lit(0), F.lit(0)))


@register(f"""WITH RECURSIVE {P}, c(a, b) AS (SELECT src, dst FROM g UNION SELECT c.a, g.dst FROM c JOIN g ON c.b = g.src)
SELECT x.a AS node, min(x.b) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1""")
def part_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(cut(part_graph(spark, d)).select("src", "dst"))


@register(f"""WITH RECURSIVE {P}, e AS (SELECT src, dst FROM g WHERE n > 1), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
r(seed, node, depth) AS (SELECT id, id, 0 FROM v UNION SELECT r.seed, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 60),
m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL)
SELECT seed AS node, count(*) AS total, count(*) FILTER (depth = 1) AS direct, max(depth) AS depth, false AS capped FROM m WHERE node <> seed GROUP BY seed""")
def part_impact(spark: SparkSession, d: str) -> DataFrame:
    """What depends on each part, directly or not, by the edges of more than one order."""
    edges = cut(part_graph(spark, d).filter("n > 1")).select("src", "dst")
    return graph.impact(edges, _nodes(edges)).drop("ids", "levels")


@register(f"""WITH {G} SELECT src AS source, dst AS target, 'import' AS kind, CAST(any_value(n) AS BIGINT) AS refs, [1] AS lines, [src || dst] AS specs, [dst] AS symbols FROM g GROUP BY ALL""")
def edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d)
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("import").alias("kind"), F.col("n").alias("count"), F.lit(1).alias("line"), F.concat("src", "dst").alias("spec"), F.col("dst").alias("name"), F.col("dst").alias("local"), F.lit(False).alias("side"))
    again = links.withColumn("count", F.lit(0).cast("long"))
    own = links.withColumn("target", F.col("source"))
    return graph.merge_edges(links.union(again).union(own))


@register(f"""WITH {G}, b AS (SELECT src, max(n) AS most FROM g GROUP BY src) SELECT g.src AS node, min(g.dst) AS neighbour, any_value(most) AS n FROM g JOIN b ON b.src = g.src AND g.n = most GROUP BY g.src""")
def strongest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d)
    best = F.struct(-F.col("n"), F.col("dst"))
    return edges.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", best).alias("neighbour"), F.max("n").alias("n"))


@register("""WITH RECURSIVE n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_name AS file, 'n' || n_nationkey AS name, r_name || s_suppkey AS "user", count(*) AS count FROM supplier JOIN n ON s_nationkey = n_nationkey GROUP BY ALL""")
def symbol_trace(spark: SparkSession, d: str) -> DataFrame:
    """A nation's symbol is exported again by its region, where its suppliers use it."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    symbol = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    symbols = nation.select(F.col("n_name").alias("file"), symbol.alias("name"))
    barrels = nation.select(F.concat("r_name", F.lit("!")).alias("source"), F.col("n_name").alias("target"), F.lit("*").alias("name"))
    used = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    uses = used.select(F.concat("r_name", F.col("s_suppkey").cast("string")).alias("source"), F.concat("r_name", F.lit("!")).alias("target"), symbol.alias("name"), F.lit(1).cast("long").alias("count"))
    return graph.trace(barrels, uses, symbols).drop("via")
