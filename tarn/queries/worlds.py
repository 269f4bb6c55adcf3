"""Queries of sets, snapshots, risk, health, insights and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, measures, risk, sets
from ..plans.insights import file_findings
from .common import Registry, read

register = Registry()

KEYS = ["seg:BUILDING", "nation:low", "rich", "recent"]
MEMBERS = """m AS (SELECT max(o_orderdate) AS now FROM orders), l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS a, c_nationkey < 8 AS b, c_acctbal > 5000 AS c, coalesce(last >= now - INTERVAL 180 DAY, false) AS d FROM customer LEFT JOIN l ON o_custkey = c_custkey, m),
s AS (SELECT 'seg:BUILDING' AS set_key, id FROM c WHERE a UNION ALL SELECT 'nation:low', id FROM c WHERE b UNION ALL SELECT 'rich', id FROM c WHERE c UNION ALL SELECT 'recent', id FROM c WHERE d),
k AS (SELECT id, CAST(a AS INTEGER) + 2 * CAST(b AS INTEGER) + 4 * CAST(c AS INTEGER) + 8 * CAST(d AS INTEGER) AS mask FROM c WHERE a OR b OR c OR d)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    last = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = read(spark, d, "customer").join(last, "c_custkey", "left").crossJoin(F.broadcast(now))
    recent = F.col("last") >= F.col("now") - F.expr("interval 180 days")
    return sets.membership(rows, "c_custkey", dict(zip(KEYS, (F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") < 8, F.col("c_acctbal") > 5000, recent), strict=True)))


@register(f"WITH {MEMBERS} SELECT * FROM s")
def sets_membership(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d)


@register(f"WITH {MEMBERS} SELECT split_part(set_key, ':', 1) AS family, set_key, count(DISTINCT id) AS n FROM s GROUP BY ALL")
def catalog_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sets.sizes(_members(spark, d)).withColumnRenamed("kind", "family")


@register(f"WITH {MEMBERS} SELECT mask, count(*) AS n FROM k GROUP BY mask")
def regions(spark: SparkSession, d: str) -> DataFrame:
    return sets.regions(_members(spark, d), KEYS)


@register(f"WITH {MEMBERS} SELECT mask, count(*) AS n, mask & 1 <> 0 AS in_0, mask & 2 <> 0 AS in_1, mask & 4 <> 0 AS in_2, mask & 8 <> 0 AS in_3 FROM k GROUP BY mask ORDER BY n DESC, mask LIMIT 14")
def upset(spark: SparkSession, d: str) -> DataFrame:
    return sets.upset(sets.regions(_members(spark, d), KEYS), KEYS)


@register(f"WITH {MEMBERS}, x AS (SELECT id, bit_or(CASE set_key WHEN 'rich' THEN 1 WHEN 'recent' THEN 4 ELSE 2 END) AS mask FROM s WHERE set_key IN ('rich', 'recent', 'nation:low') GROUP BY id) SELECT mask, count(*) AS n FROM x GROUP BY mask")
def recipe_critical(spark: SparkSession, d: str) -> DataFrame:
    renamed = _members(spark, d).replace({"rich": "risk:alto", "recent": "many", "nation:low": "cov:ninguna"}, subset=["set_key"])
    return sets.recipe(renamed, "critical")[0]


LABELS = """k AS (SELECT DISTINCT ['dir', 'mod', 'author', 'lang', 'state', 'risk', 'cov', 'flag', 'role', 'tag', 'saved', 'pkg', 'hot', 'many', 'deps', 'reach', 'otro'][1 + p_partkey % 17] AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'ninguna' ELSE p_brand || '/' || p_name || '.js' END AS arg FROM part),
s AS (SELECT CASE WHEN kind IN ('hot', 'many') THEN kind ELSE kind || ':' || arg END AS set_key, kind, arg FROM k)"""


@register(f"""WITH {LABELS} SELECT DISTINCT set_key, CASE kind WHEN 'hot' THEN 'cambia seguido' WHEN 'many' THEN 'muchos dependientes' WHEN 'cov' THEN CASE arg WHEN 'ninguna' THEN 'sin pruebas' ELSE 'prueba ' || arg END WHEN 'mod' THEN 'módulo ' || arg WHEN 'state' THEN 'estado ' || arg WHEN 'risk' THEN 'riesgo ' || arg
  WHEN 'tag' THEN '@set ' || arg WHEN 'saved' THEN '★ ' || arg WHEN 'deps' THEN 'de qué depende ' || regexp_replace(string_split(arg, '/')[-1], '\\.[^.]+$', '') WHEN 'reach' THEN 'a quién afecta ' || regexp_replace(string_split(arg, '/')[-1], '\\.[^.]+$', '') WHEN 'otro' THEN set_key ELSE arg END AS label FROM s""")
def set_labels(spark: SparkSession, d: str) -> DataFrame:
    """What sets named by parts are called, of all kinds."""
    kinds = F.array(*map(F.lit, ("dir", "mod", "author", "lang", "state", "risk", "cov", "flag", "role", "tag", "saved", "pkg", "hot", "many", "deps", "reach", "otro")))
    kind = F.get(kinds, F.col("p_partkey") % 17)
    arg = F.when(F.col("p_partkey") % 5 == 0, "ninguna").otherwise(F.concat("p_brand", F.lit("/"), "p_name", F.lit(".js")))
    key = F.when(kind.isin("hot", "many"), kind).otherwise(F.concat_ws(":", kind, arg))
    return read(spark, d, "part").select(key.alias("set_key")).distinct().select("set_key", sets.label(F.col("set_key")).alias("label"))


OFFERED = """p AS (SELECT p_partkey AS id, p_brand, p_size, p_type, p_partkey % 40 AS m FROM part), w AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS author FROM lineitem),
e AS (SELECT 'dir:' || p_brand AS set_key, id FROM p UNION ALL SELECT 'dir:' || p_brand || '/' || p_size, id FROM p UNION ALL SELECT 'mod:' || m, id FROM p UNION ALL SELECT 'lang:' || p_type, id FROM p UNION ALL SELECT 'author:' || author, id FROM w
  UNION ALL SELECT CASE p_size % 3 WHEN 0 THEN 'risk:alto' WHEN 1 THEN 'risk:medio' ELSE 'risk:bajo' END, id FROM p UNION ALL SELECT 'pkg:' || p_size, id FROM p WHERE p_size > 40 UNION ALL SELECT 'hot', id FROM p WHERE p_size < 5 UNION ALL SELECT 'role:hub', id FROM p)"""


def _offered(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    keyed = lambda df, key: df.select(key.alias("set_key"), F.col("p_partkey").alias("id"))
    named = lambda kind, *cols: F.concat(F.lit(kind + ":"), F.concat_ws("/", *[F.col(c).cast("string") for c in cols]))
    size = F.col("p_size")
    out = keyed(part, named("dir", "p_brand")).union(keyed(part, named("dir", "p_brand", "p_size"))).union(keyed(part, F.concat(F.lit("mod:"), (F.col("p_partkey") % 40).cast("string")))).union(keyed(part, named("lang", "p_type")))
    out = out.union(read(spark, d, "lineitem").select(F.concat(F.lit("author:"), F.col("l_suppkey").cast("string")), "l_partkey").distinct())
    out = out.union(keyed(part, F.when(size % 3 == 0, "risk:alto").when(size % 3 == 1, "risk:medio").otherwise("risk:bajo"))).union(keyed(part.filter(size > 40), named("pkg", "p_size")))
    return out.union(keyed(part.filter(size < 5), F.lit("hot"))).union(keyed(part, F.lit("role:hub")))


@register(f"""WITH {OFFERED}, n AS (SELECT set_key, split_part(set_key, ':', 1) AS kind, count(DISTINCT id) AS n FROM e GROUP BY set_key),
f AS (SELECT CASE WHEN kind = 'dir' AND n >= 2 THEN 'Carpetas' WHEN kind = 'mod' AND n >= 2 THEN 'Módulos detectados' WHEN kind = 'author' THEN 'Autores' WHEN kind = 'lang' THEN 'Lenguajes' WHEN set_key IN ('risk:alto', 'risk:medio', 'hot') THEN 'Riesgo y pruebas' WHEN kind = 'pkg' AND n >= 2 THEN 'Paquetes externos' END AS family, set_key, n FROM n)
SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY n DESC, set_key) AS INTEGER) AS place, set_key, n FROM f WHERE family IS NOT NULL""")
def set_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Sets of parts in their families, the largest first."""
    return sets.catalog(_offered(spark, d))


def _recipe_sql(picks: str) -> str:
    return f"WITH {OFFERED}, n AS (SELECT set_key, count(DISTINCT id) AS n FROM e GROUP BY set_key), k AS ({picks}), x AS (SELECT id, sum(DISTINCT 1 << (place - 1)) AS mask FROM e JOIN k USING (set_key) GROUP BY id) SELECT CAST(mask AS INTEGER) AS mask, count(*) AS n FROM x GROUP BY mask"


@register(_recipe_sql("SELECT set_key, row_number() OVER (ORDER BY n DESC, set_key) AS place FROM n WHERE set_key LIKE 'author:%' QUALIFY place <= 3"))
def recipe_knowledge(spark: SparkSession, d: str) -> DataFrame:
    return sets.recipe(_offered(spark, d), "knowledge")[0]


@register(_recipe_sql("""SELECT set_key, 1 AS place FROM (SELECT 'dir:' || p_brand || '/' || p_size AS set_key, count(*) AS c FROM p GROUP BY 1 ORDER BY c DESC, set_key LIMIT 1)
  UNION ALL SELECT set_key, 1 + row_number() OVER (ORDER BY c DESC, set_key) AS place FROM (SELECT e.set_key, count(DISTINCT id) AS c FROM e JOIN n USING (set_key) WHERE e.set_key LIKE 'mod:%' AND n.n >= 2 AND id IN (SELECT id FROM p WHERE 'dir:' || p_brand || '/' || p_size = (SELECT 'dir:' || p_brand || '/' || p_size AS k FROM p GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1)) GROUP BY 1) QUALIFY place <= 3"""))
def recipe_folder_module(spark: SparkSession, d: str) -> DataFrame:
    return sets.recipe(_offered(spark, d), "folder-module")[0]


SNAPS = """n AS (SELECT max(o_orderdate) AS now FROM orders), o AS (SELECT o_custkey AS id, o_orderdate, o_totalprice, now FROM orders, n),
b AS (SELECT id, CAST(count(*) AS INTEGER) * 4 AS risk, CASE WHEN count(*) > 12 THEN 'activo' ELSE 'estable' END AS state, count(*) AS fan_in FROM o WHERE o_orderdate < now - INTERVAL 400 DAY GROUP BY id),
a AS (SELECT id, CAST(count(*) AS INTEGER) * 4 AS risk, CASE WHEN count(*) > 12 THEN 'activo' ELSE 'estable' END AS state, count(*) AS fan_in FROM o WHERE o_orderdate >= now - INTERVAL 2000 DAY GROUP BY id)"""


def _snaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, d, "orders")
    rows = orders.crossJoin(F.broadcast(orders.agg(F.max("o_orderdate").alias("now"))))
    state = F.when(F.count("*") > 12, "activo").otherwise("estable")
    snap = lambda r: r.groupBy(F.col("o_custkey").alias("id")).agg((F.count("*").cast("int") * 4).alias("risk"), state.alias("state"), F.count("*").alias("fan_in"))
    return snap(rows.filter(F.col("o_orderdate") < F.col("now") - F.expr("interval 400 days"))), snap(rows.filter(F.col("o_orderdate") >= F.col("now") - F.expr("interval 2000 days")))


@register(f"""WITH {SNAPS}, f AS (SELECT coalesce(b.id, a.id) AS id, b.risk AS r0, a.risk AS r1, b.state AS s0, a.state AS s1 FROM b FULL JOIN a ON a.id = b.id)
SELECT id, 'añadido' AS change, NULL AS "from", s1 AS "to" FROM f WHERE r0 IS NULL UNION ALL SELECT id, 'eliminado', s0, NULL FROM f WHERE r1 IS NULL
UNION ALL SELECT id, 'riesgo', CAST(r0 AS VARCHAR), CAST(r1 AS VARCHAR) FROM f WHERE r1 - r0 >= 8 UNION ALL SELECT id, 'estado', s0, s1 FROM f WHERE s0 <> s1""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return compare.snapshot_diff(*_snaps(spark, d))


@register(f"""WITH {SNAPS}, w AS (SELECT coalesce(b.id, a.id) AS id, b.risk AS r0, a.risk AS r1, b.fan_in AS f0, a.fan_in AS f1, coalesce(a.id, b.id) % 5 = 0 AS dyn, coalesce(a.id, b.id) % 2 = 0 AS cov, coalesce(a.id, b.id) % 7 = 0 AS skip, coalesce(a.id, b.id) % 14 = 0 AS test FROM b FULL JOIN a ON a.id = b.id),
f AS (SELECT * FROM w WHERE NOT skip)
SELECT id, 'riesgo' AS rule, CASE WHEN r1 >= 55 THEN 'revisar' ELSE 'nota' END AS sev FROM f WHERE r1 - r0 >= 8 OR (r1 >= 55 AND r0 < 55)
UNION ALL SELECT id, 'dependientes', 'nota' FROM f WHERE f1 - f0 >= 3 UNION ALL SELECT id, 'reflexión', 'nota' FROM f WHERE r0 IS NOT NULL AND r1 IS NOT NULL AND dyn
UNION ALL SELECT id, CASE WHEN NOT cov THEN 'sin pruebas' ELSE 'nuevo' END, CASE WHEN NOT cov THEN 'revisar' ELSE 'nota' END FROM f WHERE r0 IS NULL UNION ALL SELECT id, 'eliminado en uso', 'revisar' FROM w WHERE r1 IS NULL AND f0 > 0 AND NOT test""")
def fingerprint_check(spark: SparkSession, d: str) -> DataFrame:
    more = lambda s, dyn: s.withColumns({"loc": F.lit(20), "covered": F.col("id") % 2 == 0, "dynamic": dyn, "skipped": F.col("id") % 7 == 0, "test": F.col("id") % 14 == 0})
    before, after = _snaps(spark, d)
    return compare.check(more(before, F.lit(False)), more(after, F.col("id") % 5 == 0))


FILES = """n AS (SELECT max(l_shipdate) AS now FROM lineitem),
u AS (SELECT l_partkey, count(*) AS fan_in, count(*) FILTER (l_shipdate >= now - INTERVAL 90 DAY) AS c90, count(DISTINCT l_suppkey) AS owners FROM lineitem, n GROUP BY l_partkey),
f AS (SELECT p_partkey AS id, coalesce(fan_in, 0) AS fan_in, coalesce(c90, 0) AS c90, p_brand = 'Brand#11' AS in_cycle, CASE p_size % 3 WHEN 0 THEN 'ninguna' WHEN 1 THEN 'indirecta' ELSE 'directa' END AS coverage, coalesce(owners, 0) = 1 AS sole_owner, p_size * 7 AS loc, (p_size % 5)::DOUBLE / 10 AS dup_pct, CASE WHEN p_size % 10 = 0 THEN 'costosa' ELSE 'inofensiva' END AS dup_sev, p_size % 11 = 0 AS skipped, p_size % 22 = 0 AS is_test FROM part LEFT JOIN u ON l_partkey = p_partkey),
x AS (SELECT greatest(4, max(fan_in)) AS mi, greatest(4, max(c90)) AS mc FROM f WHERE NOT is_test),
q AS (SELECT f.*, least(1, fan_in / mi) * 0.28::DOUBLE / 1.08 + least(1, c90 / mc) * 0.26::DOUBLE / 1.08 + CASE WHEN in_cycle THEN 1 ELSE 0 END * 0.16::DOUBLE / 1.08
  + least(1, CASE WHEN coverage = 'ninguna' AND fan_in >= 1 THEN 0.5 + 0.5 * (fan_in / mi) WHEN coverage = 'indirecta' THEN 0.25 * (fan_in / mi) ELSE 0 END) * 0.14::DOUBLE / 1.08
  + CASE WHEN sole_owner THEN 1 ELSE 0 END * 0.10::DOUBLE / 1.08 + least(1, loc::DOUBLE / 300) * 0.06::DOUBLE / 1.08 + least(1, dup_pct * CASE WHEN dup_sev = 'costosa' THEN 1.6::DOUBLE ELSE 0.6::DOUBLE END) * 0.08::DOUBLE / 1.08 AS raw FROM f, x),
r AS (SELECT *, CAST(CASE WHEN skipped THEN 0 ELSE floor(round(raw * 100, 6) + 0.5) END AS INTEGER) AS score FROM q)"""


def files_of(spark: SparkSession, d: str, sold: DataFrame | None = None) -> DataFrame:
    """Parts as files; with ``sold`` (l_partkey, author, commits), what is counted there isn't counted from all lines again."""
    lines = read(spark, d, "lineitem")
    rows = lines.crossJoin(F.broadcast(lines.agg(F.max("l_shipdate").alias("now"))))
    recent = F.col("l_shipdate") >= F.col("now") - F.expr("interval 90 days")
    of = F.col("l_partkey").alias("p_partkey")
    if sold is None:
        uses = rows.groupBy(of).agg(F.count("*").alias("fan_in"), F.count_if(recent).alias("c90"), F.count_distinct("l_suppkey").alias("owners"))
    else:
        counted = sold.groupBy(of).agg(F.sum("commits").alias("fan_in"), F.count("author").alias("owners"))
        uses = counted.join(rows.filter(recent).groupBy(of).agg(F.count("*").alias("c90")), "p_partkey", "left")
    part, size = read(spark, d, "part").join(uses, "p_partkey", "left").na.fill(0, ["fan_in", "c90", "owners"]), F.col("p_size")
    files = part.select(
        F.col("p_partkey").alias("id"), "fan_in", "c90", (F.col("p_brand") == "Brand#11").alias("in_cycle"),
        F.when(size % 3 == 0, "ninguna").when(size % 3 == 1, "indirecta").otherwise("directa").alias("coverage"),
        (F.col("owners") == 1).alias("sole_owner"), (size * 7).alias("loc"), (size % 5 / 10).alias("dup_pct"),
        F.when(size % 10 == 0, "costosa").otherwise("inofensiva").alias("dup_sev"), (size % 11 == 0).alias("skipped"), (size % 22 == 0).alias("is_test"),
    )
    scored = risk.risk(files)
    return scored.withColumns({"role": F.when(F.col("fan_in") == 0, "orphan").otherwise("module"), "commits": F.col("fan_in")})


@register(f"WITH {FILES} SELECT id, score, CASE WHEN score >= 55 THEN 'alto' WHEN score >= 30 THEN 'medio' ELSE 'bajo' END AS level FROM r")
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).select("id", "score", "level")


@register(f"""WITH {FILES}, t AS (SELECT * FROM r WHERE NOT skipped), p AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey), l AS (SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS b FROM part GROUP BY p_type),
k AS (SELECT least(30, 12 * (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand = 'Brand#11')) + least(12, 4 * (SELECT count(*) FROM p WHERE n >= 6)) + least(15, 5 * (SELECT count(*) FROM p WHERE n < 2)) + least(6, 2 * (SELECT count(*) FROM l WHERE b >= 3 AND n >= 4))
  + least(8, 2 * count(*) FILTER (fan_in >= 2 AND coverage = 'ninguna')) + least(12, 3 * count(*) FILTER (score >= 55)) + least(9, 3 * count(*) FILTER (c90 >= 3 AND fan_in >= 2 AND sole_owner)) + least(6, 2 * count(*) FILTER (fan_in = 0)) AS off FROM t)
SELECT CAST(greatest(0, 100 - off) AS BIGINT) AS score, CASE WHEN 100 - off >= 75 THEN 'sana' WHEN 100 - off >= 50 THEN 'atención' ELSE 'frágil' END AS grade FROM k""")
def health(spark: SparkSession, d: str) -> DataFrame:
    """All eight kinds: files from parts, a cycle from a brand, pairs and groups from nations' suppliers, literals from types."""
    files = files_of(spark, d)
    nations = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    types = read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("b"))
    counts = risk.health_counts(
        files,
        cycles=read(spark, d, "part").filter("p_brand = 'Brand#11'").select(F.col("p_brand").alias("component")),
        pairs=nations.select((F.col("n") >= 6).alias("hidden")),
        groups=nations.select(F.when(F.col("n") < 2, "costosa").otherwise("latente").alias("sev")),
        literals=types.select(F.when((F.col("b") >= 3) & (F.col("n") >= 4), "media").otherwise("info").alias("sev")),
    )
    return risk.health(counts)


@register(f"""WITH {FILES}, t AS (SELECT *, c90 >= 1 AND fan_in >= 2 AS hotspot FROM r WHERE NOT skipped)
SELECT 'hotspot' AS kind, CASE WHEN score >= 55 THEN 'alta' ELSE 'media' END AS sev, id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place FROM t WHERE hotspot QUALIFY place <= 4
UNION ALL SELECT 'pruebas', 'media', id, 1 FROM t WHERE NOT hotspot AND fan_in >= 2 AND coverage = 'ninguna'
UNION ALL SELECT 'dueño', 'media', id, 1 FROM t WHERE NOT hotspot AND sole_owner AND fan_in >= 4 AND loc >= 40 UNION ALL SELECT 'huérfano', 'info', id, 1 FROM t WHERE fan_in = 0""")
def insights(spark: SparkSession, d: str) -> DataFrame:
    files = files_of(spark, d)
    return file_findings(files, hot=1)


QUESTIONS = ("¿Qué es lo más riesgoso de tocar?", "qué se rompe si cambio esto", "archivos que cambian juntos", "¿dónde está la duplicación?", "sin pruebas", "¿quién conoce esto?", "qué puedo borrar", "ciclos", "código generado", "reflexión", "funciones recursivas", "novedades desde ayer", "¿cómo está la salud?", "xyzzy")


@register("WITH q(q) AS (VALUES " + ", ".join(f"('{q}')" for q in QUESTIONS) + "), a AS (SELECT q FROM q UNION ALL SELECT text FROM conversations), f AS (SELECT q, translate(lower(q), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy') AS t FROM a)\nSELECT q, CASE " + " ".join(f"WHEN regexp_matches(t, '{rx}') THEN '{name}'" for name, rx in text.INTENTS) + " ELSE 'none' END AS intent FROM f")
def intents(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "q string").union(read(spark, d, "conversations").select(F.col("text").alias("q")))
    return asked.select("q", text.intent(F.col("q")).alias("intent"))


@register("SELECT user_id, count(*) AS n, max(ts) AS last, CAST(0 AS BIGINT) AS revision FROM events GROUP BY user_id")
def stream_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Files that arrive as a stream rebuild the table of activity; the revision is the last batch's number."""
    from ..streaming.rebuild import rebuild

    return rebuild(spark, f"{d}/events.parquet")


@register("""WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS id, length(text) AS n FROM documents WHERE length(text) <= 60000),
g(i, id, n, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT s.i, CASE WHEN g.used + s.n <= 3000000 THEN s.id END, s.n, CASE WHEN g.used + s.n <= 3000000 THEN g.used + s.n ELSE g.used END FROM g JOIN s ON s.i = g.i + 1)
SELECT id, n FROM g WHERE id IS NOT NULL""")
def embedded_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents of 60,000 characters or fewer, in order, until 3,000,000 are used; one that doesn't fit any more is passed over."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    return measures.greedy(rows, "id", "n", most=60_000, budget=3_000_000)
