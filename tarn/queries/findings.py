"""Queries of ranks, copies, literals, findings in words and partners of a change, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cochange
from ..plans import duplicates, review, wording, world
from ..session import cut
from .common import Registry, read
from .history import PAIRS
from .worlds import FILES, files_of

register = Registry()

_RANK = "floor(100 * (rank() OVER (ORDER BY {0}) - 1 + count(*) OVER (PARTITION BY {0}) / 2) / count(*) OVER () + 0.5)::BIGINT AS pct_{0}"
_FAR = "CASE WHEN CASE WHEN d_{0} > 0 THEN 0.6745::DOUBLE * ({0} - m_{0}) / d_{0} WHEN {0} > m_{0} THEN 3.6 ELSE 0 END > 3.5 THEN '{1}' END"
_VALUES = ("c90", "loc", "fan_in")


@register(f"""WITH {FILES}, k AS (SELECT id, c90, loc, fan_in, fan_in AS commits FROM r WHERE NOT is_test), m AS (SELECT {", ".join(f"median({v}) AS m_{v}" for v in _VALUES)} FROM k),
w AS (SELECT {", ".join(f"median(abs({v} - m_{v})) AS d_{v}" for v in _VALUES)} FROM k, m)
SELECT id, {", ".join(_RANK.format(v) for v in (*_VALUES, "commits"))}, concat_ws(',', {", ".join(_FAR.format(v, n) for v, n in world.OUTLIERS)}) AS outlier FROM k, m, w""")
def file_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each part's place among all by recent sales, size and use, and of what it has far more than others."""
    return world.placed(files_of(spark, d).filter("not is_test")).withColumn("outlier", F.array_join("outlier", ","))


@register("""WITH t AS (SELECT DISTINCT l_orderkey AS tx, l_partkey AS item FROM lineitem), o AS (SELECT item, count(*) AS n FROM t GROUP BY item), b AS (SELECT *, p_name || '/' || p_brand AS grp FROM part),
u AS (SELECT x.grp, t.tx, t.item FROM t JOIN b x ON x.p_partkey = t.item), q AS (SELECT x.grp, x.item AS a, y.item AS b, count(*) AS n FROM u x JOIN u y ON x.tx = y.tx AND x.grp = y.grp AND x.item < y.item GROUP BY ALL),
z AS (SELECT q.grp, max((floor(q.n / least(ca.n, cb.n) * 100 + 0.5) / 100, q.n)) AS m FROM q JOIN o ca ON ca.item = a JOIN o cb ON cb.item = b GROUP BY q.grp),
g AS (SELECT grp, CAST(floor(avg(p_size) + 0.5) AS BIGINT) AS lines, count(*) AS copies, count(DISTINCT p_type) AS owners, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS who FROM b GROUP BY grp HAVING count(*) > 1),
k AS (SELECT g.*, coalesce(z.m[1], 0) AS co_rate, coalesce(z.m[2], 0) AS co_count FROM g LEFT JOIN z USING (grp)),
s AS (SELECT *, CAST(least(100, floor(8 * sqrt(lines * (copies - 1)) * (1 + 2 * co_rate) * CASE WHEN owners > 1 THEN 1.25::DOUBLE ELSE 1 END + 0.5)) AS INTEGER) AS score FROM k)
SELECT 'd' || (row_number() OVER (ORDER BY score DESC, grp) - 1) AS id, grp AS "group", copies, co_rate, co_count, who AS owners, CASE WHEN co_rate >= 0.5 AND co_count >= 2 THEN 'costosa' ELSE 'latente' END AS sev, score FROM s""")
def group_costs(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one name and brand are copies, their types who owns them; a copy costs if it is ordered with another."""
    part = read(spark, d, "part").withColumn("group", F.concat_ws("/", "p_name", "p_brand"))
    touches = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("item")).distinct()
    sized = part.groupBy("group").agg(F.floor(F.avg("p_size") + 0.5).alias("lines"), F.count("*").alias("copies"), F.count("*").alias("files")).filter("copies > 1").withColumn("test", F.lit(False))
    members = part.join(sized.select("group"), "group", "left_semi").select("group", F.col("p_partkey").alias("file"))
    commits = touches.groupBy(F.col("item").alias("p_partkey")).agg(F.count("*").alias("commits"))
    files = part.join(commits, "p_partkey", "left").select(F.col("p_partkey").alias("id"), "commits", F.col("p_type").alias("owner"))
    # only orders that have two copies of one group can count
    grouped = touches.join(members.select(F.col("file").alias("item"), "group"), "item").select(F.struct("tx", "group").alias("tx"), "item")
    together = cochange.pair_counts(grouped, "tx", "item", most=1_000_000)
    found = duplicates.costed(sized, members, files, together)
    return found.select("id", "group", "copies", "co_rate", "co_count", F.array_join("owners", ",").alias("owners"), "sev", "score")


@register("""WITH l AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'num' ELSE 'str' END || ':' || p_type AS key, p_brand AS file, p_partkey AS line, p_name AS name, p_size FROM part), o AS (SELECT * FROM l WHERE file <> 'Brand#11'),
g AS (SELECT key, count(*) AS count, count(DISTINCT file) AS files FROM o GROUP BY key HAVING count(*) >= 3 AND count(DISTINCT file) >= 2), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file, line) AS n FROM o),
a AS (SELECT key, string_agg(file || ':' || line, ', ' ORDER BY n) AS "at" FROM p WHERE n <= 12 GROUP BY key), e AS (SELECT key, min((file, line, name)) AS e FROM l WHERE p_size < 5 GROUP BY key)
SELECT key, count, files, "at", CASE WHEN files >= 3 AND count >= 4 THEN 'media' ELSE 'info' END AS sev, e[3] AS existing FROM g JOIN a USING (key) LEFT JOIN e USING (key)""")
def literal_places(spark: SparkSession, d: str) -> DataFrame:
    """Types of parts as literals in the brands' files; small parts are the constants that hold one, a brand is a test."""
    part = read(spark, d, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "num").otherwise("str")
    rows = part.select(F.col("p_type").alias("value"), kind.alias("kind"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.col("p_name").alias("name"), "p_size")
    files = part.select(F.col("p_brand").alias("id"), (F.col("p_brand") == "Brand#11").alias("is_test"), F.lit(None).cast("string").alias("gen"), F.lit(False).alias("aux")).distinct()
    found = duplicates.constants(rows.drop("name", "p_size"), rows.filter("p_size < 5").drop("p_size"), files)
    at = F.array_join(F.transform("at", lambda a: F.concat(a["file"], F.lit(":"), a["line"].cast("string"))), ", ")
    return found.select("key", "count", "files", at.alias("at"), "sev", F.col("existing.name").alias("existing"))


@register("""WITH u AS (SELECT p_name AS name, p_brand AS file, p_size AS start FROM part WHERE p_size % 11 <> 0 AND p_size % 7 <> 0 AND p_size % 5 <> 0 AND length(p_name) >= 5), n AS (SELECT name, count(DISTINCT file) AS files, count(*) AS units FROM u GROUP BY name HAVING count(DISTINCT file) >= 2)
SELECT name, file, min(start) AS start, any_value(files) AS files, any_value(units) AS units FROM u JOIN n USING (name) GROUP BY name, file""")
def homonym_units(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts in several brands, without tests, callbacks and copies, which sizes tell."""
    size = F.col("p_size")
    kind = F.when(size % 7 == 0, "callback").otherwise("function")
    units = read(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_brand").alias("file"), size.alias("start"), (size % 11 == 0).alias("test"))
    return duplicates.homonyms(units, units.filter("start % 5 = 0"))


@register(f"""WITH {FILES}, k AS (SELECT *, 'm' || id % 20 || '/p' || id || '.js' AS path, 'm' || id % 20 || '/p' || id AS name, c90 >= 1 AND fan_in >= 2 AS hot, skipped AND NOT is_test AS made, loc % 5 = 0 AS dyn, in_cycle AND NOT (skipped AND NOT is_test) AS wip FROM r),
o AS (SELECT * FROM k WHERE NOT skipped),
hs AS (SELECT 1 AS turn, -score::DOUBLE AS pos, path AS key, CASE WHEN score >= 55 THEN 'alta' ELSE 'media' END AS sev, 'hotspot' AS kind, name || ' cambia mucho y otros dependen de él' AS title, c90 || ' cambios en 90 días · lo importan ' || fan_in || ' archivos · ' || CASE coverage WHEN 'directa' THEN 'tiene pruebas' ELSE 'sin pruebas' END || ' · ' || CASE WHEN sole_owner THEN 'solo lo toca s' || loc % 9 ELSE '2 autores principales' END || '.' AS detail, 1 AS n FROM o WHERE hot ORDER BY score DESC, path LIMIT 4),
p AS (SELECT *, row_number() OVER (ORDER BY path) AS nth, count(*) OVER () AS total FROM o WHERE fan_in >= 2 AND coverage = 'ninguna' AND NOT hot),
ps AS (SELECT 2, 0, '', 'media', 'pruebas', any_value(total) || CASE any_value(total) WHEN 1 THEN ' módulo muy usado' ELSE ' módulos muy usados' END || ' sin ninguna prueba', string_agg(name || ' (' || fan_in || ')', ', ' ORDER BY nth) FILTER (nth <= 100) || '. Ninguna prueba los toca, ni directa ni indirectamente.', any_value(total) FROM p HAVING count(*) > 0),
du AS (SELECT 4, 0, path, 'media', 'dueño', 'Solo s' || loc % 9 || ' conoce ' || name, fan_in || ' commits y 90% de ellos del mismo autor.', 1 FROM o WHERE sole_owner AND NOT hot AND fan_in >= 4 AND loc >= 40),
hu AS (SELECT 5, 0, path, 'info', 'huérfano', name || ' no está conectado', 'Nadie lo importa.', 1 FROM o WHERE fan_in = 0),
g AS (SELECT *, row_number() OVER (ORDER BY path) AS nth, count(*) OVER () AS total FROM k WHERE made),
ge AS (SELECT 7, 0, '', 'info', 'generado', any_value(total) || CASE any_value(total) WHEN 1 THEN ' archivo generado' ELSE ' archivos generados' END || ' (no se editan a mano)', string_agg(name || ': marca', ' · ' ORDER BY nth) FILTER (nth <= 4) || '.', any_value(total) FROM g HAVING count(*) > 0),
y AS (SELECT *, row_number() OVER (ORDER BY path) AS nth, count(*) OVER () AS total FROM o WHERE dyn),
dy AS (SELECT 8, 0, '', 'info', 'reflexión', any_value(total) || CASE any_value(total) WHEN 1 THEN ' archivo usa' ELSE ' archivos usan' END || ' reflexión o carga dinámica', string_agg(name || ' (eval, require)', ' · ' ORDER BY nth) FILTER (nth <= 4) || '.', any_value(total) FROM y HAVING count(*) > 0),
w AS (SELECT *, row_number() OVER (ORDER BY is_test, path) AS nth, count(*) OVER () AS total FROM k WHERE wip),
wi AS (SELECT 10, 0, '', 'info', 'trabajo', any_value(total) || CASE any_value(total) WHEN 1 THEN ' archivo' ELSE ' archivos' END || ' con cambios sin commit', string_agg('p' || id || ' (nuevo)', ', ' ORDER BY nth) FILTER (nth <= 100) || '.', any_value(total) FROM w HAVING count(*) > 0),
a AS (SELECT * FROM hs UNION ALL SELECT * FROM ps UNION ALL SELECT * FROM du UNION ALL SELECT * FROM hu UNION ALL SELECT * FROM ge UNION ALL SELECT * FROM dy UNION ALL SELECT * FROM wi)
SELECT 'i' || (row_number() OVER (ORDER BY CASE sev WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END, turn, pos, key) - 1) AS id, kind, sev, title, detail, CAST(n AS BIGINT) AS files FROM a""")
def findings_told(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files, told in words: what is hot, untested, known by one, unconnected, generated, reflective and uncommitted."""
    c, none = F.col, F.lit(None)
    path = F.format_string("m%s/p%s.js", c("id") % 20, "id")
    hot, made = (c("c90") >= 1) & (c("fan_in") >= 2), c("skipped") & ~c("is_test")
    wip = c("in_cycle") & ~made
    files = files_of(spark, d).withColumns({
        "bus_factor": F.when(c("sole_owner"), 1).otherwise(2), "owner": F.format_string("s%s", c("loc") % 9), "owner_share": F.lit(0.9), "last": none.cast("timestamp"),
        "gen": F.when(made, "marca"), "dynamic": ~c("is_test") & (c("loc") % 5 == 0), "status": F.when(wip, "untracked"),
        "dyn": F.array(F.struct(F.lit(1).alias("line"), F.lit("eval").alias("what")), F.struct(F.lit(2).alias("line"), F.lit("require").alias("what"))),
        "flags": F.array_compact(F.array(F.when(hot, "hotspot"), F.when(c("sole_owner") & (c("commits") >= 1), "propietario-único"), F.when(wip, "sin-commit"))),
    })
    told, about = wording.told(cut(files.withColumn("id", path)))
    counts = about.groupBy("id").agg(F.count("*").alias("files"))
    return told.join(counts, "id").select("id", "kind", "sev", "title", "detail", "files")


@register(f"""WITH {PAIRS}, h AS (SELECT c.*, x.p_brand = y.p_brand AS linked, x.p_size <= 10 AS ca, y.p_size <= 10 AS cb FROM c JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b),
m AS (SELECT a AS id, b AS other, count, strength, linked FROM h WHERE ca AND NOT cb UNION ALL SELECT b, a, count, strength, linked FROM h WHERE cb AND NOT ca)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY count * strength DESC, other) <= 5""")
def change_partners(spark: SparkSession, d: str) -> DataFrame:
    """Small parts are changed: what is mostly ordered with each and isn't small itself; parts of a brand are linked."""
    part = read(spark, d, "part")
    pairs = cochange.associated(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", strength=0.05)
    a, b = (part.select(F.col("p_partkey").alias(x), F.col("p_brand").alias(f"brand_{x}")) for x in "ab")
    told = pairs.join(a, "a").join(b, "b").withColumn("hidden", F.col("brand_a") != F.col("brand_b"))
    return review.together(part.filter("p_size <= 10").select(F.col("p_partkey").alias("id")), cut(told))
