"""Queries of answers, bridges, guards, relations and sets of a repository, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clones, cochange, compare, graph, history, measures
from ..operators.risk import WEIGHTS
from ..plans import answers, ask, bridges as http, guard, insights as found, relations, signals, store
from ..session import cut
from ..session import shares as parts_for
from .common import G, Registry, brand_graph, read
from .history import PAIRS
from .worlds import FILES, SNAPS, _snaps, files_of

register = Registry()


def top(order: str, n: int, said: str, tag: str, source: str, where: str = "true", id_: str = "id") -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}, CAST({id_} AS VARCHAR)) AS INTEGER) AS place, CAST({id_} AS VARCHAR) AS id, {said} AS text, {tag} AS tag FROM {source} WHERE {where} QUALIFY place <= {n}"


@register(f"WITH {FILES} " + top("-score", 5, "'riesgo ' || score || ' · ' || fan_in || ' dependientes · ' || c90 || ' cambios/90 d'", "CASE WHEN score >= 55 THEN 'alto' WHEN score >= 30 THEN 'medio' ELSE 'bajo' END", "r", "NOT skipped"))
def ask_risk(spark: SparkSession, d: str) -> DataFrame:
    return answers.risk(files_of(spark, d))


@register(f"WITH {FILES} " + top("-score", 6, "'riesgo ' || score || ' · ' || fan_in || ' dependientes · ' || c90 || ' cambios/90 d'", "'sin pruebas'", "r", "NOT skipped AND coverage = 'ninguna' AND fan_in > 0"))
def ask_tests(spark: SparkSession, d: str) -> DataFrame:
    return answers.tests(files_of(spark, d))


@register(f"WITH {FILES} " + top("-score", 6, "'p' || id || ' · ' || fan_in || ' commits'", "'propietario único'", "r", "NOT skipped AND id % 13 = 0"))
def ask_owner(spark: SparkSession, d: str) -> DataFrame:
    """Each thirteenth part is known by one person."""
    return answers.owner(files_of(spark, d).withColumn("sole_owner", F.col("id") % 13 == 0).withColumn("owner", F.concat(F.lit("p"), F.col("id").cast("string"))))


@register(f"""WITH {FILES}, a AS ({top('0', 6, "'nadie lo importa · ' || loc || ' líneas'", "'huérfano'", 'r', 'NOT skipped AND fan_in = 0')}),
y AS (SELECT s_suppkey AS file, s_name AS name FROM supplier JOIN r ON r.id = s_suppkey WHERE NOT skipped AND s_nationkey % 3 = 0)
SELECT * FROM a UNION ALL SELECT CAST(6 + row_number() OVER (ORDER BY file, name) AS INTEGER) AS place, CAST(file AS VARCHAR), 'símbolo ' || name || ' sin usos', 'sin uso' FROM y QUALIFY place <= 10""")
def ask_dead(spark: SparkSession, d: str) -> DataFrame:
    """Orphaned parts; a supplier is the symbol of the part of its number, unused in every third nation."""
    symbols = read(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 3).alias("total"))
    return answers.dead(files_of(spark, d).withColumnRenamed("loc", "lines"), symbols)


@register(f"""WITH RECURSIVE {G}, v AS (SELECT src AS id FROM g UNION SELECT dst FROM g),
r(seed, node, depth) AS (SELECT id, id, 0 FROM v UNION SELECT r.seed, g.src, r.depth + 1 FROM r JOIN g ON g.dst = r.node WHERE r.depth < 26),
m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL), t AS (SELECT seed AS id, count(*) AS total, count(*) FILTER (depth = 1) AS direct FROM m WHERE node <> seed GROUP BY seed)
""" + top("-total", 5, "total || ' afectados (' || direct || ' directos)'", "''", "t"))
def ask_impact(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(brand_graph(spark, d)).select("src", "dst")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return answers.impact(nodes.withColumn("skipped", F.lit(False)), graph.impact(edges, nodes))


@register(f"WITH {PAIRS}, h AS (SELECT c.* FROM c JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE x.p_brand <> y.p_brand) " + top("-count * strength, a, b", 6, "'↔ ' || b || ' · ' || count || ' commits juntos'", "'oculto'", "h", id_="a"))
def ask_hidden(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    pairs = cochange.associated(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", strength=0.05)
    a, b = (part.select(F.col("p_partkey").alias(x), F.col("p_brand").alias(f"brand_{x}")) for x in "ab")
    return answers.hidden(pairs.join(a, "a").join(b, "b").withColumn("hidden", F.col("brand_a") != F.col("brand_b")))


CLONES = """g AS (SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS first, count(*) AS copies, count(DISTINCT source) AS files, any_value(len(string_split(coalesce(text, ''), chr(10)))) AS lines FROM documents GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT first AS grp, copies, lines, 'latente' AS sev, CAST(least(100, floor(8 * sqrt(lines * (copies - 1)) * CASE WHEN files > 1 THEN 1.25::DOUBLE ELSE 1 END * CASE WHEN files = 1 THEN 0.7::DOUBLE ELSE 1 END + 0.5)) AS INTEGER) AS score FROM g)"""


def _clones(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    members = clones.exact_groups(docs, "doc_id", "text").join(docs.withColumnRenamed("doc_id", "unit"), "unit")
    sized = members.groupBy(F.col("first").alias("group")).agg(F.count("*").alias("copies"), F.count_distinct("source").alias("files"), F.max(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("lines"))
    score = clones.cost(F.col("lines"), F.col("copies"), F.lit(0.0), F.col("files"), F.lit(False), F.col("files"))
    return sized.withColumns({"sev": clones.severity(F.lit(False), F.lit(0.0), F.lit(0)), "score": score, "test": F.lit(False)})


@register(f"WITH {CLONES} " + top("-score", 5, "copies || ' copias de ' || lines || ' líneas · ' || sev || ' · puntaje ' || score", "sev", "s", id_="grp"))
def ask_dup(spark: SparkSession, d: str) -> DataFrame:
    return answers.duplicates(_clones(spark, d))


@register(f"WITH {CLONES} SELECT 'd' || (row_number() OVER (ORDER BY score DESC, grp) - 1) AS id, grp AS \"group\", score FROM s")
def ranked_groups(spark: SparkSession, d: str) -> DataFrame:
    return clones.ranked(_clones(spark, d)).select("id", "group", "score")


SCC = f"""{G}, c(a, b) AS (SELECT src, dst FROM g UNION SELECT c.a, g.dst FROM c JOIN g ON c.b = g.src),
k AS (SELECT x.a AS node, min(x.b) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1)"""


@register(f"WITH RECURSIVE {SCC}, n AS (SELECT node, dense_rank() OVER (ORDER BY component) AS c, row_number() OVER (PARTITION BY component ORDER BY node) AS n FROM k) SELECT CAST((c - 1) * 4 + n AS INTEGER) AS place, node AS id, 'participa en un ciclo' AS text, 'ciclo' AS tag FROM n WHERE c <= 4 AND n <= 4")
def ask_cycles(spark: SparkSession, d: str) -> DataFrame:
    return answers.cycles(graph.cycles(brand_graph(spark, d).select("src", "dst")))


@register(f"WITH RECURSIVE {SCC}, i AS (SELECT x.component, min((g.n, g.src, g.dst)) AS w FROM g JOIN k x ON x.node = g.src JOIN k y ON y.node = g.dst AND x.component = y.component GROUP BY 1) SELECT component, w[2] AS weakest_src, w[3] AS weakest_dst FROM i")
def weakest_edge(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d)
    return found.cycle_findings(graph.cycles(edges.select("src", "dst")), edges.withColumnRenamed("n", "refs"))


@register("WITH f AS (SELECT doc_id AS id, len(string_split(text, chr(10))) AS lines FROM documents WHERE regexp_matches(text, 'License|Copyright')) " + top("0", 10, "lines || ' líneas · marca'", "'generado'", "f"))
def ask_generated(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return answers.generated(docs.select(F.col("doc_id").alias("id"), F.size(F.split("text", "\n")).alias("lines"), F.when(F.col("text").rlike("License|Copyright"), "marca").alias("gen")))


@register("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), u AS (SELECT id, count(*) AS n, min(line) AS first FROM l WHERE contains(x, 'token') GROUP BY id) """ + top("-n", 8, "'enlace (línea ' || first || ')'", "'reflexión'", "u"))
def ask_dynamic(spark: SparkSession, d: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.when(x.contains("token"), "enlace").alias("what")))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(False).alias("is_test"), F.filter(marked, lambda u: u["what"].isNotNull()).alias("dyn"))
    return answers.dynamic(docs)


@register("""WITH f AS (SELECT s_nationkey AS id, s_name AS name, s_suppkey AS line FROM supplier), k AS (SELECT DISTINCT CAST(id AS VARCHAR) AS id FROM f ORDER BY CAST(id AS INTEGER) LIMIT 8)
SELECT CAST(row_number() OVER (ORDER BY id, line) AS INTEGER) AS place, CAST(id AS VARCHAR) AS id, name || '() se llama a sí misma · línea ' || line AS text, 'directa' AS tag FROM f WHERE CAST(id AS VARCHAR) IN (SELECT id FROM k) QUALIFY place <= 12""")
def ask_recursion(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.lit("directa").alias("kind"), F.array("s_name").alias("names"), F.col("s_suppkey").alias("line"))
    return answers.recursion(rows)


@register(f"""WITH {SNAPS}, f AS (SELECT coalesce(b.id, a.id) AS id, b.risk AS r0, a.risk AS r1, b.state AS s0, a.state AS s1 FROM b FULL JOIN a ON a.id = b.id),
x AS (SELECT id, 0 AS o, 'riesgo' AS change, r0 || ' → ' || r1 AS said FROM f WHERE r1 - r0 >= 8 UNION ALL SELECT id, 1, 'añadido', s1 FROM f WHERE r0 IS NULL UNION ALL SELECT id, 2, 'eliminado', s0 FROM f WHERE r1 IS NULL UNION ALL SELECT id, 3, 'estado', s0 || ' → ' || s1 FROM f WHERE s0 <> s1)
""" + top("o", 14, "change || ' ' || said", "change", "x"))
def ask_since(spark: SparkSession, d: str) -> DataFrame:
    return answers.since(compare.snapshot_diff(*_snaps(spark, d)))


@register(f"""WITH {FILES}, t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, score FROM r WHERE NOT skipped AND c90 >= 1 AND fan_in >= 2 QUALIFY place <= 4)
SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS place, CAST(id AS VARCHAR) AS id, 'hotspot ' || place AS text, 'alta' AS tag FROM t WHERE score >= 30""")
def ask_health(spark: SparkSession, d: str) -> DataFrame:
    """The grave findings; hotspots of middle risk count as grave here, so that there are some."""
    files = files_of(spark, d).withColumn("level", F.when(F.col("score") >= 30, "alto").otherwise("bajo"))
    return answers.health(found.file_findings(files, hot=1))


@register(f"""WITH {FILES}, p AS (SELECT id, least(1, fan_in / mi) * 0.28::DOUBLE AS a, least(1, c90 / mc) * 0.26::DOUBLE AS b, CASE WHEN in_cycle THEN 0.16::DOUBLE ELSE 0 END AS c,
  least(1, CASE WHEN coverage = 'ninguna' AND fan_in >= 1 THEN 0.5 + 0.5 * (fan_in / mi) WHEN coverage = 'indirecta' THEN 0.25 * (fan_in / mi) ELSE 0 END) * 0.14::DOUBLE AS d,
  CASE WHEN sole_owner THEN 0.10::DOUBLE ELSE 0 END AS e, least(1, loc::DOUBLE / 300) * 0.06::DOUBLE AS f, least(1, dup_pct * CASE WHEN dup_sev = 'costosa' THEN 1.6::DOUBLE ELSE 0.6::DOUBLE END) * 0.08::DOUBLE AS g FROM f, x WHERE NOT skipped),
m AS (SELECT *, greatest(a, b, c, d, e, f, g) AS most, a + b + c + d + e + f + g AS total FROM p)
SELECT id, CASE most WHEN a THEN 'fan_in' WHEN b THEN 'churn' WHEN c THEN 'cycle' WHEN d THEN 'untested' WHEN e THEN 'owner' WHEN f THEN 'size' ELSE 'dup' END AS part, CASE WHEN total > 0 THEN floor(most / total * 100 + 0.5) / 100 ELSE 0 END AS share FROM m""")
def dominant_part(spark: SparkSession, d: str) -> DataFrame:
    return answers.dominant(files_of(spark, d), WEIGHTS)


CHAIN = """ch AS (SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice, p_partkey) - 1 AS total FROM part)"""


def price_chain(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): each part and the next dearer one of its brand and size."""
    ranked = Window.partitionBy("p_brand", "p_size").orderBy("p_retailprice", "p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return read(spark, d, "part").select(name(F.col("p_partkey")).alias("src"), name(F.lead("p_partkey").over(ranked)).alias("dst")).filter("dst is not null")


def facts_of(spark: SparkSession, d: str) -> ask.Facts:
    """Parts as files: suppliers are authors, orders commits, a dearer part of the same brand and size is what a part needs."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    lines = read(spark, d, "lineitem").select("l_partkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("author"))
    # dealt once by part: hardly a supplier sells a part twice, so counts by both are as many rows as lines
    sold = cut(history.shares(lines.repartition(parts_for(lines.count(), spark), "l_partkey"), "l_partkey", "author"))
    shares = sold.withColumn("id", name("l_partkey")).drop("l_partkey")
    known = history.bus_factor(shares, "id", "author").drop("authors")
    files = cut(files_of(spark, d, sold).withColumn("id", name("id")).join(known, "id", "left")).withColumns({"lines": F.col("loc"), "last": F.lit(None).cast("timestamp"), "gen": F.lit(None).cast("string"), "dyn": F.array().cast("array<struct<line:int,what:string>>")})
    brand = read(spark, d, "part").select("p_partkey", "p_brand")
    a, b = (brand.select(F.col("p_partkey").alias(x), F.col("p_brand").alias(f"brand_{x}")) for x in "ab")
    pairs = cochange.associated(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", strength=0.05).join(a, "a").join(b, "b").withColumn("hidden", F.col("brand_a") != F.col("brand_b"))
    pairs = cut(pairs.withColumns({"a": name("a"), "b": name("b")}))
    return ask.Facts(files, graph.impact(price_chain(spark, d), files.select("id"), ids=12), pairs, shares=shares, commits=read(spark, d, "orders").count())


@register(f"""WITH {FILES}, {PAIRS}, {CHAIN}, no AS (SELECT count(*) AS commits FROM orders), parts AS (SELECT 'p' || id AS id, * EXCLUDE (id) FROM r),
sh AS (SELECT 'p' || l_partkey AS id, 's' || l_suppkey AS author, count(*) AS commits FROM lineitem GROUP BY ALL),
sp AS (SELECT *, floor(commits / sum(commits) OVER (PARTITION BY id) * 100 + 0.5) / 100 AS share, row_number() OVER (PARTITION BY id ORDER BY commits DESC, author) AS place FROM sh),
sb AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sp),
ow AS (SELECT id, max(author) FILTER (place = 1) AS owner, max(share) FILTER (place = 1) AS owner_share, count(*) FILTER (floor(before * 100 + 0.5) / 100 < 0.7) AS bus, count(*) AS authors, sum(commits) AS commits,
  max(author || ' · ' || commits || ' commits · ' || CAST(floor(share * 100 + 0.5) AS INTEGER) || '%') FILTER (place = 1) AS said FROM sb GROUP BY id),
rk AS (SELECT *, least(1, fan_in / mi) * 0.28::DOUBLE AS a, least(1, c90 / mc) * 0.26::DOUBLE AS b, CASE WHEN in_cycle THEN 0.16::DOUBLE ELSE 0 END AS c,
  least(1, CASE WHEN coverage = 'ninguna' AND fan_in >= 1 THEN 0.5 + 0.5 * (fan_in / mi) WHEN coverage = 'indirecta' THEN 0.25 * (fan_in / mi) ELSE 0 END) * 0.14::DOUBLE AS d,
  CASE WHEN sole_owner THEN 0.10::DOUBLE ELSE 0 END AS e, least(1, loc::DOUBLE / 300) * 0.06::DOUBLE AS f, least(1, dup_pct * CASE WHEN dup_sev = 'costosa' THEN 1.6::DOUBLE ELSE 0.6::DOUBLE END) * 0.08::DOUBLE AS g,
  greatest(a, b, c, d, e, f, g) AS most, a + b + c + d + e + f + g AS whole, row_number() OVER (ORDER BY score DESC, id) AS nth FROM parts, x WHERE NOT skipped),
r1 AS (SELECT *, CASE most WHEN a THEN 'muchos dependen de él' WHEN b THEN 'cambia seguido' WHEN c THEN 'está en un ciclo' WHEN d THEN 'poca cobertura' WHEN e THEN 'lo conoce una sola persona' WHEN f THEN 'tamaño' ELSE 'código duplicado' END AS label FROM rk WHERE nth = 1),
un AS (SELECT id, score, fan_in, c90, row_number() OVER (ORDER BY score DESC, id) AS nth FROM parts WHERE NOT skipped AND coverage = 'ninguna' AND fan_in > 0),
hp AS (SELECT c.*, count(*) OVER () AS n_all, row_number() OVER (ORDER BY -count * strength, 'p' || a, 'p' || b) AS nth FROM c JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE x.p_brand <> y.p_brand),
so AS (SELECT parts.id, score, owner, owner_share, ow.commits, row_number() OVER (ORDER BY score DESC, parts.id) AS nth FROM parts JOIN ow USING (id) WHERE NOT skipped AND sole_owner),
im AS (SELECT 'p' || ch.id AS id, total, coverage, skipped, row_number() OVER (ORDER BY skipped, -total, 'p' || ch.id) AS nth FROM ch JOIN parts ON parts.id = 'p' || ch.id),
nr AS (SELECT count(*) AS n FROM parts WHERE NOT skipped AND fan_in = 0),
ans AS (
  SELECT 'risk' AS intent, '¿Qué es lo más riesgoso de tocar?' AS title, id || ' (riesgo ' || score || '/100). Principal motivo: ' || label || ' (' || CAST(floor(CASE WHEN whole > 0 THEN most / whole ELSE 0 END * 100 + 0.5) AS INTEGER) || '% del puntaje).' AS headline,
    CASE WHEN label IN ('cambia seguido', 'lo conoce una sola persona') THEN CASE WHEN least(fan_in, commits) >= 12 THEN 'alta' WHEN least(fan_in, commits) >= 5 THEN 'media' ELSE 'baja' END ELSE 'alta' END AS level,
    (SELECT least(5, count(*)) FROM rk) AS n_rows, 'riesgo ' || score || ' · ' || fan_in || ' dependientes · ' || c90 || ' cambios/90 d' || CASE coverage WHEN 'directa' THEN '' ELSE ' · sin pruebas' END AS first_row, 'impact,tests,owner' AS follow FROM r1, no
  UNION ALL SELECT 'impact', '¿Qué se rompe si cambio…?', 'El mayor radio de impacto es ' || id || ': ' || total || ' archivos dependen de él directa o indirectamente.', 'alta', (SELECT least(5, count(*)) FROM im WHERE NOT skipped), total || ' afectados (' || least(total, 1) || ' directos)', 'tests,hidden' FROM im WHERE nth = 1
  UNION ALL SELECT 'hidden', '¿Qué archivos cambian juntos sin importarse?', least(n_all, 6) || CASE WHEN n_all = 1 THEN ' par' ELSE ' pares' END || ' cambian juntos sin importarse. El más fuerte: p' || a || ' ↔ p' || b || ' (' || count || ' commits, ' || CAST(floor(strength * 100 + 0.5) AS INTEGER) || '%).', CASE WHEN least(count, commits) >= 12 THEN 'alta' WHEN least(count, commits) >= 5 THEN 'media' ELSE 'baja' END,
    least(n_all, 6), '↔ p' || b || ' · ' || count || ' commits juntos · confianza ' || CAST(floor(conf_ab * 100 + 0.5) AS INTEGER) || '%/' || CAST(floor(conf_ba * 100 + 0.5) AS INTEGER) || '% · lift ' || CASE WHEN lift = floor(lift) THEN CAST(CAST(lift AS BIGINT) AS VARCHAR) ELSE CAST(lift AS VARCHAR) END, 'dup,impact' FROM hp, no WHERE nth = 1
  UNION ALL SELECT 'none!', '¿Dónde la duplicación cuesta más?', 'La detección de duplicados no se ejecutó.', 'baja', 0, NULL, 'risk,hidden,dead'
  UNION ALL SELECT 'tests', '¿Qué importante no tiene pruebas?', (SELECT least(6, count(*)) FROM un) || ' archivos relevantes sin pruebas. El más delicado: ' || id || ' (riesgo ' || score || ', ' || fan_in || ' dependientes).', 'alta', (SELECT least(6, count(*)) FROM un), 'riesgo ' || score || ' · ' || fan_in || ' dependientes · ' || c90 || ' cambios/90 d', 'risk,impact' FROM un WHERE nth = 1
  UNION ALL SELECT 'owner', '¿Quién conoce este código? (factor autobús)', CASE WHEN id IS NULL THEN 'No hay archivos con propietario único y suficiente historial.' ELSE (SELECT least(6, count(*)) FROM so) || '+ archivos dependen de una sola persona. El de más riesgo: ' || id || ' (' || owner || ').' END, CASE WHEN coalesce(so.commits, 0) >= 12 THEN 'alta' WHEN coalesce(so.commits, 0) >= 5 THEN 'media' ELSE 'baja' END,
    (SELECT least(6, count(*)) FROM so), owner || ' · ' || CAST(floor(owner_share * 100 + 0.5) AS INTEGER) || '% de ' || so.commits || ' commits', 'risk,impact' FROM no LEFT JOIN so ON nth = 1
  UNION ALL SELECT 'dead', '¿Qué puedo borrar con seguridad?', CASE WHEN n = 0 THEN 'No hay archivos huérfanos ni símbolos exportados sin uso.' ELSE least(n, 6) || CASE WHEN n = 1 THEN ' archivo huérfano' ELSE ' archivos huérfanos' END || ' y 0 símbolos exportados sin uso.' END, 'alta', least(n, 6),
    (SELECT 'nadie lo importa · ' || arg_min(loc, id) || ' líneas · último cambio ?' FROM parts WHERE NOT skipped AND fan_in = 0), CASE WHEN n = 0 THEN 'risk' ELSE 'hidden' END FROM nr
  UNION ALL SELECT 'cycles', '¿Hay dependencias circulares?', 'No hay ciclos entre archivos de producción.', 'alta', 0, NULL, 'risk'
  UNION ALL SELECT 'generated', '¿Qué código es generado?', 'No se detectó código generado (marcas @generated, nombres .g.cs / .pb.go / .min.js…).', 'media', 0, NULL, 'risk,dead'
  UNION ALL SELECT 'dynamic', '¿Dónde falla el grafo por reflexión?', 'No se detectó reflexión ni carga dinámica de código.', 'alta', 0, NULL, 'impact,dead'
  UNION ALL SELECT 'recursion', '¿Qué funciones son recursivas?', 'No se detectó recursión dentro de un mismo archivo.', 'media', 0, NULL, 'cycles'
  UNION ALL SELECT 'since', '¿Qué cambió desde la última vez?', 'Aún no hay una vista anterior con la que comparar: esta visita queda guardada como referencia.', 'baja', 0, NULL, 'health'
  UNION ALL SELECT 'none?', '¿Cómo está el proyecto en general?', 'No hay índice de salud.', 'baja', 0, NULL, 'risk,hidden,dead'
  UNION ALL SELECT 'none', NULL, 'No entendí la pregunta. Prueba con una de estas:', 'baja', 0, NULL, 'risk,impact,hidden,dup,tests,owner,dead,cycles,generated,dynamic,recursion,since,health'),
qs AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' p' || (conv_id + 1) ELSE text END AS question FROM conversations),
qf AS (SELECT *, translate(lower(coalesce(question, '')), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy') AS t FROM qs),
nm AS (SELECT conv_id, turn, arg_min(w, (-length(w), w)) AS file FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(t, '[^a-z0-9]+')) AS w FROM qf) WHERE length(w) >= 3 AND w IN (SELECT id FROM parts) GROUP BY ALL),
it AS (SELECT qf.*, file, CASE {" ".join(f"WHEN regexp_matches(t, '{rx}') THEN '{name}'" for name, rx in text.INTENTS)} WHEN file IS NOT NULL THEN 'impact' ELSE 'none' END AS asked FROM qf LEFT JOIN nm USING (conv_id, turn))
SELECT it.conv_id, it.turn, it.file, CASE WHEN ans.intent LIKE 'none%' THEN 'none' ELSE ans.intent END AS intent,
  CASE WHEN asked = 'none' THEN coalesce(question, '') WHEN asked = 'impact' AND it.file IS NOT NULL THEN '¿Qué se rompe si cambio ' || it.file || '?' WHEN asked = 'owner' AND ow.id IS NOT NULL THEN '¿Quién conoce ' || it.file || '?' ELSE title END AS title,
  CASE WHEN asked = 'impact' AND it.file IS NOT NULL THEN it.file || ' afecta a ' || im.total || CASE WHEN im.total = 1 THEN ' archivo (' ELSE ' archivos (' END || least(im.total, 1) || ' directos, hasta ' || im.total || CASE WHEN im.total = 1 THEN ' nivel); ' ELSE ' niveles); ' END || im.total || ' de producción.'
    WHEN asked = 'owner' AND ow.id IS NOT NULL THEN ow.owner || ' concentra ' || CAST(floor(ow.owner_share * 100 + 0.5) AS INTEGER) || '% de los ' || ow.commits || ' commits; factor autobús ' || ow.bus || '.' ELSE headline END AS headline,
  CASE WHEN asked = 'owner' AND ow.id IS NOT NULL THEN CASE WHEN ow.commits >= 12 THEN 'alta' WHEN ow.commits >= 5 THEN 'media' ELSE 'baja' END ELSE level END AS level,
  CAST(CASE WHEN asked = 'impact' AND it.file IS NOT NULL THEN least(im.total, 12) WHEN asked = 'owner' AND ow.id IS NOT NULL THEN ow.authors ELSE n_rows END AS INTEGER) AS n_rows,
  CASE WHEN asked = 'impact' AND it.file IS NOT NULL THEN CASE WHEN im.total > 0 THEN 'depende directamente' END WHEN asked = 'owner' AND ow.id IS NOT NULL THEN ow.said ELSE first_row END AS first_row,
  CASE WHEN asked = 'owner' AND ow.id IS NOT NULL THEN 'risk' ELSE follow END AS follow
FROM it JOIN ans ON ans.intent = CASE asked WHEN 'dup' THEN 'none!' WHEN 'health' THEN 'none?' ELSE asked END LEFT JOIN im ON im.id = it.file LEFT JOIN ow ON ow.id = it.file AND asked = 'owner'
""")
def ask_conversations(spark: SparkSession, d: str) -> DataFrame:
    """What every turn of every conversation asks, answered; even turns name the part with their conversation's number."""
    talk = read(spark, d, "conversations")
    question = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" p"), (F.col("conv_id") + 1).cast("string"))).otherwise(F.col("text"))
    answered = ask.ask(talk.select("conv_id", "turn", question.alias("question")), facts_of(spark, d))
    return answered.select("conv_id", "turn", "file", "intent", "title", "headline", "level", F.size("rows").alias("n_rows"), F.get("rows", F.lit(0))["text"].alias("first_row"), F.array_join("follow", ",").alias("follow"))


@register("""WITH f AS (SELECT DISTINCT lower(p_brand) AS id, lower(p_brand) AS k FROM part), q AS (SELECT conv_id, turn, text, lower(text) AS t FROM conversations), n AS (SELECT lower(split_part(p_name, ' ', 1)) AS k, min(p_name) AS id FROM part GROUP BY 1)
SELECT conv_id, turn, (SELECT min(id) FROM n WHERE length(k) >= 3 AND regexp_matches(t, '(^|[^a-z0-9])' || k || '($|[^a-z0-9])') AND length(k) = (SELECT max(length(k)) FROM n m WHERE regexp_matches(t, '(^|[^a-z0-9])' || m.k || '($|[^a-z0-9])'))) AS file FROM q""")
def named_file(spark: SparkSession, d: str) -> DataFrame:
    """The part whose name's first word a turn of a conversation says."""
    first = read(spark, d, "part").groupBy(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("id")).agg(F.min("p_name").alias("p_name"))
    talk = read(spark, d, "conversations").select("conv_id", "turn", "text")
    named = answers.named_file(talk, "text", first.select("id"))
    return named.join(first.withColumnRenamed("id", "file"), "file", "left").select("conv_id", "turn", F.col("p_name").alias("file"))


ROUTES = "(VALUES ('a', 'GET', 'en/:p', 1), ('b', 'ANY', ':p/12', 2), ('c', 'GET', 'fr/:p', 3), ('d', 'POST', 'de/:p', 4), ('e', 'GET', '', 5)) v(target, offers, route, route_line)"
PATH = r"trim(lower(regexp_replace(regexp_replace(regexp_replace(url, '(?i)^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/+', '/', 'g')), '/')"


@register(f"""WITH r AS (SELECT *, string_split(route, '/') AS s FROM {ROUTES} WHERE route <> ''), c AS (SELECT CAST(page_id AS VARCHAR) AS source, 'GET' AS method, {PATH} AS path, 1 AS line FROM pages WHERE url IS NOT NULL), t AS (SELECT *, string_split(path, '/') AS t FROM c),
m AS (SELECT t.*, r.*, len(s) AS n FROM t JOIN r ON (offers = 'ANY' OR offers = method) AND ((len(t) = len(s) AND len(list_filter(range(1, len(s) + 1), lambda i: NOT (t[i] = s[i] OR s[i] = ':p' OR t[i] = ':p'))) = 0) OR (len(t) > len(s) AND len(s) >= 2 AND ends_with(path, '/' || route)))),
b AS (SELECT source, method, line, arg_min((target, route, route_line), (-n, target, route)) AS x FROM m GROUP BY ALL)
SELECT source, x[1] AS target, method, '/' || x[2] AS path, line, x[3] AS route_line FROM b""")
def bridge_calls(spark: SparkSession, d: str) -> DataFrame:
    """Pages as calls of five routes; equal lengths, parameters on either side, and routes that a longer path ends with."""
    offered = spark.createDataFrame([("a", "GET", "en/:p", 1), ("b", "ANY", ":p/12", 2), ("c", "GET", "fr/:p", 3), ("d", "POST", "de/:p", 4)], "id string, method string, path string, line int")
    path = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "(?i)^[a-z]+://[^/]+", ""), "[?#].*$", ""), "/+", "/"), "^/|/$", ""))
    made = read(spark, d, "pages").filter("url is not null").select(F.col("page_id").cast("string").alias("id"), F.lit("GET").alias("method"), path.alias("path"), F.lit(1).alias("line"))
    return http.bridges(offered, made)


@register(f"WITH {G}, t AS (SELECT DISTINCT src AS id FROM g WHERE right(src, 1) = '1') SELECT DISTINCT dst AS id, src AS test FROM g WHERE src IN (SELECT id FROM t)")
def tested_by(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("import").alias("kind"))
    return relations.tested_by(edges, edges.filter(F.col("source").endswith("1")).select(F.col("source").alias("id")).distinct())


@register(f"""WITH RECURSIVE {G}, v AS (SELECT src AS id FROM g UNION SELECT dst FROM g), t AS (SELECT id FROM v WHERE right(id, 1) = '1'), n AS (SELECT dst, count(*) AS n FROM g GROUP BY dst), x AS (SELECT arg_min(dst, (-n, dst)) AS of FROM n WHERE dst NOT IN (SELECT id FROM t)),
e AS (SELECT * FROM g WHERE src NOT IN (SELECT id FROM t)), r(node, depth) AS (SELECT of, 0 FROM x UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 26), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
SELECT g.src AS test, CASE least(2, min(depth)) WHEN 0 THEN 'prueba directa' WHEN 1 THEN 'prueba de quien depende' ELSE 'afectada indirectamente' END AS why, of FROM m JOIN g ON g.dst = m.node, x WHERE g.src IN (SELECT id FROM t) GROUP BY g.src, of""")
def tests_to_run(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(brand_graph(spark, d)).select("src", "dst")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    tests = nodes.filter(F.col("id").endswith("1"))
    tested = relations.tested_by(edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("import").alias("kind")), tests)
    inner = edges.join(tests.withColumnRenamed("id", "src"), "src", "left_anti")
    most = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).join(tests, "id", "left_anti")
    changed = most.agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("id"))
    return relations.impact_tests(graph.impact(inner, nodes), tested, changed).drop("via")


@register(f"WITH {G}, x AS (SELECT p_brand AS id, count(DISTINCT p_type) AS n FROM part GROUP BY 1) SELECT src AS source, dst AS target, n AS refs, CAST(1 AS BIGINT) AS used, exports, floor(1 / exports * 100 + 0.5) / 100 AS ratio FROM g JOIN (SELECT id, n AS exports FROM x) ON id = dst")
def edge_cardinality(spark: SparkSession, d: str) -> DataFrame:
    edges = brand_graph(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("import").alias("kind"), F.col("n").alias("refs"), F.array("dst").alias("symbols"))
    exports = read(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.count_distinct("p_type").alias("n"))
    return relations.cardinality(edges, exports).drop("kind", "symbols")


@register(f"WITH {G}, v AS (SELECT src AS id FROM g UNION SELECT dst FROM g), t AS (SELECT id FROM v WHERE right(id, 1) = '1'), f AS (SELECT src, min(dst) AS dst FROM g WHERE src IN (SELECT id FROM t) AND dst NOT IN (SELECT id FROM t) GROUP BY src) SELECT t.id, coalesce(right(f.dst, 1), '-1') AS community FROM t LEFT JOIN f ON f.src = t.id")
def module_of_test(spark: SparkSession, d: str) -> DataFrame:
    """The community of a brand is its last digit."""
    edges = brand_graph(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("import").alias("kind"))
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return relations.module_of_tests(edges, nodes.filter(F.col("id").endswith("1")), nodes.select(F.col("id").alias("node"), F.substring("id", -1, 1).alias("community")))


@register("SELECT lang, count(*) AS files FROM documents GROUP BY lang")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return relations.languages(read(spark, d, "documents"))


@register("SELECT user_id AS author, count(*) AS commits FROM events GROUP BY user_id")
def author_totals(spark: SparkSession, d: str) -> DataFrame:
    return relations.author_totals(read(spark, d, "events").withColumnRenamed("user_id", "author"), "author")


@register("""WITH e AS (SELECT user_id AS item, ts, max(ts) OVER () AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), b AS (SELECT item, floor((epoch_ms(now) - epoch_ms(ts)) / 86400000 / 30) AS age FROM e WHERE r <= 40)
SELECT item, CAST(11 - age AS INTEGER) AS bin, count(*) AS n FROM b WHERE age BETWEEN 0 AND 11 GROUP BY ALL""")
def month_spark(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return relations.months(events.select(F.col("user_id").alias("item"), "ts"), "item", "ts", now)


@register("""WITH o AS (SELECT c_custkey AS source, o_orderkey AS target FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0), v AS (SELECT DISTINCT o_orderkey AS source, o_orderkey + 1 AS target FROM orders)
SELECT source, target, 'relation' AS kind, 'manual' AS origin FROM v WHERE target IN (SELECT o_orderkey FROM orders)""")
def overrides(spark: SparkSession, d: str) -> DataFrame:
    """An edge from each order to the next number, where there is one."""
    nodes = read(spark, d, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    none = F.lit(None).cast("string")
    wanted = nodes.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), none.alias("kind"), none.alias("origin"))
    edges = spark.createDataFrame([], "source long, target long, kind string, origin string")
    return relations.overridden(edges, nodes, wanted)[0]


@register("""WITH f AS (SELECT 'd/' || n_name || '.x' AS id FROM nation UNION ALL SELECT 'e/' || n_name || '.y' FROM nation WHERE n_nationkey < 3), d AS (SELECT 'd/' || n_name || '.x' AS id, n_regionkey AS line, lower(r_name) AS target FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'd/' || a.n_name || '.x', a.n_nationkey, lower(b.n_name) FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 UNION ALL SELECT 'd/' || b.n_name || '.x', b.n_nationkey, lower(a.n_name) FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1),
s AS (SELECT lower(regexp_replace(split_part(id, '/', 2), '[.][^.]+$', '')) AS stem, min(id) AS t, count(*) AS n FROM f GROUP BY 1), m AS (SELECT d.id, d.line, s.t FROM d JOIN s ON s.stem = d.target AND s.n = 1 WHERE s.t <> d.id)
SELECT least(id, t) AS source, greatest(id, t) AS target, count(DISTINCT id) > 1 AS "both" FROM m GROUP BY ALL""")
def declared_relations(spark: SparkSession, d: str) -> DataFrame:
    """Nations declare relations to their neighbours by number, by stem; three stems are ambiguous."""
    nation = read(spark, d, "nation")
    file = lambda c: F.concat(F.lit("d/"), F.col(c), F.lit(".x"))
    files = nation.select(file("n_name").alias("id")).union(nation.filter("n_nationkey < 3").select(F.concat(F.lit("e/"), "n_name", F.lit(".y"))))
    to_region = nation.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(file("n_name").alias("id"), F.col("n_regionkey").alias("line"), F.lower("r_name").alias("target"))
    a, b = nation.select(F.col("n_name").alias("a"), (F.col("n_nationkey") + 1).alias("k")), nation.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("k"))
    near = a.join(b, "k")
    both = near.select(file("a").alias("id"), F.col("k").alias("line"), F.lower("b").alias("target")).union(near.select(file("b"), "k", F.lower("a")))
    asked = to_region.union(both).select("*", F.lit("1:N").alias("card"), F.lit("").alias("label"))
    kept = signals.relations(asked, files)[0]
    return kept.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "both")


@register("""WITH u AS (SELECT doc_id, source AS file, sha256(coalesce(text, '')) AS h, length(text) AS loc FROM documents), g AS (SELECT h, min(doc_id) AS grp FROM u GROUP BY h HAVING count(*) > 1)
SELECT grp AS "group", 'exacto' AS type, 1.0::DOUBLE AS sim, CAST(floor(avg(loc) + 0.5) AS BIGINT) AS lines, count(*) AS copies, count(DISTINCT file) AS files, count(DISTINCT file) = 1 AS same_file FROM u JOIN g USING (h) GROUP BY grp""")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("unit"), F.col("source").alias("file"), F.length("text").alias("loc"), "lang", "text")
    grouped = clones.exact_groups(docs, "unit", "text").select("unit", F.col("first").alias("group"), "digest")
    members = grouped.join(docs, "unit").select("group", "unit", F.col("lang").alias("name"), "file", "loc", F.col("loc").alias("len"), F.lit(False).alias("test"), F.col("digest").alias("hash"), F.col("digest").alias("raw_hash"))
    none = spark.createDataFrame([], "a long, b long, sim double")
    return clones.summary(members, none, grouped.select("unit", F.col("group").alias("rep"))).select("group", "type", "sim", "lines", "copies", "files", "same_file")


@register("""WITH t AS (SELECT DISTINCT l_orderkey AS tx, l_partkey AS item FROM lineitem), p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM t x JOIN t y ON x.tx = y.tx AND x.item < y.item GROUP BY ALL), c AS (SELECT item, count(*) AS n FROM t GROUP BY item),
m AS (SELECT x.p_name AS grp, p.n, floor(p.n / least(ca.n, cb.n) * 100 + 0.5) / 100 AS r FROM p JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b AND x.p_name = y.p_name JOIN c ca ON ca.item = a JOIN c cb ON cb.item = b)
SELECT grp AS "group", max((r, n))[1] AS co_rate, max((r, n))[2] AS co_count FROM m GROUP BY grp""")
def clone_co_rate(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one name are copies of each other; how often two of them are ordered together."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("file"))
    members = read(spark, d, "part").select(F.col("p_name").alias("group"), F.col("p_partkey").alias("file"))
    together = cochange.pair_counts(lines, "tx", "file", most=1_000_000, groups=members.withColumnRenamed("file", "item"))
    return clones.co_rate(members, together, cochange.item_counts(lines, "tx", "file").withColumnRenamed("item", "file").withColumnRenamed("n", "commits"))


@register("""WITH m AS (SELECT s_nationkey AS grp, 'src/r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey || '.mjs' AS file, 'r' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey), g AS (SELECT grp, min(file) AS first FROM m GROUP BY grp)
SELECT grp AS "group", regexp_replace(first, '/[^/]*$', '') AS dir, regexp_replace(first, '/[^/]*$', '') || '/f' || grp || '.mjs' AS file, CAST([] AS VARCHAR[]) AS warn FROM g""")
def extraction(spark: SparkSession, d: str) -> DataFrame:
    """A nation's suppliers are copies in one folder, which is where they would be put once."""
    joined = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    file = F.concat(F.lit("src/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".mjs"))
    members = joined.select(F.col("s_nationkey").alias("group"), file.alias("file"))
    groups = members.select("group").distinct().withColumn("name", F.concat(F.lit("f"), F.col("group").cast("string")))
    folders = members.select(F.regexp_replace("file", "/[^/]*$", "").alias("dir")).distinct()
    return clones.suggestion(groups, members, spark.createDataFrame([], "from string, to string"), folders)


@register("""WITH l AS (SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1), c AS (SELECT p_type AS value, min((p_brand, CAST(p_size AS BIGINT), p_name)) AS e FROM part WHERE p_size < 10 GROUP BY 1) SELECT value, count, e[1] AS file, e[2] AS line, e[3] AS name FROM l LEFT JOIN c USING (value)""")
def named_constants(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    literals = part.groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("count"))
    constants = part.filter("p_size < 10").select(F.col("p_type").alias("value"), F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("line"), F.col("p_name").alias("name"))
    return clones.named_constant(literals, constants, "value").select("value", "count", "existing.file", "existing.line", "existing.name")


@register(f"""WITH {FILES}, p AS (SELECT id, score, CASE WHEN fan_in = 0 THEN 'orphan' ELSE 'module' END AS role, fan_in, coverage, in_cycle FROM r)
SELECT id, 'sin pruebas' AS kind, CAST(NULL AS VARCHAR) AS other FROM p WHERE coverage = 'ninguna' AND fan_in >= 1 UNION ALL SELECT id, 'reflexión', NULL FROM p WHERE id % 3 = 0""")
def change_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What to know before any part is changed."""
    none = F.lit(None).cast("string")
    files = files_of(spark, d).withColumns({"state": none, "owner": none, "gen": none, "aux": F.lit(False), "dynamic": F.col("id") % 3 == 0})
    impacts = spark.createDataFrame([], "node long, total long, direct long, depth int, capped boolean, ids array<long>")
    return guard.warnings(guard.facts(files, impacts, files.select("id")))


@register("""WITH b AS (SELECT c_nationkey AS g, c_mktsegment AS n, c_custkey AS f FROM customer WHERE c_acctbal > 9000), a AS (SELECT c_nationkey AS g, c_mktsegment AS n, c_custkey AS f FROM customer WHERE c_acctbal > 8900),
x AS (SELECT g, n, string_agg(CAST(f AS VARCHAR), ',' ORDER BY CAST(f AS VARCHAR)) AS s FROM b GROUP BY ALL), y AS (SELECT g, n, string_agg(CAST(f AS VARCHAR), ',' ORDER BY CAST(f AS VARCHAR)) AS s FROM a GROUP BY ALL)
SELECT 'duplicación nueva' AS rule, count(*) AS n FROM y WHERE n || '|' || s NOT IN (SELECT n || '|' || s FROM x) AND EXISTS (SELECT 1 FROM a WHERE a.g = y.g AND a.n = y.n AND a.f NOT IN (SELECT f FROM b)) UNION ALL SELECT 'resuelto', count(*) FROM x WHERE n || '|' || s NOT IN (SELECT n || '|' || s FROM y)""")
def guard_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Groups of rich customers before and after the bar is lowered: which are new, and which are gone."""
    rich = lambda bar: read(spark, d, "customer").filter(F.col("c_acctbal") > bar)
    group = lambda c: c.select(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("group"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").cast("string").alias("file"))
    prints = lambda c: c.select(F.col("c_custkey").cast("string").alias("id"), F.lit(0).alias("risk"), F.lit(0).alias("fan_in"), F.lit(True).alias("covered"), F.lit(False).alias("dynamic"), F.lit(1).alias("loc"), F.lit(False).alias("skipped"), F.lit(False).alias("test"))
    before, after = rich(9000), rich(8900)
    signed = [guard.signatures(groups=group(c), like=c) for c in (before, after)]
    told = guard.compare(prints(before), prints(after), *signed)
    rules = ("duplicación nueva", "resuelto")
    counts = told.agg(*[F.count_if(F.col("rule") == r).alias(r) for r in rules])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("n")) for r in rules])).alias("x")).select("x.*")


@register("""WITH a AS (SELECT l_partkey AS s, l_suppkey AS t FROM lineitem), k AS (SELECT DISTINCT ps AS lo, pt AS hi FROM (SELECT least(o_orderkey % 50 + 1, o_custkey) AS ps, greatest(o_orderkey % 50 + 1, o_custkey) AS pt FROM orders)),
r AS (SELECT DISTINCT least(s, t) AS lo, greatest(s, t) AS hi, s, t FROM a WHERE s <> t AND s IN (SELECT s_suppkey FROM supplier)), f AS (SELECT lo, hi, min((s, t)) AS x FROM r WHERE (lo, hi) NOT IN (SELECT (lo, hi) FROM k) GROUP BY ALL)
SELECT x[1] AS source, x[2] AS target, '1:N' AS card, 'usa' AS label FROM f""")
def accepted_relations(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers as proposed relations between suppliers' numbers; orders tell which are known already."""
    wanted = read(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("1:N").alias("card"), F.lit("usa").alias("label"))
    known = read(spark, d, "orders").select((F.col("o_orderkey") % 50 + 1).alias("source"), F.col("o_custkey").alias("target"))
    return store.suggested(wanted, read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), known)


@register("SELECT p_brand AS id, '- ' || p_brand || ' [module] exports: ' || string_agg(DISTINCT p_type, ', ' ORDER BY p_type) || chr(10) || '    sale: —' AS text FROM part GROUP BY p_brand")
def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    files = part.select(F.col("p_brand").alias("id"), F.lit("module").alias("role"), F.lit("").alias("summary")).distinct()
    edges = spark.createDataFrame([], "source string, target string, kind string")
    return store.prompt(files, edges, part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("name")))
