"""Queries of clones, literals and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clones, graph, measures
from ..session import cut
from .common import Registry, read

register = Registry()


@register("""WITH g AS (SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT doc_id AS unit, digest, copies, first FROM documents JOIN g ON sha256(coalesce(text, '')) = digest""")
def exact_clones(spark: SparkSession, d: str) -> DataFrame:
    return clones.exact_groups(read(spark, d, "documents"), "doc_id", "text")


NEAR = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n]+'), lambda x: x <> '') AS t FROM documents),
t AS (SELECT min(doc_id) AS unit, t FROM w WHERE t IS NOT NULL GROUP BY t),
g AS (SELECT DISTINCT unit, array_to_string(t[i:i + 4], ' ') AS shingle FROM (SELECT unit, t, unnest(range(1, len(t) - 3)) AS i FROM t WHERE len(t) >= 5)),
n AS (SELECT count(DISTINCT unit) AS units FROM g),
f AS (SELECT shingle FROM g, n GROUP BY shingle HAVING count(*) <= greatest(8, ceil(any_value(units) * 0.2))),
r AS (SELECT g.* FROM g JOIN f USING (shingle)), k AS (SELECT unit, count(*) AS n FROM r GROUP BY unit HAVING count(*) >= 10),
b AS (SELECT x.unit AS a, y.unit AS b, count(*) AS met FROM r x JOIN r y ON x.shingle = y.shingle AND x.unit < y.unit WHERE x.unit IN (SELECT unit FROM k) AND y.unit IN (SELECT unit FROM k) GROUP BY ALL),
q AS MATERIALIZED (SELECT a, b, round(met / (ka.n + kb.n - met), 4) AS sim FROM b JOIN k ka ON ka.unit = a JOIN k kb ON kb.unit = b WHERE met >= 0.5 * least(ka.n, kb.n) AND met / (ka.n + kb.n - met) >= 0.8)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the same words are one, the smallest; each text is read and split once."""
    sets = cut(clones.shingle_sets(read(spark, d, "documents"), "doc_id", F.lower("text")))
    first = sets.groupBy("digest").agg(F.min("unit").alias("rep"), F.count("*").alias("k")).filter("k > 1")
    copies = cut(sets.select("unit", "digest").join(first, "digest").filter("unit <> rep").select("unit"))
    return clones.near_sets(sets.drop("digest").join(copies, "unit", "left_anti"))


@register(f"WITH {NEAR} SELECT * FROM q")
def near_clones(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).withColumn("sim", F.round("sim", 4))


@register(f"""WITH RECURSIVE {NEAR}, e AS (SELECT a, b FROM q UNION SELECT b, a FROM q), c(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.node)
SELECT node, min(label) AS component FROM c GROUP BY node""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_near(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")))


@register(f"""WITH {NEAR}, p AS (SELECT a, b FROM q ORDER BY a, b LIMIT 1),
ll AS (SELECT DISTINCT trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ') AS line FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents, p WHERE doc_id = a)),
rr AS (SELECT DISTINCT trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ') AS line FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents, p WHERE doc_id = b))
SELECT 'left' AS side, line FROM ll WHERE line <> '' AND line NOT IN (SELECT line FROM rr) UNION ALL SELECT 'right', line FROM rr WHERE line <> '' AND line NOT IN (SELECT line FROM ll)""")
def line_diff(spark: SparkSession, d: str) -> DataFrame:
    pair = _near(spark, d).orderBy("a", "b").limit(1)
    docs = read(spark, d, "documents")
    side = lambda x: docs.join(pair.select(F.col(x).alias("doc_id")), "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
    return clones.line_differences(side("a"), side("b"), "line")


@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents), p AS (SELECT value, doc_id, count(*) AS n FROM l WHERE length(value) >= 4 GROUP BY ALL)
SELECT value, CAST(sum(n) AS BIGINT) AS count, count(*) AS files, list_sort(list(doc_id))[1:12] AS sample, CASE WHEN count(*) >= 3 AND sum(n) >= 4 THEN 'media' ELSE 'info' END AS sev FROM p GROUP BY value HAVING sum(n) >= 3 AND count(*) >= 2""")
def magic_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value")).filter(F.length("value") >= 4)
    return clones.repeated_literals(lines, "value", "doc_id")


@register("""WITH n AS (SELECT DISTINCT page_id AS owner, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name FROM pages), g AS (SELECT name, count(*) AS files FROM n WHERE length(name) >= 5 GROUP BY name HAVING count(*) >= 2) SELECT name, owner, files FROM n JOIN g USING (name)""")
def homonyms(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"))
    return clones.homonyms(names, "name", "page_id")


@register(f"""WITH {NEAR}, s AS (SELECT a, b, sim, x.source = y.source AS same, len(string_split(x.text, chr(10))) AS lines FROM q JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b)
SELECT a, b, CAST(least(100, floor(8 * sqrt(lines * 1) * 1 * (CASE WHEN same THEN 1.0::DOUBLE ELSE 1.25 END) * (CASE WHEN same THEN 0.7::DOUBLE ELSE 1 END) + 0.5)) AS INTEGER) AS score FROM s""")
def dup_cost(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", F.size(F.split("text", "\n")).alias("lines"))
    a, b = docs.select(F.col("doc_id").alias("a"), F.col("source").alias("sa"), "lines"), docs.select(F.col("doc_id").alias("b"), F.col("source").alias("sb"))
    both = _near(spark, d).join(a, "a").join(b, "b")
    sources = F.when(F.col("sa") == F.col("sb"), 1).otherwise(2)
    return both.select("a", "b", clones.cost(F.col("lines"), F.lit(2), F.lit(0.0), sources, F.lit(False), sources).alias("score"))


@register(r"""SELECT doc_id, CASE WHEN regexp_matches(array_to_string(string_split(text, chr(10))[1:25], chr(10)), '(?i)@generated|DO NOT EDIT|<auto-generated|auto-?generated|code generated by|generated by (?:the )?\w+|this file (?:is|was) (?:auto)?-?generated|archivo generado') THEN 'marca'
WHEN len(string_split(text, chr(10))) <= 3 AND length(text) > 3000 THEN 'minificado' END AS reason FROM documents""")
def generated_marker(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.generated(F.lit("-"), F.col("text")).alias("reason"))


#: Patterns by language, in the order in which they are tried.
USES = (("en", 1, "token", "secreto"), ("en", 2, "License|Copyright", "licencia"), ("en", 3, "https?://", "enlace"), ("fr", 1, "token", "secreto"), ("de", 1, "token", "secreto"), ("es", 1, "token", "secreto"), ("es", 2, r"\+[0-9]", "teléfono"))


@register("""WITH u(lang, place, rx, what) AS (VALUES ('en', 1, 'token', 'secreto'), ('en', 2, 'License|Copyright', 'licencia'), ('en', 3, 'https?://', 'enlace'), ('fr', 1, 'token', 'secreto'), ('de', 1, 'token', 'secreto'), ('es', 1, 'token', 'secreto'), ('es', 2, '\\+[0-9]', 'teléfono')),
s AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, lang, unnest(l) AS x, generate_subscripts(l, 1) AS line FROM s),
m AS (SELECT doc_id, line, arg_min(what, place) AS what FROM n JOIN u ON n.lang = u.lang AND regexp_matches(x, replace(rx, '\\\\', '\\')) GROUP BY ALL)
SELECT doc_id, CAST(line AS INTEGER) AS line, what FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM m) WHERE r <= 12""".replace("'\\\\+[0-9]'", "'\\+[0-9]'").replace("replace(rx, '\\\\\\\\', '\\\\')", "rx").replace("replace(rx, '\\\\', '\\')", "rx"))
def dynamic_use(spark: SparkSession, d: str) -> DataFrame:
    what = {}
    for lang, _, rx, name in USES:
        hit = F.col("x").rlike(rx)
        what[lang] = F.when(hit, name) if lang not in what else what[lang].when(hit, name)
    lines = read(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("p", "x"))
    found = lines.withColumn("what", F.coalesce(*[F.when(F.col("lang") == k, c) for k, c in what.items()])).filter("what is not null")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("p"))
    return found.withColumn("r", place).filter("r <= 12").select("doc_id", (F.col("p") + 1).alias("line"), "what")


@register("""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') AS path FROM pages), h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n, bool_or(href IN (SELECT path FROM u)) AS resolved FROM h GROUP BY ALL""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    paths = pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[?#].*$", "").alias("href")).distinct().withColumn("known", F.lit(True))
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))
    return links.join(paths, "href", "left").select("page_id", "href", "n", F.col("known").isNotNull().alias("resolved"))


URL = r"""trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)^[a-z]+://[^/]+', ''), '[?#].*$', ''), '\$\{[^}]*\}|\{[^}]*\}|<[^>]*>|:\w+|\[[^\]]*\]', ':p', 'g'), '/+', '/', 'g')), '/')"""


@register("SELECT page_id, " + URL.replace("{x}", "url") + " AS path FROM pages")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.normal_url(F.col("url")).alias("path"))


ROUTES = ("/en/:id", "/de/:id", "/fr/{id}", "/fr/12", "/es/<id>/edit")


@register("WITH r AS (SELECT route, string_split(" + URL.replace("{x}", "route") + ", '/') AS s FROM (VALUES ('/en/:id'), ('/de/:id'), ('/fr/{id}'), ('/fr/12'), ('/es/<id>/edit')) v(route)), p AS (SELECT page_id, string_split(" + URL.replace("{x}", "url") + """, '/') AS s FROM pages)
SELECT page_id, min(route) AS route FROM p JOIN r ON len(p.s) = len(r.s) AND len(list_filter(range(1, len(p.s) + 1), lambda i: NOT (p.s[i] = r.s[i] OR r.s[i] = ':p' OR p.s[i] = ':p'))) = 0 GROUP BY page_id""")
def bridge_match(spark: SparkSession, d: str) -> DataFrame:
    routes = spark.createDataFrame([(r,) for r in ROUTES], "route string").withColumn("s", F.split(text.normal_url(F.col("route")), "/")).withColumn("n", F.size("s"))
    pages = read(spark, d, "pages").select("page_id", F.split(text.normal_url(F.col("url")), "/").alias("t")).withColumn("n", F.size("t"))
    met = pages.join(F.broadcast(routes), "n").filter(text.same_route(F.col("t"), F.col("s")))
    return met.groupBy("page_id").agg(F.min("route").alias("route"))


NOTES = ("@set pagos @set pagos @set caja", "@rel Product N:M contiene líneas", "nothing here", "@set x y @rel user N:1")


@register("""WITH c AS (SELECT * FROM (VALUES (0, '@set pagos @set pagos @set caja'), (1, '@rel Product N:M contiene líneas'), (2, 'nothing here'), (3, '@set x y @rel user N:1')) v(i, note))
SELECT i, note, array_to_string(list_sort(list_distinct(regexp_extract_all(note, '@set +([a-zA-Z0-9_-]+)', 1))), ',') AS tags, regexp_extract(note, '@rel +([^ ]+) +([1N]:[1NM])', 1) AS rel, regexp_extract(note, '@rel +([^ ]+) +([1N]:[1NM])', 2) AS card FROM c""")
def tags_annotations(spark: SparkSession, d: str) -> DataFrame:
    notes = spark.createDataFrame(list(enumerate(NOTES)), "i int, note string")
    rel = "@rel +([^ ]+) +([1N]:[1NM])"
    tags = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("note", F.lit("@set +([a-zA-Z0-9_-]+)"), 1))), ",")
    return notes.select("i", "note", tags.alias("tags"), F.regexp_extract("note", rel, 1).alias("rel"), F.regexp_extract("note", rel, 2).alias("card"))


@register("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]+) the', 1)) AS member FROM documents) SELECT doc_id, member, count(*) AS count FROM w GROUP BY ALL""")
def namespace_members(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+) the"), 1)).alias("member"))
    return found.groupBy("doc_id", "member").agg(F.count("*").alias("count"))


@register("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, unnest(l) AS x, CAST(generate_subscripts(l, 1) AS INTEGER) AS line FROM s)
SELECT doc_id, line, CAST(instr(lower(x), 'license') - 1 AS INTEGER) AS col, substr(trim(x, ' '), 1, 160) AS text FROM n WHERE instr(lower(x), 'license') > 0 ORDER BY doc_id, line LIMIT 120""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x"))
    at = F.instr(F.lower("x"), "license")
    return lines.filter(at > 0).orderBy("doc_id", "p").limit(120).select("doc_id", (F.col("p") + 1).alias("line"), (at - 1).alias("col"), F.substring(F.trim("x"), 1, 160).alias("text"))


@register("""WITH RECURSIVE q AS (SELECT DISTINCT lower(substr(p_type, 1, 1) || substr(p_name, 1, 1) || right(p_name, 1)) AS q FROM part), n AS (SELECT DISTINCT p_brand || '/' || p_name AS s FROM part),
w AS (SELECT q, s, lower(s) AS t FROM q, n),
r(q, s, t, i, qi, score, last, hit) AS (SELECT q, s, t, 0, 0, 0, -2, '' FROM w UNION ALL
  SELECT q, s, t, i + 1, CASE WHEN m THEN qi + 1 ELSE qi END, CASE WHEN m THEN score + CASE WHEN i = last + 1 THEN 3 ELSE 1 END + CASE WHEN i = 0 OR t[i] IN ('/', '.', '_', '-') THEN 2 ELSE 0 END ELSE score END, CASE WHEN m THEN i ELSE last END, CASE WHEN m THEN hit || i || ',' ELSE hit END
  FROM (SELECT *, qi < length(q) AND t[i + 1] = q[qi + 1] AS m FROM r WHERE i < length(t)) x),
f AS (SELECT q, s, hit, score + CASE WHEN contains(string_split(t, '/')[-1], q) THEN 8 ELSE 0 END - length(t) * 0.02::DOUBLE AS score FROM r WHERE i = length(t) AND qi = length(q))
SELECT q, s AS name, round(score, 6) AS score, hit, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, s) AS INTEGER) AS place FROM f QUALIFY place <= 7""")
def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The seven names that fit each typed query best; queries are letters of a part's type and name."""
    part = read(spark, d, "part")
    # types and names are few words: there are no more queries than those have letters
    letter = lambda c, at: F.substring(c, at, 1)
    typed = part.select(F.lower(F.concat(letter("p_type", 1), letter("p_name", 1), letter("p_name", -1))).alias("q")).distinct()
    names = part.select(F.concat_ws("/", "p_brand", "p_name").alias("name")).distinct()
    met = names.crossJoin(F.broadcast(typed)).withColumn("f", text.fuzzy(F.col("q"), F.col("name"))).filter("f is not null")
    scored = met.select("q", "name", F.round("f.score", 6).alias("score"), F.array_join(F.transform("f.hit", lambda i: F.concat(i.cast("string"), F.lit(","))), "").alias("hit"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "name"))
    return scored.withColumn("place", place).filter("place <= 7")


@register("""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS s FROM pages), x AS (SELECT DISTINCT array_to_string(s[1:2], '/') AS prefix FROM p WHERE page_id % 2 = 0 UNION SELECT s[1] FROM p WHERE page_id % 3 = 0)
SELECT page_id, array_to_string(s, '/') AS path, arg_max(prefix, length(prefix)) AS prefix FROM p LEFT JOIN x ON array_to_string(s, '/') = prefix OR starts_with(array_to_string(s, '/'), prefix || '/') GROUP BY ALL""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pages = read(spark, d, "pages").select("page_id", path.alias("path"))
    parts = F.split("path", "/")
    upper = pages.filter("page_id % 2 = 0").select(F.array_join(F.slice(parts, 1, 2), "/").alias("prefix")).union(pages.filter("page_id % 3 = 0").select(F.element_at(parts, 1).alias("prefix")))
    return measures.longest_prefix(pages, "path", upper, "prefix")


@register("""WITH c AS (SELECT p_partkey AS k, unnest([p_partkey * 7 % 211, p_partkey * 5 % 97, p_partkey]) AS target, unnest([0, 1, 2]) AS place FROM part)
SELECT k, arg_min(target, place) AS target FROM c WHERE target IN (SELECT s_suppkey FROM supplier) GROUP BY k""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    keys = read(spark, d, "part").select(F.col("p_partkey").alias("k"))
    candidates = keys.select("k", F.posexplode(F.array(k * 7 % 211, k * 5 % 97, k)).alias("place", "target"))
    return measures.first_match(candidates, ["k"], "place", read(spark, d, "supplier").select(F.col("s_suppkey").alias("target")), "target")
