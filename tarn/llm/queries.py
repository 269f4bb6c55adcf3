"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language, line_dedup, packing, periods, quality, repeats, sentencepieces, sharding, simhash, url_filter, whitening
from .shared import read

from .url_filter import Rule

BYTES = os.environ.get("BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
PIECES = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


#: Rules of op7_url_filters.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = language.fit(docs.filter(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_spread_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = sentencepieces.Pieces.load(PIECES)
    back = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    digest = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 24, seed=10)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with op12's periods: where crc32(doc_id) ends in 0, the words from a on repeat the first p of them."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.filter(F.split(F.translate("text", "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n)
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    part = F.slice(words, (a + 1).cast("int"), p)
    again = F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int")))
    planted = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1), n)
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(F.col("text")))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(with_periods(read(spark, sf_dir, "documents").select("doc_id", "text")))
    first = lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when((x["start"] < y["start"]) | (x["start"] == y["start"]) & (x["period"] < y["period"]), -1).otherwise(1)
    longest = F.get(F.array_sort("runs", first), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        longest["length"].alias("length"),
        longest["period"].alias("period"),
        F.floor(1000 * longest["length"] / longest["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(read(spark, sf_dir, "documents"), BYTES)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_sentencepieces": op5_sentencepieces,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_periods": op12_periods,
    "op13_packing": op13_packing,
}

_ROUNDS = ",\n".join(
    f"""r{i} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
  SELECT kind, host, weight * (1 - 0.85) AS rank FROM seeds UNION ALL
  SELECT e.kind, e.dst, r.rank * e.share * 0.85 FROM {f'r{i - 1}' if i else '(SELECT kind, host, weight * (1 - 0.85) AS rank FROM seeds)'} r JOIN edges e ON e.kind = r.kind AND e.host = r.host) GROUP BY ALL)"""
    for i in range(20)
)

ORACLES = {
    "op1_suffix_array": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)),
late AS (SELECT p.doc_id, p.i, lag(p.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS before FROM p JOIN m USING (s) WHERE p.doc_id > m.least),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM late) GROUP BY doc_id, g),
per AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
edges AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(d.n) FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT e.doc_id, string_agg(substr(d.h, 2 * e.a + 1, 2 * (e.b - e.a)), '' ORDER BY e.a) AS h FROM edges e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN per USING (doc_id)
""",
    "op3_line_dedup": r"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
spread AS (SELECT line FROM lines WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s.line) AS n_removed, sha256(coalesce(string_agg(lines.line, chr(10) ORDER BY i) FILTER (s.line IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN spread s USING (line) GROUP BY doc_id
""",
    "op7_url_filters": r"""
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS weight FROM (SELECT CASE rv WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM p JOIN fit USING (page_id) GROUP BY ALL)),
refs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["''](?:[a-z][a-z0-9+.-]*:)?//([^"''/?#]*)', 1)) AS dst FROM p),
links AS (SELECT DISTINCT src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM refs),
ways AS (SELECT 'trust' AS kind, src AS host, dst FROM links WHERE src <> dst AND src <> '' AND dst <> '' UNION ALL SELECT 'distrust', dst, src FROM links WHERE src <> dst AND src <> '' AND dst <> ''),
edges AS MATERIALIZED (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind, host) AS share FROM ways),
""" + _ROUNDS + r""",
h AS (SELECT host, sum(CASE kind WHEN 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN rank ELSE 0 END) AS distrust FROM r19 GROUP BY host)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.rv, CASE WHEN h.distrust > 0.5 * (h.trust + h.distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN h ON h.host = p.host
""",
    "op6_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
""",
    "op12_periods": r"""
WITH t AS (SELECT doc_id, encode(CAST(doc_id AS VARCHAR)) AS b, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda k: ascii(CAST(doc_id AS VARCHAR)[k + 1])::BIGINT)),
  lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)::BIGINT[]), lambda z, k: xor(z >> 1, 3988292384::BIGINT * (z & 1)))), 4294967295::BIGINT) AS h FROM t),
g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
six AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM d)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS a, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS MATERIALIZED (SELECT doc_id, a AS start, e - a AS length, min(q) AS period FROM islands WHERE e - a >= greatest(12, 2 * q) GROUP BY doc_id, a, e),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT doc_id, count(*) AS n_runs, arg_max((start, length, period), (length, -start, -period)) AS r, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r[1] AS start, r[2] AS length, r[3] AS period, 1000 * r[2] // r[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_.s, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN left_ USING (doc_id)
""",
    "op8_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
