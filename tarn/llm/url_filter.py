"""Judging URLs by rules, and the rest by trust and distrust that links carry between hosts.

DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

DAMPING = 0.85
#: Share of its own rank by which no host's still moves at the end.
SETTLED = 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """What holds for a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased, and from there up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each of ``hosts`` (host) that any rule fits, those rules, longest first."""
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    if not labels:
        return hosts.select("host", F.lit(None).cast("array<struct<length: int, rule: string, path: string, verdict: string>>").alias("rules")).limit(0)
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    named = F.concat("rule_host", "rule_path")
    one = F.struct(F.length(named).alias("length"), named.alias("rule"), F.col("rule_path").alias("path"), "verdict")
    met = hosts.filter("host <> ''").select("host", F.explode(ends).alias("rule_host")).join(rules, "rule_host")
    return met.groupBy("host").agg(F.sort_array(F.collect_list(one), asc=False).alias("rules"))


def host_links(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """(src, dst): distinct links between two hosts, from each page's ``href``, quoted or not; ``pages`` has ``host``.

    A link with a scheme or ``//`` goes to the host it names, any other stays on its own and is none.
    """
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'/?#\s>]*)"), 1)))
    named = pages.select(F.col("host").alias("src"), target.alias("target"))
    dst = F.translate(F.substr("target", F.instr("target", "//") + 2), _UPPER, _LOWER)
    return named.select("src", dst.alias("dst")).filter("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(links: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind from its ``seeds`` (kind, host, weight).

    Kind ``trust`` goes along the links (src, dst), each host's share dealt evenly over its targets;
    kind ``distrust`` goes against them, so who links to a blocked host shares its blame.  rank =
    (1 - damping) * weight + damping * what neighbours pass on; what a host without targets has stays
    there.  Ends when no rank moves by ``settled`` of itself, so a host that is reached last counts like
    any other and the number of hosts doesn't matter; what a round adds shrinks with ``damping``.
    """
    ahead = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"))
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"))
    both = table(ahead.union(back), "links")
    degree = both.groupBy("kind", "host").agg((F.lit(1.0) / F.count("*")).alias("share"))
    edges = table(both.join(degree, ["kind", "host"]), "edges")
    base = seeds.select("kind", "host", (F.col("weight") * (1 - damping)).alias("rank"))
    ranks = base = table(base, "seeds")
    while True:
        passed = ranks.join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        now = table(base.union(passed).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
        moved = now.join(ranks.withColumnRenamed("rank", "old"), ["kind", "host"], "left").agg(F.max(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))) / F.col("rank"))).first()[0]
        ranks = now
        if not moved or moved < settled:
            return ranks


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_distrust: float = 0.5) -> DataFrame:
    """A verdict for each row of ``pages``: id_col, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides.  Where none does, the host does: its trust and distrust are
    propagated from all hosts in proportion to their pages that rules allow and block; a share of
    distrust in both over ``most_distrust`` blocks, and a host that neither reaches is allowed.  Equal
    rules are taken once; of two of a length, the greater string's.  A null URL, or one without
    ``://``, has an empty host and path, which no rule fits and no link reaches.  Null HTML has no
    links.  Rows that repeat are judged alike; other columns aren't read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, verdict string")
    host, path = url_parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    fitting = table(host_rules(split.select("host").distinct(), rules.distinct()), "host_rules")
    own = split.select("id", "host", "path").join(fitting, "host", "left")
    fit = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    ruled = table(own.withColumn("fit", fit).select("id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict")), "ruled")
    counted = ruled.filter("verdict is not null").groupBy(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    totals = counted.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counted.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("weight"))
    ranks = propagate(host_links(split), seeds)
    by_host = ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    told = ruled.join(table(by_host, "by_host"), "host", "left").na.fill(0.0, ["trust", "distrust"])
    blocked = F.col("distrust") > most_distrust * (F.col("trust") + F.col("distrust"))
    return told.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
