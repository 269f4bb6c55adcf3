"""HTTP bridges: routes that servers offer, calls that clients make, and which meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_lines, normal_url, same_route

#: HTTP methods, and the patterns of routes and calls: pattern, groups of the method (the first that says one) or the method, group of the path.
METHODS = "get|post|put|delete|patch"
ROUTES = (
    (rf"(?i)\b(?:app|router|server|api)\.({METHODS})\(\s*['\"`]([^'\"`]+)", 1, 2),
    (rf"(?i)@\w+\.(route|{METHODS})\(\s*['\"]([^'\"]+)['\"](?:[^)]*methods=\[['\"](\w+))?", (3, 1), 2),
    (r"\bMap(Get|Post|Put|Delete|Patch)\(\s*\"([^\"]+)\"", 1, 2),
    (r"@(Get|Post|Put|Delete|Patch)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]+)\"", 1, 2),
    (r"\b(?:HandleFunc|Handle)\(\s*\"(?:[A-Z]+\s+)?([^\"]+)\"", "ANY", 1),
    (r"\.(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)\"", 1, 2),
)
CALLS = (
    (r"\bfetch\(\s*['\"`]([^'\"`]+)['\"`](?:\s*,\s*\{[^}]*method:\s*['\"](\w+))?", 2, 1),
    (rf"(?i)\b(?:axios|http|\$http|api|client|requests|httpx)\.({METHODS})\(\s*f?['\"`]([^'\"`]+)", 1, 2),
    (r"\.(Get|Post|Put|Delete|Patch)(?:Async|FromJsonAsync)\(\s*\$?\"([^\"]+)\"", 1, 2),
    (r"\bhttp\.(Get|Post)\(\s*\"([^\"]+)\"", 1, 2),
)
CONTROLLER = r"class\s+(\w+?)Controller\b"
CONTROLLER_ROUTE = r"\[Route\(\s*\"([^\"]+)\""
CONTROLLER_METHOD = r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\s*\"([^\"]*)\"\s*\))?\]"
CLASS_ROUTE = r"@RequestMapping\(\s*(?:value\s*=\s*)?\"([^\"]+)\""


def _hit(groups: int, fixed: str):
    """Of a place its line, the method that the first group says (``route`` says none), and the path."""

    def one(x: Column) -> Column:
        said = [F.when(~F.lower(F.coalesce(x[f"m{i}"], F.lit(""))).isin("", "route"), x[f"m{i}"]) for i in range(groups)]
        return F.struct(x["l"].alias("line"), F.upper(F.coalesce(*said, F.lit(fixed))).alias("method"), x["p"].alias("path"))

    return one


def _hits(files: DataFrame, patterns: tuple) -> DataFrame:
    """(id, lang, content, line, method, path) of each place where a pattern holds; GET where none is named."""
    empty = F.array().cast("array<struct<line:int,method:string,path:string>>")
    found = []
    for pattern, method, path in patterns:
        pick = lambda g, p=pattern: F.regexp_extract_all("content", F.lit(p), g)
        groups = () if isinstance(method, str) else method if isinstance(method, tuple) else (method,)
        fixed = method if isinstance(method, str) else "GET"
        rows = F.arrays_zip(match_lines(F.col("content"), F.lit(pattern), pick(0)).alias("l"), pick(path).alias("p"), *[pick(g).alias(f"m{i}") for i, g in enumerate(groups)])
        found.append(F.transform(rows, _hit(len(groups), fixed)))
    return files.select("id", "lang", "content", F.explode(F.concat(empty, *found)).alias("h")).select("id", "lang", "content", "h.*")


def routes(files: DataFrame) -> DataFrame:
    """(id, method, path, line) of the routes in ``files`` (id, lang, content); paths are normal, parameters ``:p``."""
    plain = _hits(files, ROUTES)
    base = F.regexp_extract("content", CLASS_ROUTE, 1)
    prefix = normal_url(base)
    path = normal_url(F.col("path"))
    below = F.when((F.col("lang") == "java") & (base != "") & ~path.startswith(prefix), normal_url(F.concat(prefix, F.lit("/"), path))).otherwise(path)
    named = plain.select("id", "method", below.alias("path"), "line")
    cls, route = F.regexp_extract("content", CONTROLLER, 1), F.regexp_extract("content", CONTROLLER_ROUTE, 1)
    root = F.regexp_replace(F.when(route != "", route).otherwise(cls), r"(?i)\[controller\]", cls)
    own = _hits(files.filter("lang = 'csharp'").filter(cls != ""), ((CONTROLLER_METHOD, 1, 2),))
    full = normal_url(F.concat(root, F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit("/"), "path")).otherwise("")))
    return named.union(own.select("id", "method", full.alias("path"), "line")).filter("path <> ''").distinct()


def calls(files: DataFrame) -> DataFrame:
    """(id, method, path, line) of the calls in ``files`` whose URL has a slash."""
    return _hits(files, CALLS).filter(F.col("path").contains("/")).select("id", "method", normal_url(F.col("path")).alias("path"), "line").distinct()


def bridges(offered: DataFrame, made: DataFrame) -> DataFrame:
    """(source, target, method, path, line, route_line): each call and the route of another file that it meets.

    A route fits by method (or ANY) and by segments, of which ``:p`` fits any; or a longer call ends with
    the whole of a route of two segments or more.  Of several the one of most segments counts, then the
    smallest by file, path and line; a (client, server, method, path) once.  Calls and routes are joined
    by how many segments they have and by their last plain segment, never all with all.
    """
    r = offered.select(F.col("id").alias("target"), F.col("method").alias("offers"), F.col("path").alias("route"), F.col("line").alias("route_line"), F.split("path", "/").alias("s")).withColumn("n", F.size("s"))
    c = made.select(F.col("id").alias("source"), "method", "path", "line", F.split("path", "/").alias("t")).withColumn("n", F.size("t"))
    fits = (F.col("source") != F.col("target")) & ((F.col("offers") == "ANY") | (F.col("offers") == F.col("method")))
    # equal lengths meet by their first segment, or where one of the two has a parameter there
    first = lambda x: F.element_at(x, 1)
    fixed, free = r.filter(first("s") != ":p"), r.filter(first("s") == ":p")
    same = c.withColumn("k", first("t")).join(fixed.withColumn("k", first("s")), ["n", "k"]).drop("k")
    loose = c.join(free, "n").unionByName(c.filter(first("t") == ":p").join(fixed, "n"))
    alike = same.unionByName(loose).filter(fits & same_route(F.col("t"), F.col("s")))
    tails = F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda k: F.array_join(F.slice("t", F.size("t") - k + 1, k), "/"))
    ending = c.filter("n > 2").withColumn("route", F.explode(tails)).drop("n").join(r.filter("n >= 2"), "route").filter(fits)
    met = alike.unionByName(ending.select(alike.columns))
    best = met.groupBy("source", "method", "path", "line").agg(F.min(F.struct((-F.col("n")).alias("n"), "target", "route", "route_line")).alias("b"))
    once = best.select("source", "b.target", "method", F.concat(F.lit("/"), "b.route").alias("path"), "line", "b.route_line")
    place = F.row_number().over(Window.partitionBy("source", "target", "method", "path").orderBy("line", "route_line"))
    return once.withColumn("place", place).filter("place = 1").drop("place")
