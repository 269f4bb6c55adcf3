"""What a file's own text tells: comments, summary, marks, annotations, recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import cycles

#: Lines of a function's body that are looked at, at most, where braces end it; and findings of a file.
BODY, MOST = 400, 8


def summary(noted: DataFrame) -> DataFrame:
    """(id, summary): the first comment within three lines that isn't an annotation, 140 characters of it."""
    first = noted.filter((F.col("line") <= 3) & ~F.col("comment").rlike("@rel|@set")).groupBy("id").agg(F.min_by("comment", "line").alias("c"))
    return first.select("id", F.substring(F.trim(F.regexp_replace("c", r"^[\s*]+", "")), 1, 140).alias("summary"))


def tags(noted: DataFrame) -> DataFrame:
    """(id, tag): what ``@set name`` says in comments."""
    return noted.select("id", F.explode(F.regexp_extract_all("comment", F.lit(r"@set\s+([\w.-]+)"), 1)).alias("tag")).distinct()


def declared(noted: DataFrame) -> DataFrame:
    """(id, line, target, card, label) of ``@rel Target card label`` in comments, one of each comment."""
    pattern = r"(?m)@rel\s+(\S+)\s+(1:1|1:N|N:1|N:M)(?:[ \t]+(.*))?$"
    part = lambda n: F.regexp_extract("comment", pattern, n)
    return noted.select("id", "line", part(1).alias("target"), part(2).alias("card"), F.trim(part(3)).alias("label")).filter("target <> ''")


def relations(declarations: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, target, kind, card, label, line, both) and warnings (id, line, target, why) of ``declarations``.

    A target is the file of that id, case aside, else the only one of that stem; none or several is a
    warning.  What two files declare of each other is one relation, that of the smaller line of ids.
    """
    stem = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]+$", ""))
    by_id = files.select(F.lower("id").alias("key"), F.col("id").alias("exact"))
    by_stem = files.groupBy(stem(F.col("id")).alias("stem")).agg(F.min("id").alias("named"), F.count("*").alias("n"))
    asked = declarations.withColumn("key", F.lower("target")).withColumn("stem", F.lower(F.regexp_replace("target", r"\.[^.]+$", "")))
    met = asked.join(by_id, "key", "left").join(by_stem, "stem", "left")
    found = F.coalesce("exact", F.when(F.col("n") == 1, F.col("named")))
    told = met.withColumn("to", found)
    why = F.when(F.col("n") > 1, "ambiguo").otherwise("no se encontró")
    warnings = told.filter("to is null").select("id", "line", "target", why.alias("why"))
    one = told.filter("to is not null and to <> id").select(F.least("id", "to").alias("lo"), F.greatest("id", "to").alias("hi"), F.struct("id", "line", "to", "card", "label").alias("r"))
    kept = one.groupBy("lo", "hi").agg(F.min("r").alias("r"), (F.count_distinct("r.id") > 1).alias("both"))
    return kept.select(F.col("r.id").alias("source"), F.col("r.to").alias("target"), F.lit("relation").alias("kind"), "r.card", "r.label", "r.line", "both"), warnings


def recursion(files: DataFrame, defined: DataFrame) -> DataFrame:
    """(id, kind, names, line): functions of a file that call themselves (directa) or each other (mutua), MOST a file.

    Calls are told by name within a file, (id, lang, code).  A function's body are the lines behind it
    that are indented deeper (Python), or those until its braces close.
    """
    functions = defined.filter(F.col("kind").isin("function", "method", "const")).select(F.col("file").alias("id"), "name", F.col("line").alias("begin"))
    lines = F.split("code", "\n")
    indent = lambda x: F.length(F.regexp_extract(x, r"^\s*", 0))
    rest = F.slice(lines, F.col("begin") + 1, F.size(lines))
    own = F.element_at(lines, F.col("begin"))
    # how many lines belong to it: up to the first that doesn't
    ends = F.transform(rest, lambda x, i: F.when((F.trim(x) != "") & (indent(x) <= indent(own)), i))
    python = F.coalesce(F.array_min(F.array_compact(ends)), F.size(rest))
    whole = F.slice(lines, F.col("begin"), BODY)
    opened = lambda x: F.length(F.regexp_replace(x, r"[^{]", "")) - F.length(F.regexp_replace(x, r"[^}]", ""))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("begun"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        depth, begun = acc["depth"] + opened(x), acc["begun"] | x.contains("{")
        more = F.struct(depth.cast("int").alias("depth"), begun.alias("begun"), (acc["n"] + 1).cast("int").alias("n"), ((begun & (depth <= 0)) | (~begun & (acc["n"] >= 2))).alias("done"))
        return F.when(acc["done"], acc).otherwise(more)

    braces = F.aggregate(whole, start, step)
    count = F.when(F.col("lang") == "python", python + 1).otherwise(F.when(braces["begun"], braces["n"]).otherwise(1))
    bodies = functions.join(files.select("id", "lang", "code"), "id").select("id", "name", "begin", F.slice(lines, F.col("begin"), count).alias("body"))
    # its own name, where it is defined, is no call; what follows on that line may be one
    head = F.regexp_replace(F.element_at("body", 1), F.concat(F.lit(r"^(.*?)\b"), F.regexp_replace("name", r"\$", r"\\\\\$"), F.lit(r"\b")), "$1 ")
    text = F.concat(head, F.lit("\n"), F.array_join(F.slice("body", F.lit(2), F.size("body")), "\n"))
    calls = bodies.select("id", "name", "begin", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1))).alias("called"))
    known = functions.select("id", F.col("name").alias("called")).distinct()
    calls = calls.join(known, ["id", "called"])
    direct = calls.filter("name = called").groupBy("id", "name").agg(F.min("begin").alias("line")).select("id", F.lit("directa").alias("kind"), F.array("name").alias("names"), "line")
    ends_ = calls.select(F.concat_ws("#", "id", "name").alias("src"), F.concat_ws("#", "id", "called").alias("dst"))
    inside = cycles(ends_).withColumn("id", F.regexp_extract("node", "^(.*)#[^#]*$", 1)).withColumn("name", F.regexp_extract("node", "#([^#]*)$", 1))
    mutual = inside.join(functions, ["id", "name"]).groupBy("id", "component").agg(F.array_sort(F.collect_set("name")).alias("names"), F.min("begin").alias("line")).select("id", F.lit("mutua").alias("kind"), "names", "line")
    place = F.row_number().over(Window.partitionBy("id").orderBy("kind", "line", "names"))
    return direct.union(mutual).withColumn("place", place).filter(F.col("place") <= MOST).drop("place")
