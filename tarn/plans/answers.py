"""Answers to the thirteen questions: rows of evidence, each from a filter, an order and a limit over a repository's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import grade
from ..session import cut

ROWS = "place int, id string, text string, tag string"


def _rows(df: DataFrame, order: list[Column], most: int, id_col: str, said: Column, tag: Column) -> DataFrame:
    """(place, id, text, tag) of the first ``most`` rows; numbering comes after the limit, over those alone."""
    top = df.select(F.col(id_col).cast("string").alias("id"), said.alias("text"), tag.cast("string").alias("tag"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate([*order, F.col(id_col).cast("string")])]).alias("o")).orderBy("o").limit(most)
    return top.select(F.row_number().over(Window.orderBy("o")).alias("place"), "id", "text", "tag")


def _said(form: str, *columns) -> Column:
    return F.format_string(form, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


def _own(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("skipped"))


def risk(files: DataFrame) -> DataFrame:
    """The five riskiest."""
    return _rows(_own(files), [-F.col("score")], 5, "id", _said("riesgo %s · %s dependientes · %s cambios/90 d", "score", "fan_in", "c90"), F.col("level"))


def dominant(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, part, share): the part of the risk that weighs most, and its share of the score; the first in order of equals."""
    parts = F.array(*[F.struct((F.col(f"parts.{k}") * w).alias("x"), F.lit(-i).alias("i"), F.lit(k).alias("part")) for i, (k, w) in enumerate(weights.items())])
    best = F.array_max(parts)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["x"])
    return _own(scored).select("id", best["part"].alias("part"), F.when(total > 0, F.floor(best["x"] / total * 100 + 0.5) / 100).otherwise(0.0).alias("share"))


def impact(files: DataFrame, impacts: DataFrame, of: str | None = None) -> DataFrame:
    """The five with the widest impact; with ``of``, who depends on that file, the first twelve."""
    if of is None:
        joined = _own(files).join(impacts.select(F.col("node").alias("id"), "total", "direct"), "id")
        return _rows(joined, [-F.col("total")], 5, "id", _said("%s afectados (%s directos)", "total", "direct"), F.lit(""))
    each = impacts.filter(F.col("node") == of).select("direct", F.posexplode("ids").alias("p", "other")).filter("p < 12")
    return each.select((F.col("p") + 1).alias("place"), F.col("other").cast("string").alias("id"), F.when(F.col("p") < F.col("direct"), "depende directamente").otherwise("indirecto").alias("text"), F.lit("").alias("tag"))


def hidden(pairs: DataFrame) -> DataFrame:
    """The six strongest pairs that change together unlinked."""
    return _rows(pairs.filter("hidden"), [-F.col("count") * F.col("strength"), F.col("a"), F.col("b")], 6, "a", _said("↔ %s · %s commits juntos", "b", "count"), F.lit("oculto"))


def duplicates(groups: DataFrame) -> DataFrame:
    """The five dearest groups of copies (group, copies, lines, sev, score, test) outside tests."""
    return _rows(groups.filter("not test"), [-F.col("score")], 5, "group", _said("%s copias de %s líneas · %s · puntaje %s", "copies", "lines", "sev", "score"), F.col("sev"))


def tests(files: DataFrame) -> DataFrame:
    """The six riskiest that no test reaches, orphans aside."""
    found = _own(files).filter((F.col("coverage") == "ninguna") & (F.col("role") != "orphan"))
    return _rows(found, [-F.col("score")], 6, "id", _said("riesgo %s · %s dependientes · %s cambios/90 d", "score", "fan_in", "c90"), F.lit("sin pruebas"))


def owner(files: DataFrame, shares: DataFrame | None = None, of: str | None = None) -> DataFrame:
    """The six riskiest that one person knows; with ``of``, that file's authors from ``shares`` (id, author, commits, share, place)."""
    if of is not None:
        return shares.filter(F.col("id") == of).select(F.col("place"), F.lit(None).cast("string").alias("id"), _said("%s · %s commits", "author", "commits").alias("text"), F.lit("").alias("tag"))
    found = _own(files).filter("sole_owner")
    return _rows(found, [-F.col("score")], 6, "id", _said("%s · %s commits", "owner", "commits"), F.lit("propietario único"))


def dead(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Six orphans, then four exported symbols (file, name, total) that nothing but tests uses."""
    orphans = _rows(_own(files).filter("role = 'orphan'"), [], 6, "id", _said("nadie lo importa · %s líneas", "lines"), F.lit("huérfano"))
    unused = symbols.filter("total = 0").join(_own(files).select(F.col("id").alias("file")), "file", "left_semi")
    rest = _rows(unused, [F.col("file"), F.col("name")], 4, "file", _said("símbolo %s sin usos", "name"), F.lit("sin uso"))
    return orphans.union(rest.withColumn("place", F.col("place") + 6))


def cycles(found: DataFrame) -> DataFrame:
    """Of the first four cycles (node, component) four files each."""
    nth = F.dense_rank().over(Window.orderBy("component"))
    first = found.select("component").distinct().orderBy("component").limit(4).withColumn("c", nth)
    own = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    each = found.join(F.broadcast(first), "component").withColumn("n", own).filter("n <= 4")
    return each.select(((F.col("c") - 1) * 4 + F.col("n")).alias("place"), F.col("node").cast("string").alias("id"), F.lit("participa en un ciclo").alias("text"), F.lit("ciclo").alias("tag"))


def generated(files: DataFrame) -> DataFrame:
    """Ten generated files, tests among them."""
    return _rows(files.filter("gen is not null"), [], 10, "id", _said("%s líneas · %s", "lines", "gen"), F.lit("generado"))


def dynamic(files: DataFrame) -> DataFrame:
    """The eight with most lines that the graph can't follow, (line, what) in ``dyn``."""
    found = files.filter(~F.col("is_test") & (F.size("dyn") > 0))
    what = F.array_join(F.array_distinct(F.transform("dyn", lambda u: u["what"])), ", ")
    return _rows(found, [-F.size("dyn")], 8, "id", _said("%s (línea %s)", what, F.col("dyn")[0]["line"]), F.lit("reflexión"))


def recursion(found: DataFrame) -> DataFrame:
    """The functions (id, kind, names, line) that call themselves, of the first eight files, twelve rows."""
    files = found.select("id").distinct().orderBy("id").limit(8)
    said = F.when(F.col("kind") == "mutua", F.array_join("names", " ⇄ ")).otherwise(F.concat(F.col("names")[0], F.lit("() se llama a sí misma")))
    return _rows(found.join(F.broadcast(files), "id", "left_semi"), [F.col("id"), F.col("kind"), F.col("line")], 12, "id", _said("%s · línea %s", said, F.col("line")), F.col("kind"))


def since(changes: DataFrame) -> DataFrame:
    """What ``snapshot_diff`` (id, change, from, to) found: fourteen rows, riskier ones first, then new, gone and changed ones."""
    rank = F.coalesce(*[F.when(F.col("change") == k, F.lit(i)) for i, k in enumerate(("riesgo", "añadido", "eliminado", "estado"))])
    return _rows(changes, [rank], 14, "id", F.concat_ws(" ", "change", F.concat_ws(" → ", "from", "to")), F.col("change"))


def health(findings: DataFrame) -> DataFrame:
    """The first six grave findings (kind, sev, id, place)."""
    return _rows(findings.filter("sev = 'alta'"), [F.col("kind"), F.col("place")], 6, "id", _said("%s %s", "kind", "place"), F.lit("alta"))


def confidence(n: Column, commits: Column) -> Column:
    """How far an answer from ``n`` observations in a history of ``commits`` can be trusted."""
    return F.when(F.coalesce(commits, F.lit(0)) == 0, "baja").otherwise(grade(F.least(n, commits)))


def graph_confidence(dynamic_imports: Column, dynamic_files: Column, reflective: Column) -> Column:
    """How far an answer from imports alone can be trusted: not whole where the graph has limits."""
    return F.when((dynamic_imports > 0) | (dynamic_files > 0) | reflective, "media").otherwise("alta")


def named_file(questions: DataFrame, question: str, files: DataFrame) -> DataFrame:
    """``questions`` with file: of the ``files`` (id) whose id, name or stem of three characters or more a
    question has as a word the one of the longest; ties go to the smallest id.

    Questions and names are joined by words, not all with all.  A word carries its question's hash, not its
    text, and only if a name has it; the text comes back to the names that share a word with it, where each is told exactly.
    """
    label = F.element_at(F.split("id", "/"), -1)
    keys = F.array_distinct(F.array(text.fold(F.col("id")), text.fold(label), text.fold(F.regexp_replace(label, r"\.[^.]+$", ""))))
    named = files.select("id", F.explode(keys).alias("key")).filter(F.length("key") >= 3)
    words = lambda c: F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")
    named = named.withColumn("word", F.element_at(words(F.col("key")), 1))
    asked = questions.select(F.col(question).alias("q")).distinct().withColumn("h", F.xxhash64("q"))
    said = asked.select("h", F.explode(F.array_distinct(words(text.fold(F.col("q"))))).alias("word"))
    known = cut(named.join(said.select("word").distinct(), "word", "left_semi"))
    # few words are left; an explode is sized as what it is made from, so they aren't broadcast
    kept = said.join(known.select("word").distinct(), "word", "left_semi").hint("merge")
    met = kept.join(known, "word").select("h", "key", "id").join(asked, "h")
    escaped = F.regexp_replace("key", r"([.*+?^${}()|\[\]\\])", r"\\$1")
    whole = F.regexp_like(text.fold(F.col("q")), F.concat(F.lit("(^|[^a-z0-9])"), escaped, F.lit("($|[^a-z0-9])")))
    best = met.filter(whole).groupBy("q").agg(F.min(F.struct((-F.length("key")).alias("n"), "id")).alias("b"))
    return questions.join(best.select(F.col("q").alias(question), F.col("b.id").alias("file")), question, "left")
