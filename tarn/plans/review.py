"""Changes in words: what to know before one, what got worse after it, and the review of a tree against a git reference."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut, shares
from . import guard
from .wording import listed, say
from .world import World

#: Pairs of a changed file that are looked at, and files that a sentence names.
TOGETHER, NAMED = 5, 100


def together(changed: DataFrame, pairs: DataFrame, most: int = TOGETHER) -> DataFrame:
    """(id, other, count, strength, linked): the strongest partners of each of the ``changed`` files (id) that aren't changed themselves.

    ``pairs`` is a written table: it is counted first, so that a task's share of it doesn't grow.
    """
    # the side that stays whole is dealt: a semi or anti join is pushed below what deals the other
    dealt = changed.repartition(shares(2 * pairs.count(), pairs.sparkSession), "id")
    side = lambda x, y: pairs.select(F.col(x).alias("id"), F.col(y).alias("other"), "count", "strength", (~F.col("hidden")).alias("linked"))
    met = side("a", "b").union(side("b", "a")).join(dealt.withColumnRenamed("id", "other"), "other", "left_anti").join(dealt, "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("id").orderBy((F.col("count") * F.col("strength")).desc(), "other"))
    return met.withColumn("p", place).filter(F.col("p") <= most).select("id", "other", "count", "strength", "linked")


def advice(told: DataFrame, files: DataFrame, *, pairs: DataFrame | None = None, members: DataFrame | None = None, bridges: DataFrame | None = None, cycles: DataFrame | None = None) -> DataFrame:
    """(id, place, text): what ``guard.facts`` warn of, a sentence each.

    ``files`` has dyn (line, what), ``members`` group, name and file of copies, ``bridges`` source, target, method and
    path.  A cycle names three others, a bridge two calls.
    """
    c = F.col
    asked = cut(told.join(files.select("id", F.col("dyn").alias("__dyn")), "id", "left"))
    changed = asked.select("id")
    kinds = F.array_join(F.array_distinct(F.transform("__dyn", lambda d: d["what"])), ", ")
    own = [
        (0, ~c("known"), say(c("id"), ": no está en el análisis (archivo nuevo o ruta distinta): no hay datos previos.")),
        (1, c("gen").isNotNull(), say(c("id"), " es código GENERADO (", c("gen"), "): no lo edites a mano; cambia el generador o su plantilla.")),
        (2, c("aux"), say(c("id"), " vive en una carpeta de ejemplos/herramientas, fuera del producto.")),
        (3, c("dynamic"), say(c("id"), " usa reflexión o carga dinámica (", kinds, "): hay dependientes que el grafo no ve; el impacto real puede ser mayor.")),
        (5, c("capped"), say(c("id"), ": el cálculo de impacto se cortó por tamaño; el alcance real es mayor.")),
        (6, (c("coverage") == "ninguna") & (c("fan_in") >= 1), say(c("id"), " no tiene pruebas y lo usan ", c("fan_in"), " archivos: añade una antes de cambiarlo.")),
    ]
    said = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(n).alias("place"), words.alias("text"))) for n, holds, words in own]))
    out = [asked.select("id", F.explode(said).alias("x")).select("id", "x.place", "x.text")]
    sentence = lambda rows, n, words: out.append(rows.select("id", F.lit(n).alias("place"), words.alias("text")))
    if cycles is not None:
        mine = cycles.select(c("node").alias("id"), "component").join(changed, "id", "left_semi")
        others = mine.join(cycles.select(c("node").alias("other"), "component"), "component").filter("id <> other")
        sentence(listed(others, c("other"), [c("other")], 3, ", ", "id"), 4, say(c("id"), " está en un ciclo con ", c("words"), ": un cambio de interfaz puede propagarse en círculo."))
    if pairs is not None:
        sentence(together(changed, pairs).filter("not linked"), 7, say(c("id"), " suele cambiar junto con ", c("other"), " (", c("count"), " commits) aunque no se importan: revisa si también hay que tocar ese."))
    if members is not None:
        files_of = members.groupBy("group", "file").agg(F.min("name").alias("own"))
        mine = files_of.join(changed.withColumnRenamed("id", "file"), "file", "left_semi").select(c("file").alias("id"), "group")
        name = members.filter("name is not null").groupBy("group", "name").agg(F.count("*").alias("n")).groupBy("group").agg(F.min_by("name", F.struct(-c("n"), c("name"))).alias("name"))
        pair = mine.join(files_of.select("group", c("file").alias("other")), "group").filter("id <> other").withColumn("k", F.concat_ws("\n", "id", "group"))
        rest = listed(pair, c("other"), [c("other")], NAMED, ", ", "k").drop("n")
        rows = mine.withColumn("k", F.concat_ws("\n", "id", "group")).join(rest, "k", "left").join(name, "group", "left")
        sentence(rows, 8, say(c("id"), " contiene ", F.coalesce("name", F.lit("(anónima)")), "(), copiada en ", F.coalesce("words", F.lit("otro lugar del mismo archivo")), ": si lo cambias, cambia las copias."))
    if bridges is not None:
        via = F.concat_ws(" ", "method", "path").alias("via")
        ends = bridges.select(c("source").alias("id"), c("target").alias("other"), F.lit("llama a").alias("dir"), via).union(bridges.select("target", "source", F.lit("la llaman desde"), via))
        calls = ends.join(changed, "id", "left_semi").distinct().withColumn("k", F.concat_ws("\n", "id", "other", "dir"))
        shown = listed(calls, c("via"), [c("via")], 2, ", ", "k").drop("n")
        sentence(calls.select("id", "other", "dir", "k").distinct().join(shown, "k"), 9, say(c("id"), " ", c("dir"), " ", c("other"), " por HTTP (", c("words"), "): el contrato no lo comprueba ningún compilador."))
    return reduce(DataFrame.union, out)


def issues(found: DataFrame, before: DataFrame, after: DataFrame, signed: DataFrame, health: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(sev, id, rule, text): ``guard.compare``'s findings in words, from both prints and the signatures after."""
    c = F.col
    was = before.select("id", c("risk").alias("r0"), c("fan_in").alias("f0"))
    now = after.select("id", c("risk").alias("r1"), c("fan_in").alias("f1"), c("loc").alias("l1"))
    ring = signed.filter("kind = 'cycle'").select("signature", c("id").alias("node"))
    rings = listed(ring, c("node"), [c("node")], 4, ", ", "signature").select("signature", say(c("words"), F.when(c("n") > 4, "…")).alias("ring"))
    rows = found.filter("rule <> 'resuelto'").join(was, "id", "left").join(now, "id", "left").join(rings, "signature", "left")
    parts = F.split("signature", r"\|")
    drop = 0 if None in health else health[0] - health[1]
    words = {
        "ciclo nuevo": say("Ciclo nuevo entre ", c("ring"), "."),
        "riesgo": say(c("id"), ": el riesgo sube de ", c("r0"), " a ", c("r1"), "."),
        "dependientes": say(c("id"), ": ahora lo usan ", c("f1"), " archivos (antes ", c("f0"), "); se está volviendo un punto central."),
        "reflexión": say(c("id"), ": ahora usa reflexión o carga dinámica (el grafo ya no ve todo lo que depende de él)."),
        "sin pruebas": say(c("id"), " es nuevo (", c("l1"), " líneas) y no tiene pruebas."),
        "nuevo": say(c("id"), " es nuevo."),
        "eliminado en uso": say(c("id"), " se borró y lo usaban ", c("f0"), " archivos: comprueba que ya no se referencie."),
        "duplicación nueva": say("Duplicación nueva: ", F.get(parts, F.lit(0)), "() aparece en ", F.replace(F.get(parts, F.lit(1)), F.lit(","), F.lit(", ")), "."),
        "puente nuevo": say("Puente HTTP nuevo: ", c("signature"), "."),
        "salud": F.lit(f"La salud del proyecto baja {drop} puntos ({health[0]} → {health[1]})."),
    }
    turn = F.coalesce(*[F.when(c("rule") == r, F.lit(i)) for i, r in enumerate(words)])
    return rows.select("sev", "id", "rule", F.coalesce(*[F.when(c("rule") == r, w) for r, w in words.items()]).alias("text"), turn.alias("turn"))


def tests(found: DataFrame) -> DataFrame:
    """(test, why): ``relations.impact_tests`` in words, the nearest first."""
    c = F.col
    rank = F.when(c("why") == "prueba directa", 0).when(c("why") == "prueba de quien depende", 1).otherwise(2)
    far = say("prueba de ", text.stem(c("via")), F.when(rank == 1, ", que depende de ").otherwise(", afectado indirectamente por "), text.stem(c("of")))
    return found.select("test", F.when(rank == 0, say("prueba directa de ", text.stem(c("of")))).otherwise(far).alias("why"), rank.alias("rank"))


def limits(world: World) -> DataFrame:
    """(n, text): what the graph can't see, dynamic imports and files with reflection."""
    c = F.col
    dynamic = world.edges.filter("kind = 'dynamic'").agg(F.count("*").alias("n")).select("n", say(c("n"), " imports dinámicos que el grafo no sigue").alias("text"))
    reflected = world.files.filter("not is_test and dyn is not null").agg(F.count("*").alias("n")).select("n", say(c("n"), " archivos con reflexión").alias("text"))
    return dynamic.union(reflected).filter("n > 0")


@dataclass
class Review:
    """level; issues: sev, id, rule, text; changed: path, status; files: id, score, gen, fan_in, new; advice: id, place, text;
    tests: test, why; reviewers: owner, files; resolved: old problems that are gone; health before and after."""

    ref: str
    level: str
    issues: DataFrame
    changed: DataFrame
    files: DataFrame
    advice: DataFrame
    tests: DataFrame
    reviewers: DataFrame
    resolved: int
    health: tuple[int, int]

    def markdown(self) -> str:
        """The review as a text; what it lists is bounded, the tables have all."""
        rows = lambda df, n, *order: df.orderBy(*order).limit(n).collect()
        counts = {r.status: r["count"] for r in self.changed.groupBy("status").count().collect()}
        out = [f"## Riesgo del cambio: **{self.level}**", "", f"Frente a `{self.ref}`: {counts.get('A', 0)} nuevo(s), {counts.get('M', 0)} modificado(s), {counts.get('D', 0)} borrado(s)."]
        part = lambda title, lines, none=None: out.extend(["", f"### {title}", *lines] if lines else ["", f"### {title}", none] if none else [])
        part("Archivos", [f"- `{r['id']}` — riesgo {r.score}" + (" · generado" if r.gen else "") + (f" · lo usan {r.fan_in}" if r.fan_in else "") + (" · nuevo" if r.new else "") for r in rows(self.files, 15, F.col("new").desc(), "id")])
        told = lambda sev, n: [f"- {r.text}" for r in rows(self.issues.filter(F.col("sev") == sev), n, "turn", "id", "text")]
        part("Qué revisar", told("revisar", NAMED), "- No se detectaron empeoramientos estructurales.")
        part("Notas", told("nota", 6))
        part("Avisos de los archivos modificados", [f"- {r.text}" for r in rows(self.advice, 8, "id", "place", "text")])
        part("Pruebas a correr", [f"- `{r.test}` — {r.why}" for r in rows(self.tests, 12, "rank", "test")], "- Ninguna conocida para los archivos modificados.")
        part("Quién debería revisar", [f"- {r.owner} (conoce {r.files} de los archivos modificados)" for r in rows(self.reviewers, 3, F.col("files").desc(), "owner")])
        if self.resolved:
            out += ["", f"✔ {self.resolved} problema(s) previos ya no están."]
        change = self.health[1] - self.health[0]
        out += ["", f"Salud del proyecto: {'+' if change >= 0 else ''}{change}.", "", "_Análisis estructural (imports, ciclos, duplicación, pruebas): no ejecuta el código ni sustituye a las pruebas._"]
        return "\n".join(out)


def review(spark: SparkSession, root: str, ref: str = "HEAD", world: World | None = None) -> Review:
    """The tree at ``root`` against ``ref``: what got worse, what to know of the modified files, tests to run and who should look.

    ``world`` is the tree's with its history; without it nobody knows who owns the files or what changes together.
    """
    old, new, found, changed = guard.measured(spark, root, ref)
    whole = world or new
    before, after = guard.fingerprint(old.files), guard.fingerprint(new.files)
    signed = guard.signatures(cycles=new.cycles, bridges=new.bridges, like=new.files)
    health = (old.health_score(), new.health_score())
    named = changed.withColumnRenamed("path", "id").join(whole.files.select("id"), "id", "left_semi")
    modified = cut(named.filter("status = 'M'").select("id"))
    touched = named.filter("status in ('A', 'M')").join(whole.files.select("id", "score", "gen", "fan_in"), "id").select("id", "score", "gen", "fan_in", (F.col("status") == "A").alias("new"))
    plan = guard.plan(whole.files, whole.impact, whole.tested, modified)
    told = advice(plan["facts"], whole.files, pairs=whole.pairs, members=whole.members, bridges=whole.bridges, cycles=whole.cycles)
    resolved = found.filter("rule = 'resuelto'").count()
    return Review(ref, guard.level(found), cut(issues(found, before, after, signed, health)), changed, cut(touched), cut(told), cut(tests(plan["tests"])), cut(guard.reviewers(whole.files, modified)), resolved, health)
