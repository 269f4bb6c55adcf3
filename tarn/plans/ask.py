"""Questions in plain words, answered in one plan: a table of questions meets a table of answers by intent and file."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.risk import WEIGHTS
from ..session import cut
from .answers import confidence, graph_confidence, named_file

ROW = "struct<id:string,text:string,tag:string>"

# The wording of questions, reasons and doubts.
TITLES = {
    "risk": "¿Qué es lo más riesgoso de tocar?",
    "impact": "¿Qué se rompe si cambio…?",
    "hidden": "¿Qué archivos cambian juntos sin importarse?",
    "dup": "¿Dónde la duplicación cuesta más?",
    "tests": "¿Qué importante no tiene pruebas?",
    "owner": "¿Quién conoce este código? (factor autobús)",
    "dead": "¿Qué puedo borrar con seguridad?",
    "cycles": "¿Hay dependencias circulares?",
    "generated": "¿Qué código es generado?",
    "dynamic": "¿Dónde falla el grafo por reflexión?",
    "recursion": "¿Qué funciones son recursivas?",
    "since": "¿Qué cambió desde la última vez?",
    "health": "¿Cómo está el proyecto en general?",
}
PARTS = {
    "fan_in": "muchos dependen de él", "churn": "cambia seguido", "cycle": "está en un ciclo", "untested": "poca cobertura",
    "owner": "lo conoce una sola persona", "size": "tamaño", "dup": "código duplicado",
}
REFLECTIVE = ("csharp", "java", "kotlin", "python", "php")
MISUNDERSTOOD = "No entendí la pregunta. Prueba con una de estas:"


@dataclass
class Facts:
    """What answers are made of.  A table that is None wasn't measured.

    files: id, score, level, parts, fan_in, c90, commits, coverage, role, lines, last, gen, dyn (line, what),
    skipped, is_test, owner, owner_share, bus_factor, sole_owner.  impacts: node, total, direct, depth,
    capped, ids.  pairs: a, b, count, strength, conf_ab, conf_ba, lift, hidden.  groups: group, name, file,
    copies, lines, sev, score, co_count, test, files (array), warned.  shares: id, author, commits, share,
    place.  symbols: file, name, total.  cycles: node, component.  recursion: id, kind, names, line.
    changes: id, change, from, to (``snapshot_diff``).  findings: sev, id, title, place.  health: score,
    grade.  tested: file, test.  commits, dynamic imports, files with dynamic use and whether a language reflects are numbers.
    """

    files: DataFrame
    impacts: DataFrame | None = None
    pairs: DataFrame | None = None
    groups: DataFrame | None = None
    shares: DataFrame | None = None
    symbols: DataFrame | None = None
    cycles: DataFrame | None = None
    recursion: DataFrame | None = None
    changes: DataFrame | None = None
    findings: DataFrame | None = None
    health: DataFrame | None = None
    tested: DataFrame | None = None
    commits: int = 0
    dynamic_imports: int = 0
    dynamic_files: int = 0
    reflective: bool = False
    when: str = ""


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pct(x: Column) -> Column:
    return _say(F.floor(x * 100 + 0.5).cast("long"), "%")


def _plain(x: Column) -> Column:
    """A number without an empty fraction."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def _texts(*parts: Column | str) -> Column:
    """Those of ``parts`` that aren't null."""
    return F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])) if parts else F.array().cast("array<string>")


class _Trust:
    """How far answers can be trusted: (level, why)."""

    def __init__(self, facts: Facts):
        self.facts = facts

    def history(self, n: Column, what: Column | str) -> tuple[Column, Column]:
        commits = self.facts.commits
        if not commits:
            return F.lit("baja"), F.lit("No hay historial git: no se pueden medir cambios ni autores.")
        return confidence(n, F.lit(commits)), _say(what, ": ", n, " ", _plural(n, "evidencia", "evidencias"), f" sobre {commits} commits.")

    def graph(self, what: str) -> tuple[Column, Column]:
        f = self.facts
        limits = [f"{f.dynamic_imports} imports dinámicos que el grafo no sigue"] * (f.dynamic_imports > 0)
        limits += [f"{f.dynamic_files} {'archivo usa' if f.dynamic_files == 1 else 'archivos usan'} reflexión o carga dinámica"] * (f.dynamic_files > 0)
        limits += ["lenguajes con reflexión/inyección (los enlaces por tipo son aproximados)"] * f.reflective
        told = "Límites: " + "; ".join(limits) + "." if limits else "Grafo estático completo para este proyecto."
        return graph_confidence(F.lit(f.dynamic_imports), F.lit(f.dynamic_files), F.lit(f.reflective)), F.lit(f"{what}. {told}")


def _answer(intent: str, *, title: Column | str | None = None, headline: Column | str, trust: tuple[Column, Column] | tuple[str, str], challenge: Column | None = None, follow: tuple[str, ...] = (), rows: Column | None = None) -> Column:
    """One answer as a struct."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(intent).alias("intent"), lit(TITLES[intent] if title is None else title).alias("title"), lit(headline).alias("headline"), lit(trust[0]).alias("level"), lit(trust[1]).alias("why"),
        (challenge if challenge is not None else _texts()).alias("challenge"), F.array(*map(F.lit, follow)).cast("array<string>").alias("follow"), (rows if rows is not None else F.array()).cast(f"array<{ROW}>").alias("rows"),
    )


def _no_data(intent: str, said: str) -> Column:
    return _answer("risk", title=TITLES[intent], headline=said, trust=("baja", "Sin datos suficientes."), follow=("risk", "hidden", "dead")).withField("intent", F.lit("none"))


def _top(rows: DataFrame, order: list[Column], most: int, id_: Column | str, said: Column, tag: Column | str, *facts: str) -> DataFrame:
    """One row of the first ``most`` of ``rows``: n, rows, and of the first two the columns ``facts`` (``first``, ``second``)."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    ident = F.col(id_) if isinstance(id_, str) else id_
    placed = rows.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate([*order, ident.cast("string")])]).alias("o"), F.struct(ident.cast("string").alias("id"), said.alias("text"), lit(tag).cast("string").alias("tag")).alias("row"), F.struct(F.lit(1).alias("__one"), *[F.col(f) for f in facts]).alias("f"))
    first = placed.orderBy("o").limit(most)
    all_ = F.array_sort(F.collect_list(F.struct("o", "row", "f")))
    return first.agg(all_.alias("a")).select(F.size("a").alias("n"), F.transform("a", lambda x: x["row"]).alias("rows"), F.get("a", F.lit(0))["f"].alias("first"), F.get("a", F.lit(1))["f"].alias("second"))


def _nothing(facts: Facts) -> DataFrame:
    """A single row to hang an answer on that needs no data."""
    return facts.files.sparkSession.range(1)


def _risk(facts: Facts, trust: _Trust) -> DataFrame:
    files = facts.files.filter(~F.col("skipped"))
    weights = {k: w for k, w in WEIGHTS.items() if k in files.schema["parts"].dataType.names}
    parts = F.array(*[F.struct((F.col(f"parts.{k}") * w).alias("x"), F.lit(-i).alias("i"), F.lit(k).alias("k"), F.lit(PARTS[k]).alias("label")) for i, (k, w) in enumerate(weights.items())])
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["x"])
    best = F.array_max(parts)
    files = files.withColumns({"__part": best["k"], "__label": best["label"], "__share": F.when(total > 0, best["x"] / total).otherwise(best["x"]), "__stem": text.stem(F.col("id").cast("string"))})
    tested = F.when(F.col("coverage") == "directa", "").otherwise(" · sin pruebas")
    said = _say("riesgo ", F.col("score"), " · ", F.col("fan_in"), " dependientes · ", F.coalesce("c90", F.lit(0)), " cambios/90 d", tested)
    top = _top(files, [-F.col("score")], 5, "id", said, F.col("level"), "__part", "__label", "__share", "__stem", "score", "commits")
    one, two = F.col("first"), F.col("second")
    by_history, by_graph = trust.history(F.coalesce(one["commits"], F.lit(0)), "El motivo principal sale del historial"), trust.graph("El motivo principal es estructural (se mide en el grafo, no depende de cuántos commits tenga)")
    told = one["__part"].isin("churn", "owner")
    found = _answer(
        "risk",
        headline=_say(one["__stem"], " (riesgo ", one["score"], "/100). Principal motivo: ", one["__label"], " (", _pct(one["__share"]), " del puntaje)."),
        trust=tuple(F.when(told, h).otherwise(g) for h, g in zip(by_history, by_graph, strict=True)),
        challenge=_texts(
            _say(f"El puntaje es una suma ponderada de {len(weights)} señales, no una medición directa de fallos: ", one["__stem"], " puede ser estable aunque puntúe alto."),
            _say("La diferencia entre #1 y #2 es de ", one["score"] - two["score"], " puntos; si es pequeña, el orden es poco fiable."),
            "Que cambie seguido puede ser sana evolución, no fragilidad: revisa si esos cambios son correcciones (fix) o mejoras.",
        ),
        follow=("impact", "tests", "owner"), rows=F.col("rows"),
    )
    return top.select(F.when(F.col("n") == 0, _no_data("risk", "No hay métricas de riesgo.")).otherwise(found).alias("a"))


def _impact_doubts(stem: Column, tests: Column, coverage: Column, capped: Column) -> Column:
    few = F.when(coverage == "indirecta", " (solo hay cobertura indirecta)").otherwise("")
    return _texts(
        F.when(capped, "En un proyecto tan grande el cálculo se detiene en un tope: el alcance real es mayor."),
        "Solo cuenta dependencias por import; no ve contratos externos (HTTP, base de datos, archivos) ni llamadas por reflexión.",
        F.when(tests > 0, _say(tests, " ", _plural(tests, "prueba lo importa", "pruebas lo importan"), " directamente: son tu red de seguridad, pero no garantizan que cubran lo que cambies."))
        .otherwise(_say("Ninguna prueba importa ", stem, " directamente", few, ": poco te avisaría si algo se rompe.")),
        "Depender de un archivo no significa usar la parte que cambiarás; mira los símbolos de cada arista.",
    )


def _impacts(facts: Facts) -> DataFrame:
    """Files with the measure of their impact, 0 where none depends on them, and how many tests import them."""
    reached = facts.impacts.select(F.col("node").alias("id"), "total", "direct", "depth", "capped", "ids")
    files = facts.files.select("id", "coverage", "skipped").join(reached, "id", "left").na.fill(0, ["total", "direct", "depth"]).na.fill(False, ["capped"])
    if facts.tested is None:
        return files.withColumn("tests", F.lit(0).cast("long"))
    return files.join(facts.tested.groupBy(F.col("file").alias("id")).agg(F.count_distinct("test").alias("tests")), "id", "left").na.fill(0, ["tests"])


def _impact(facts: Facts, trust: _Trust) -> DataFrame:
    if facts.impacts is None:
        return _nothing(facts).select(_no_data("impact", "No hay radio de impacto calculado.").alias("a"))
    files = _impacts(facts).filter(~F.col("skipped")).withColumn("__stem", text.stem(F.col("id").cast("string")))
    top = _top(files, [-F.col("total")], 5, "id", _say(F.col("total"), " afectados (", F.col("direct"), " directos)"), F.lit(None), "__stem", "total", "tests", "coverage", "capped")
    one = F.col("first")
    found = _answer("impact", headline=_say("El mayor radio de impacto es ", one["__stem"], ": ", one["total"], " archivos dependen de él directa o indirectamente."), trust=trust.graph("Calculado sobre los imports del proyecto"), challenge=_impact_doubts(one["__stem"], one["tests"], one["coverage"], one["capped"]), follow=("tests", "hidden"), rows=F.col("rows"))
    return top.select(F.when(F.col("n") == 0, _no_data("impact", "No hay radio de impacto calculado.")).otherwise(found).alias("a"))


def _impact_of(facts: Facts, trust: _Trust, asked: DataFrame) -> DataFrame:
    files = _impacts(facts).join(asked, "id", "left_semi").withColumn("__stem", text.stem(F.col("id").cast("string")))
    c = F.col
    listed = F.transform(F.slice(F.coalesce("ids", F.array().cast(facts.impacts.schema["ids"].dataType)), 1, 12), lambda x, i: F.struct(x.cast("string").alias("id"), F.when(i < c("direct"), "depende directamente").otherwise("indirecto").alias("text"), F.lit("").alias("tag")))
    headline = _say(c("__stem"), " afecta a ", F.when(c("capped"), "al menos ").otherwise(""), c("total"), " ", _plural(c("total"), "archivo", "archivos"), " (", c("direct"), " directos, hasta ", c("depth"), " ", _plural(c("depth"), "nivel", "niveles"), "); ", c("total"), " de producción.")
    return files.select(c("id").alias("file"), _answer("impact", title=_say("¿Qué se rompe si cambio ", c("__stem"), "?"), headline=headline, trust=trust.graph("Calculado sobre los imports del proyecto"), challenge=_impact_doubts(c("__stem"), c("tests"), c("coverage"), c("capped")), follow=("tests", "hidden"), rows=listed).alias("a"))


def _hidden(facts: Facts, trust: _Trust) -> DataFrame:
    if not facts.commits or facts.pairs is None:
        return _nothing(facts).select(_no_data("hidden", "Sin historial git no se puede medir.").alias("a"))
    c = F.col
    stem = lambda x: text.stem(c(x).cast("string"))
    pairs = facts.pairs.filter("hidden").withColumns({"__a": stem("a"), "__b": stem("b")})
    said = _say("↔ ", c("b"), " · ", c("count"), " commits juntos · confianza ", _pct(c("conf_ab")), "/", _pct(c("conf_ba")), " · lift ", _plain(c("lift")))
    top = _top(pairs, [-c("count") * c("strength"), c("a"), c("b")], 6, "a", said, "oculto", "__a", "__b", "count", "strength", "lift")
    one = c("first")
    none = _answer("hidden", headline="No hay pares que cambien juntos de forma recurrente sin estar conectados por imports.", trust=trust.history(F.lit(0), "Sin pares"), challenge=_texts("Con poco historial es normal no ver acoplamiento oculto: aún no hay suficientes commits."), follow=("risk",))
    found = _answer(
        "hidden",
        headline=_say(c("n"), " ", _plural(c("n"), "par", "pares"), " cambian juntos sin importarse. El más fuerte: ", one["__a"], " ↔ ", one["__b"], " (", one["count"], " commits, ", _pct(one["strength"]), ")."),
        trust=trust.history(one["count"], "Co-cambio observado"),
        challenge=_texts(
            "Cambiar juntos puede ser coincidencia de commits grandes (refactors masivos) en vez de dependencia real.",
            _say("Lift ", _plain(one["lift"]), ": valores cercanos a 1 sugieren que el par cambia junto por azar dada su frecuencia individual."),
            "Revisa el diff de los commits compartidos antes de crear una dependencia explícita.",
        ),
        follow=("dup", "impact"), rows=c("rows"),
    )
    return top.select(F.when(c("n") == 0, none).otherwise(found).alias("a"))


def _dup(facts: Facts, trust: _Trust) -> DataFrame:
    if facts.groups is None:
        return _nothing(facts).select(_no_data("dup", "La detección de duplicados no se ejecutó.").alias("a"))
    c = F.col
    groups = facts.groups.filter("not test")
    total = groups.agg(F.count("*").alias("all"), F.coalesce(F.bool_or("warned"), F.lit(False)).alias("warned"))
    said = _say(c("name"), " · ", c("copies"), " copias en ", F.array_join("files", ", "), " · ", c("sev"), " · puntaje ", c("score"))
    top = _top(groups, [-c("score"), c("group")], 5, "file", said, c("sev"), "name", "file", "copies", "lines", "sev", "co_count").join(total)
    one = c("first")
    none = _answer("dup", headline="No se detectó duplicación relevante.", trust=("media", "La detección cubre solo JavaScript/TypeScript."), challenge=_texts("Los demás lenguajes del proyecto no se analizan para duplicados todavía."), follow=("risk",))
    name = F.when(one["name"] == "(anónima)", _say("una función anónima de ", F.coalesce(one["file"].cast("string"), F.lit("?")))).otherwise(one["name"])
    found = _answer(
        "dup",
        headline=_say(c("all"), " ", _plural(c("all"), "grupo", "grupos"), " de duplicación. Peor: ", name, " (", one["copies"], " copias de ", one["lines"], " líneas, ", one["sev"], "; han cambiado juntas ", one["co_count"], " veces)."),
        trust=trust.history(F.coalesce(one["co_count"], F.lit(0)), "El costo se infiere del co-cambio de las copias"),
        challenge=_texts(
            "“Costosa” = las copias han cambiado juntas; “latente” = parecidas pero cambian por separado y podrían divergir a propósito.",
            "Dos funciones parecidas pueden ser distintas por dominio; extraer una abstracción puede acoplar cosas que evolucionan distinto.",
            F.when(c("warned"), "Alguna sugerencia de extracción tiene advertencias (p. ej. dependencia circular): léelas antes de extraer."),
        ),
        follow=("hidden", "risk"), rows=c("rows"),
    )
    return top.select(F.when(c("n") == 0, none).otherwise(found).alias("a"))


def _tests(facts: Facts, trust: _Trust) -> DataFrame:
    c = F.col
    files = facts.files.filter("not skipped and coverage = 'ninguna' and role <> 'orphan'").withColumn("__stem", text.stem(c("id").cast("string")))
    top = _top(files, [-c("score")], 6, "id", _say("riesgo ", c("score"), " · ", c("fan_in"), " dependientes · ", F.coalesce("c90", F.lit(0)), " cambios/90 d"), "sin pruebas", "__stem", "score", "fan_in")
    one = c("first")
    none = _answer("tests", headline="Todo archivo relevante tiene alguna prueba (directa o indirecta).", trust=trust.graph("Cobertura por imports de pruebas"), challenge=_texts("Cobertura “indirecta” significa que una prueba lo importa por otro archivo, no que lo ejercite."), follow=("risk",))
    found = _answer("tests", headline=_say(c("n"), " archivos relevantes sin pruebas. El más delicado: ", one["__stem"], " (riesgo ", one["score"], ", ", one["fan_in"], " dependientes)."), trust=trust.graph("La cobertura se infiere de qué archivos importan las pruebas, no de ejecutarlas"), challenge=_texts("No mide cobertura de líneas: un archivo “con prueba directa” puede estar poco probado.", "Puede haber pruebas end-to-end que lo ejerciten sin importarlo."), follow=("risk", "impact"), rows=c("rows"))
    return top.select(F.when(c("n") == 0, none).otherwise(found).alias("a"))


def _owner(facts: Facts, trust: _Trust) -> DataFrame:
    if not facts.commits:
        return _nothing(facts).select(_no_data("owner", "Sin historial git no hay autores.").alias("a"))
    c = F.col
    files = facts.files.filter("not skipped and sole_owner").withColumn("__stem", text.stem(c("id").cast("string")))
    top = _top(files, [-c("score")], 6, "id", _say(c("owner"), " · ", _pct(c("owner_share")), " de ", c("commits"), " commits"), "propietario único", "__stem", "owner", "commits")
    one = c("first")
    found = _say(c("n"), "+ archivos dependen de una sola persona. El de más riesgo: ", one["__stem"], " (", one["owner"], ").")
    return top.select(_answer("owner", headline=F.when(c("n") == 0, "No hay archivos con propietario único y suficiente historial.").otherwise(found), trust=trust.history(F.coalesce(one["commits"], F.lit(0)), "Autoría por commits"), challenge=_texts("Un equipo pequeño hará que casi todo tenga propietario único: compara contra el tamaño del equipo.", "Los commits no capturan quién revisa o diseña."), follow=("risk", "impact"), rows=c("rows")).alias("a"))


def _owner_of(facts: Facts, trust: _Trust, asked: DataFrame) -> DataFrame:
    """Of files with a history; the others get the answer of the whole."""
    c = F.col
    listed = facts.shares.join(asked, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(F.lit(None).cast("string").alias("id"), _say(c("author"), " · ", c("commits"), " commits · ", _pct(c("share"))).alias("text"), F.lit(None).cast("string").alias("tag")).alias("row")))).alias("l"))
    files = facts.files.filter("commits > 0").select("id", "owner", "owner_share", "commits", "bus_factor").join(listed, "id").withColumn("__stem", text.stem(c("id").cast("string")))
    headline = _say(F.coalesce("owner", F.lit("Nadie")), " concentra ", _pct(c("owner_share")), " de los ", c("commits"), " commits; factor autobús ", c("bus_factor"), ".")
    return files.select(c("id").alias("file"), _answer("owner", title=_say("¿Quién conoce ", c("__stem"), "?"), headline=headline, trust=trust.history(c("commits"), "Autoría por commits"), challenge=_texts("Commits no miden conocimiento: alguien puede haber revisado o diseñado sin firmar los commits.", "Renombres, formateos masivos o squash pueden atribuir mal."), follow=("risk",), rows=F.transform("l", lambda x: x["row"])).alias("a"))


def _dead(facts: Facts, trust: _Trust) -> DataFrame:
    c = F.col
    own = facts.files.filter("not skipped")
    last = F.coalesce(F.date_format("last", "yyyy-MM-dd"), F.lit("?"))
    orphans = _top(own.filter("role = 'orphan'"), [], 6, "id", _say("nadie lo importa · ", c("lines"), " líneas · último cambio ", last), "huérfano").select(c("n").alias("n1"), c("rows").alias("r1"))
    symbols = facts.symbols if facts.symbols is not None else own.limit(0).select(c("id").alias("file"), F.lit("").alias("name"), F.lit(0).alias("total"))
    unused = symbols.filter("total = 0").join(own.select(c("id").alias("file")), "file", "left_semi")
    both = orphans.join(_top(unused, [c("file"), c("name")], 4, "file", _say("símbolo ", c("name"), " sin usos"), "sin uso"))
    none = _answer("dead", headline="No hay archivos huérfanos ni símbolos exportados sin uso.", trust=trust.graph("Basado en imports"), challenge=_texts("Esto solo descarta lo que el grafo ve usado."), follow=("risk",))
    found = _answer(
        "dead",
        headline=_say(c("n1"), " ", _plural(c("n1"), "archivo huérfano", "archivos huérfanos"), " y ", c("n"), " ", _plural(c("n"), "símbolo", "símbolos"), " exportados sin uso."),
        trust=trust.graph("Un archivo “huérfano” es uno que nadie importa"),
        challenge=_texts("Puede ser un punto de entrada (script, CLI, tarea programada) que se ejecuta desde fuera.", "Puede cargarse por nombre en tiempo de ejecución (plugins, rutas, DI), invisible al grafo.", "Antes de borrar: busca el nombre en configuración y despliegue, y confirma en git que nadie lo toca."),
        follow=("hidden",), rows=F.concat("r1", "rows"),
    )
    return both.select(F.when((c("n1") == 0) & (c("n") == 0), none).otherwise(found).alias("a"))


def _cycles(facts: Facts, trust: _Trust) -> DataFrame:
    c = F.col
    level = trust.graph("Componentes fuertemente conectados")
    none = _answer("cycles", headline="No hay ciclos entre archivos de producción.", trust=level, challenge=_texts("No ve ciclos a través de llamadas dinámicas."), follow=("risk",))
    if facts.cycles is None:
        return _nothing(facts).select(none.alias("a"))
    sizes = facts.cycles.groupBy("component").agg(F.count("*").alias("size"))
    total = sizes.agg(F.count("*").alias("n"), F.max("size").alias("most"))
    # the first four cycles by their component, four files each
    first = facts.cycles.join(F.broadcast(sizes.select("component").orderBy("component").limit(4)), "component").groupBy("component").agg(F.slice(F.array_sort(F.collect_list("node")), 1, 4).alias("nodes"))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("component", "nodes"))), lambda x: F.transform(x["nodes"], lambda n: F.struct(n.cast("string").alias("id"), F.lit("participa en un ciclo").alias("text"), F.lit("ciclo").alias("tag")))))
    found = _answer("cycles", headline=_say(c("n"), " ", _plural(c("n"), "ciclo", "ciclos"), "; el mayor involucra ", c("most"), " archivos."), trust=level, challenge=_texts("Un ciclo de imports solo falla si hay inicialización circular; muchos lenguajes lo toleran.", "Romperlo suele requerir extraer un tercer módulo o invertir la dependencia con eventos."), follow=("risk", "impact"), rows=c("rows"))
    return total.join(first.agg(listed.alias("rows"))).select(F.when(c("n") == 0, none).otherwise(found).alias("a"))


def _generated(facts: Facts, trust: _Trust) -> DataFrame:
    c = F.col
    marked = facts.files.filter("gen is not null")
    top = _top(marked, [], 10, "id", _say(c("lines"), " líneas · ", c("gen")), "generado").join(marked.agg(F.count("*").alias("all")))
    none = _answer("generated", headline="No se detectó código generado (marcas @generated, nombres .g.cs / .pb.go / .min.js…).", trust=("media", "Se detecta por marcas en la cabecera y por el nombre; un generador sin marca pasa desapercibido."), challenge=_texts("Un archivo generado sin cabecera ni nombre típico no se reconoce."), follow=("risk", "dead"))
    found = _answer("generated", headline=_say(c("all"), " ", _plural(c("all"), "archivo generado", "archivos generados"), ": se excluyen del riesgo y de los rankings."), trust=("alta", "La marca o el nombre del archivo lo declara."), challenge=_texts("Si alguien edita a mano un archivo generado, el siguiente build lo sobrescribe.", "Excluirlos del riesgo oculta que muchos módulos dependan de ellos: mira sus dependientes."), follow=("risk", "impact"), rows=c("rows"))
    return top.select(F.when(c("n") == 0, none).otherwise(found).alias("a"))


def _dynamic(facts: Facts, trust: _Trust) -> DataFrame:
    c = F.col
    files = facts.files.filter("not is_test and size(dyn) > 0")
    what = F.array_join(F.array_distinct(F.transform("dyn", lambda u: u["what"])), ", ")
    top = _top(files, [-F.size("dyn")], 8, "id", _say(what, " (línea ", F.get("dyn", F.lit(0))["line"], ")"), "reflexión")
    none = _answer("dynamic", headline="No se detectó reflexión ni carga dinámica de código.", trust=trust.graph("Búsqueda de patrones conocidos"), challenge=_texts("Solo se buscan patrones habituales por lenguaje; la inyección de dependencias por convención no se ve."), follow=("impact", "dead"))
    found = _answer("dynamic", headline=_say(c("n"), " ", _plural(c("n"), "archivo usa", "archivos usan"), " reflexión o carga dinámica: sus dependencias reales pueden ser más de las dibujadas."), trust=("media", "Detectado por patrones; no se sabe a qué apunta cada uso."), challenge=_texts("Un uso de reflexión puede ser inofensivo (leer un atributo) o cargar medio sistema.", "El impacto y el código muerto calculados para estos archivos son una cota inferior."), follow=("impact", "dead"), rows=c("rows"))
    return top.select(F.when(c("n") == 0, none).otherwise(found).alias("a"))


def _recursion(facts: Facts, trust: _Trust) -> DataFrame:
    c = F.col
    none = _answer("recursion", headline="No se detectó recursión dentro de un mismo archivo.", trust=("media", "Grafo de llamadas por nombre dentro de cada archivo; no ve recursión entre archivos ni por callbacks."), challenge=_texts("Las llamadas se emparejan por nombre: una función homónima de otra clase puede dar falsos positivos."), follow=("cycles",))
    if facts.recursion is None:
        return _nothing(facts).select(none.alias("a"))
    eight = facts.recursion.select("id").distinct().orderBy("id").limit(8)
    rows = facts.recursion.join(F.broadcast(eight), "id", "left_semi")
    said = F.when(c("kind") == "mutua", F.array_join("names", " ⇄ ")).otherwise(_say(F.get("names", F.lit(0)), "() se llama a sí misma"))
    top = _top(rows, [c("id"), c("kind"), c("line")], 12, "id", _say(said, " · línea ", c("line")), c("kind")).join(eight.agg(F.count("*").alias("files")))
    found = _answer("recursion", headline=_say(c("files"), " ", _plural(c("files"), "archivo contiene", "archivos contienen"), " funciones recursivas."), trust=("media", "Coincidencia de nombres dentro del archivo, sin resolver tipos."), challenge=_texts("Comprueba que existe un caso base y qué profundidad alcanza con entradas grandes (desbordamiento de pila).", "Puede ser un falso positivo si el método llamado es de otro objeto con el mismo nombre."), follow=("cycles", "risk"), rows=c("rows"))
    return top.select(F.when(c("n") == 0, none).otherwise(found).alias("a"))


def _since(facts: Facts, trust: _Trust) -> DataFrame:
    c = F.col
    if facts.changes is None:
        return _nothing(facts).select(_answer("since", headline="Aún no hay una vista anterior con la que comparar: esta visita queda guardada como referencia.", trust=("baja", "Es la primera vez que se abre este proyecto en este navegador."), follow=("health",)).alias("a"))
    kinds = {"riesgo": ("sube", _say("riesgo ", c("from"), " → ", c("to"))), "añadido": ("nuevo", F.lit("archivo nuevo")), "eliminado": ("borrado", _say(c("id"), " ya no existe")), "estado": ("estado", _say("estado ", c("from"), " → ", c("to")))}
    pick = lambda of: F.coalesce(*[F.when(c("change") == k, of(i, v)) for i, (k, v) in enumerate(kinds.items())])
    rise = F.when(c("change") == "riesgo", c("from").cast("long") - c("to").cast("long"))
    named = F.when(c("change") != "eliminado", c("id").cast("string"))
    top = _top(facts.changes, [pick(lambda i, _: F.lit(i)), rise, c("id")], 14, named, pick(lambda _, v: v[1]), pick(lambda _, v: F.lit(v[0])))
    n = {k: F.count_if(c("change") == k).alias(k) for k in kinds}
    counts = top.join(facts.changes.agg(*n.values()))
    headline = _say(f"Desde {facts.when}: ", c("añadido"), " nuevos, ", c("eliminado"), " borrados, ", c("riesgo"), " con más riesgo, ", c("estado"), " cambiaron de estado.")
    return counts.select(_answer("since", headline=headline, trust=("alta", "Comparación exacta entre dos fotos guardadas en este navegador."), challenge=_texts("Solo compara con la última visita guardada en este navegador, no con una versión concreta del repositorio."), follow=("risk", "health"), rows=c("rows")).alias("a"))


def _health(facts: Facts, trust: _Trust) -> DataFrame:
    if facts.health is None or facts.findings is None:
        return _nothing(facts).select(_no_data("health", "No hay índice de salud.").alias("a"))
    c = F.col
    grave = _top(facts.findings.filter("sev = 'alta'"), [c("place"), c("title")], 6, "id", c("title"), "alta")
    counts = facts.findings.agg(F.count_if(c("sev") == "alta").alias("grave"), F.count("*").alias("all"))
    headline = _say("Salud ", c("score"), "/100 (", c("grade"), ") con ", c("grave"), " ", _plural(c("grave"), "hallazgo", "hallazgos"), " de atención alta y ", c("all"), " en total.")
    found = _answer("health", headline=headline, trust=trust.history(F.lit(facts.commits), "La salud combina estructura e historial"), challenge=_texts("La nota agrega señales con pesos fijados por la herramienta: úsala para comparar contra sí mismo en el tiempo, no contra otros proyectos.", "Un proyecto joven o pequeño tiene poca evidencia: la nota se mueve mucho con pocos cambios."), follow=("risk", "hidden", "dead"), rows=c("rows"))
    return grave.join(counts).join(facts.health.select("score", "grade")).select(found.alias("a"))


_WHOLE = {"risk": _risk, "impact": _impact, "hidden": _hidden, "dup": _dup, "tests": _tests, "owner": _owner, "dead": _dead, "cycles": _cycles, "generated": _generated, "dynamic": _dynamic, "recursion": _recursion, "since": _since, "health": _health}


def catalogue(facts: Facts) -> DataFrame:
    """The answers about the whole: (asked, a), thirteen rows of bounded size, and one for what isn't understood.

    ``asked`` is the intent; the answer's own intent is ``none`` where nothing was measured.
    """
    trust = _Trust(facts)
    rows = [answer(facts, trust).select(F.lit(intent).alias("asked"), "a") for intent, answer in _WHOLE.items()]
    lost = _answer("risk", title="", headline=MISUNDERSTOOD, trust=("baja", "Sin coincidencia."), follow=tuple(_WHOLE)).withField("intent", F.lit("none"))
    rows.append(_nothing(facts).select(F.lit("none").alias("asked"), lost.alias("a")))
    return reduce(DataFrame.unionByName, rows)


def ask(questions: DataFrame, facts: Facts, *, question: str = "question", selected: str | None = None) -> DataFrame:
    """``questions`` with the answer to each: intent, file, title, headline, level, why, challenge, follow, rows.

    The intent is the first whose words the question has, else impact if it names a file, else ``none``.
    Impact and owner answer for the file that a question names, or that its column ``selected`` has;
    files with an answer of their own are those asked for, each once.  The thirteen answers about the whole are
    broadcast; those about files are joined by file, so a question that many ask costs one answer.  A null question isn't understood.
    """
    trust = _Trust(facts)
    names = facts.files.select(F.col("id").cast("string").alias("id"))
    told = named_file(questions, question, names)
    intent = text.intent(F.coalesce(F.col(question), F.lit("")), F.col("file").isNotNull())
    told = told.withColumn("__asked", intent)
    chosen = F.coalesce("file", F.col(selected).cast("string")) if selected else F.col("file")
    told = cut(told.withColumn("file", F.when(F.col("__asked").isin("owner", "impact"), chosen).otherwise(F.col("file"))))
    asked = told.filter(F.col("__asked").isin("owner", "impact") & F.col("file").isNotNull()).select("__asked", "file").distinct()
    id_type = facts.files.schema["id"].dataType
    of = lambda k: asked.filter(F.col("__asked") == k).select(F.col("file").cast(id_type).alias("id"))
    own = []
    if facts.impacts is not None:
        own.append(_impact_of(facts, trust, of("impact")).select(F.lit("impact").alias("__asked"), F.col("file").cast("string").alias("file"), F.col("a").alias("own")))
    if facts.commits and facts.shares is not None:
        own.append(_owner_of(facts, trust, of("owner")).select(F.lit("owner").alias("__asked"), F.col("file").cast("string").alias("file"), F.col("a").alias("own")))
    whole = catalogue(facts).select(F.col("asked").alias("__asked"), "a")
    # a question is dealt by its file before it has an answer about the whole, which is longer than the question
    met = told.join(reduce(DataFrame.unionByName, own), ["__asked", "file"], "left") if own else told.withColumn("own", F.lit(None).cast(whole.schema["a"].dataType))
    met = met.join(F.broadcast(whole), "__asked", "left")
    answer = F.coalesce("own", "a")
    kept = [c for c in questions.columns if c not in ("file", "intent", "title", "headline", "level", "why", "challenge", "follow", "rows")]
    fields = ("intent", "headline", "level", "why", "challenge", "follow", "rows")
    lost = (F.col("__asked") == "none") & F.col("own").isNull()
    return met.select(*kept, "file", F.when(lost, F.coalesce(F.col(question), F.lit(""))).otherwise(answer["title"]).alias("title"), *[answer[f].alias(f) for f in fields])


def evidence(question: str) -> Column:
    """An answer as one text, from the columns that ``ask`` adds: question, finding, evidence, confidence and known limits."""
    lines = F.transform("rows", lambda r: _say("- ", F.when(F.coalesce(r["id"], F.lit("")) != "", _say(r["id"], ": ")).otherwise(""), r["text"]))
    doubts = F.transform("challenge", lambda x: _say("- ", x))
    asked = F.when(F.coalesce(question, F.lit("")) != "", F.col(question)).otherwise(F.col("title"))
    return F.array_join(F.concat(F.array(_say("PREGUNTA: ", asked), _say("HALLAZGO: ", F.col("headline")), F.lit("EVIDENCIA:")), lines, F.array(_say("CONFIANZA: ", F.col("level"), " — ", F.col("why")), F.lit("LÍMITES CONOCIDOS:")), doubts), "\n")


def of_world(w, *, changes: DataFrame | None = None, when: str = "", groups: DataFrame | None = None) -> Facts:
    """The facts of a repository's world; the numbers that decide how far to trust them are counted at once."""
    counted = w.files.agg(F.count_if(~F.col("is_test") & F.col("dyn").isNotNull()).alias("dyn"), F.count_if(F.col("lang").isin(*REFLECTIVE)).alias("reflective")).first()
    dynamic = w.edges.filter("kind = 'dynamic'").count()
    commits = 0 if w.timeline is None else w.timeline.count()
    # a finding is one row here, by the first of its files
    titled = w.told.join(w.about.groupBy("id").agg(F.min("file").alias("file")), "id", "left").select("sev", F.col("file").alias("id"), "title", "place")
    tested = w.tested.select(F.col("id").alias("file"), "test")
    if groups is None and w.groups is not None:
        groups = group_facts(w.groups, w.members)
    return Facts(w.files, w.impact, w.pairs, groups, w.shares, w.symbols, w.cycles, w.recursion, changes, titled, w.health, tested, commits, dynamic, counted["dyn"], counted["reflective"] > 0, when)


def group_facts(groups: DataFrame, members: DataFrame, most: int = 100) -> DataFrame:
    """What ``Facts`` has of groups of copies, from a world's; an answer names ``most`` files of a group."""
    each = members.select("group", F.col("file").alias("f")).distinct()
    place = F.row_number().over(Window.partitionBy("group").orderBy("f"))
    named = each.withColumn("p", place).filter(F.col("p") <= most).groupBy("group").agg(F.array_sort(F.collect_list("f")).alias("files"), F.min("f").alias("file"))
    told = groups.select("group", F.coalesce("name", F.lit("(anónima)")).alias("name"), "copies", "lines", "sev", "score", "co_count", "test", (F.size(F.coalesce("warn", F.array().cast("array<string>"))) > 0).alias("warned"))
    return told.join(named, "group")


def suggest(facts: Facts, selected: DataFrame) -> DataFrame:
    """(id, place, intent, text): the first nine questions for each selected file (id; null: none selected).

    For a file the first two are about it, the second only where there is a history.
    """
    whole = [(k, t) for k, t in TITLES.items()]
    stem = text.stem(F.col("id").cast("string"))
    own = [F.struct(F.lit("impact").alias("intent"), _say("¿Qué se rompe si cambio ", stem, "?").alias("text"))]
    own += [F.struct(F.lit("owner").alias("intent"), _say("¿Quién conoce ", stem, "?").alias("text"))] if facts.commits else []
    rest = lambda skip: F.array(*[F.struct(F.lit(k).alias("intent"), F.lit(t).alias("text")) for k, t in whole if k != skip])
    known = facts.files.select(F.col("id").cast("string").alias("known")).join(selected.select(F.col("id").cast("string").alias("known")), "known", "left_semi")
    told = selected.join(known, F.col("id").cast("string") == F.col("known"), "left")
    listed = F.when(F.col("known").isNotNull(), F.concat(F.array(*own), rest("impact"))).otherwise(rest(None))
    return told.select("id", F.posexplode(F.slice(listed, 1, 9)).alias("p", "q")).select("id", (F.col("p") + 1).alias("place"), "q.intent", "q.text")
