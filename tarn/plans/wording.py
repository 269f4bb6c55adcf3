"""Findings in words: what was found, in detail, and what to do about it, a row for each, with the files that each is about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import level
from ..operators.history import days_ago
from ..operators.measures import numbered
from .insights import SEVERITIES

#: Kinds in the order in which they are told.
KINDS = ("ciclo", "hotspot", "pruebas", "acoplamiento", "dueño", "huérfano", "exports", "generado", "reflexión", "recursión", "trabajo", "duplicación", "latente", "constante", "homónimo")
#: Names that a sentence lists at most; the files of a finding are rows and all there.
NAMED = 100


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def many(n: Column, one: str, more: str) -> Column:
    return F.when(n == 1, one).otherwise(more)


def short(path: Column) -> Column:
    """A file's folder and its name without the ending."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -2), F.lit("/"), text.stem(path))).otherwise(text.stem(path))


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def percent(x: Column) -> Column:
    return say(F.floor(x * 100 + 0.5).cast("long"), "%")


def listed(rows: DataFrame, words: Column, order: list[Column], most: int, sep: str = ", ", by: str | None = None) -> DataFrame:
    """(n, words): how many rows there are, and the first ``most`` by ``order`` in one text; a row for each value of ``by``, if given."""
    numbers = [o.alias(f"o{i}") for i, o in enumerate(order)]
    shown = rows.select(*([by] if by else []), F.struct(*numbers, words.alias("words")).alias("w"))
    if by is None:
        total = rows.agg(F.count("*").alias("n"))
        first = shown.orderBy("w").limit(most).agg(F.collect_list("w").alias("w"))
        both = total.crossJoin(first)
    else:
        total = rows.groupBy(by).agg(F.count("*").alias("n"))
        first = shown.withColumn("p", F.row_number().over(Window.partitionBy(by).orderBy("w"))).filter(F.col("p") <= most).groupBy(by).agg(F.collect_list("w").alias("w"))
        both = total.join(first, by)
    said = F.array_join(F.transform(F.array_sort("w"), lambda x: x["words"]), sep)
    return both.filter("n > 0").select(*([by] if by else []), "n", said.alias("words"))


def _told(rows: DataFrame, kind: str, sev: Column | str, title: Column, detail: Column, action: Column | str | None, key: Column | str = "", pos: Column | int = 0) -> DataFrame:
    lit = lambda x: F.lit(x) if x is None or isinstance(x, (str, int)) else x
    return rows.select(F.lit(kind).alias("kind"), lit(key).cast("string").alias("key"), lit(pos).cast("double").alias("pos"), lit(sev).alias("sev"), title.alias("title"), detail.alias("detail"), lit(action).cast("string").alias("action"))


def _about(rows: DataFrame, kind: str, file: str = "id", key: str | None = None) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), (F.col(key) if key else F.lit("")).cast("string").alias("key"), F.col(file).cast("string").alias("file")).distinct()


def told(
    files: DataFrame, *, cycles: DataFrame | None = None, edges: DataFrame | None = None, pairs: DataFrame | None = None, symbols: DataFrame | None = None, recursion: DataFrame | None = None,
    groups: DataFrame | None = None, members: DataFrame | None = None, constants: DataFrame | None = None, homonyms: DataFrame | None = None, now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, about): (id, kind, sev, title, detail, action) and (id, file).

    ``files`` are a world's scored files, ``edges`` (source, target, kind, refs, symbols) its edges without those of tests,
    ``groups`` with suggest and warn (``duplicates.extracted``).  Findings are in order of gravity, then of KINDS, then of how
    much they weigh; ids are i0 and up.  Four hotspots, hidden pairs and literals, five groups and two homonyms are told;
    a sentence names NAMED files at most.
    """
    c = F.col
    own = files.filter(~c("skipped"))
    name = short(c("id"))
    out: list[DataFrame] = []
    about: list[DataFrame] = []

    def whole(rows: DataFrame, kind: str, words: Column, order: list[Column], most: int, sep: str, title: Column, detail: Column, action: str | None, sev: str = "info") -> None:
        """One finding about all ``rows``."""
        out.append(_told(listed(rows, words, order, most, sep), kind, sev, title, detail, action))
        about.append(_about(rows, kind))

    if cycles is not None and edges is not None:
        ring = listed(cycles, short(c("node")), [c("node")], NAMED, " y ", "component")
        side = lambda x: cycles.select(c("node").alias(x), c("component").alias(f"c_{x}"))
        inner = edges.filter("kind not in ('relation', 'dynamic')").join(side("source"), "source").join(side("target"), "target").filter("c_source = c_target")
        weakest = inner.groupBy(c("c_source").alias("component")).agg(F.min(F.struct("refs", F.size("symbols").alias("n"), "source", "target", "symbols")).alias("w"))
        named_bus = own.filter(c("id").rlike(r"(?i)(^|/)(bus|events?)\b") | base(c("id")).rlike("(?i)bus|event")).agg(F.min("id").alias("bus"))
        rows = ring.join(weakest, "component", "left").crossJoin(F.broadcast(named_bus))
        found, symbol_names = c("w").isNotNull(), F.array_join("w.symbols", ", ")
        detail = say("Se importan entre sí", F.when(found, say(". La dependencia más débil es ", short(c("w.source")), " → ", short(c("w.target")), " (", symbol_names, ", ", c("w.refs"), many(c("w.refs"), " uso)", " usos)"))), ".")
        action = F.when(found, say("Mueve ", symbol_names, " a un módulo aparte", F.when(c("bus").isNotNull(), say(" o avisa con un evento por ", base(c("bus")), " en lugar de importar")), ".")).otherwise("Extrae lo compartido a un tercer módulo.")
        out.append(_told(rows, "ciclo", "alta", say("Ciclo entre ", c("words")), detail, action, c("component")))
        about.append(_about(cycles, "ciclo", "node", "component"))

    has_flag = lambda f: F.array_contains("flags", f)
    is_tested = c("coverage") == "directa"
    hot = own.filter(has_flag("hotspot")).orderBy(c("score").desc(), "id").limit(4)
    bits = F.concat_ws(" · ", say(c("c90"), " cambios en 90 días"), say("lo importan ", c("fan_in"), " archivos"), F.when(is_tested, "tiene pruebas").otherwise("sin pruebas"), F.when(c("bus_factor") == 1, say("solo lo toca ", c("owner"))).otherwise(say(c("bus_factor"), " autores principales")))
    careful = F.when(is_tested, "Revisa si conviene dividirlo: cada cambio aquí puede afectar a sus dependientes.").otherwise("Agrega pruebas antes del próximo cambio; es el lugar donde más puede romperse algo.")
    out.append(_told(hot, "hotspot", F.when(level(c("score")) == "alto", "alta").otherwise("media"), say(name, " cambia mucho y otros dependen de él"), say(bits, "."), careful, c("id"), -c("score")))
    about.append(_about(hot, "hotspot", key="id"))

    bare = own.filter((c("fan_in") >= 2) & (c("coverage") == "ninguna") & ~has_flag("hotspot"))
    whole(bare, "pruebas", say(name, " (", c("fan_in"), ")"), [c("id")], NAMED, ", ", say(c("n"), many(c("n"), " módulo muy usado", " módulos muy usados"), " sin ninguna prueba"), say(c("words"), ". Ninguna prueba los toca, ni directa ni indirectamente."), "Empieza por el que más archivos importan.", "media")

    if pairs is not None:
        strong = pairs.filter("hidden").orderBy((c("count") * c("strength")).desc(), "a", "b").limit(4).withColumn("key", F.concat_ws("|", "a", "b"))
        detail = say("Aparecieron juntos en ", c("count"), " commits (", percent(c("strength")), " de los cambios del menos tocado) pero no hay ningún import entre ellos.")
        out.append(_told(strong, "acoplamiento", F.when(c("strength") >= 0.8, "alta").otherwise("media"), say(short(c("a")), " y ", short(c("b")), " cambian juntos sin importarse"), detail, "Hay una regla compartida que no está escrita en el código. Considera una constante o un módulo común.", c("key"), -c("count") * c("strength")))
        about.append(_about(strong.select("key", F.explode(F.array("a", "b")).alias("id")), "acoplamiento", key="key"))

    lone = own.filter(has_flag("propietario-único") & ~has_flag("hotspot") & (c("commits") >= 4) & (c("loc") >= 40))
    out.append(_told(lone, "dueño", "media", say("Solo ", c("owner"), " conoce ", name), say(c("commits"), " commits y ", percent(c("owner_share")), " de ellos del mismo autor."), "Pide una revisión cruzada o documenta su comportamiento.", c("id")))
    about.append(_about(lone, "dueño", key="id"))

    orphan = own.filter("role = 'orphan'")
    idle = say(" y no cambia desde hace ", F.floor(days_ago(c("last"), now) + 0.5).cast("long"), " días") if now is not None else F.lit("")
    out.append(_told(orphan, "huérfano", "info", say(name, " no está conectado"), say("Nadie lo importa", F.when(c("last").isNotNull(), idle), "."), "Candidato a eliminar si no se usa fuera del código (scripts, configuración).", c("id")))
    about.append(_about(orphan, "huérfano", key="id"))

    if symbols is not None:
        shown = own.filter("role not in ('entry', 'orphan')").select(c("id").alias("file"))
        outside = files.filter("not is_test").select(c("id").alias("file"))
        dead = symbols.filter("total = 0 and users = 0").join(shown, "file", "left_semi").withColumnRenamed("file", "id")
        public = symbols.join(outside, "file", "left_semi").agg(F.count("*").alias("public"))
        rows = listed(dead, say(text.stem(c("id")), ".", c("name")), [c("id"), c("line"), c("name")], 6).crossJoin(public)
        library = c("n") > 0.3 * c("public")
        title = F.when(library, say(c("n"), " exports no se usan dentro del proyecto (parece una librería: pueden ser su API pública)")).otherwise(say(c("n"), many(c("n"), " export sin uso", " exports sin uso")))
        out.append(_told(rows, "exports", "info", title, say(c("words"), F.when(c("n") > 6, "…"), "."), "Quita el export o bórralo si ya no hace falta."))
        about.append(_about(dead, "exports"))

    plural = many(c("n"), " archivo", " archivos")
    whole(files.filter("gen is not null"), "generado", say(name, ": ", c("gen")), [c("id")], 4, " · ", say(c("n"), plural, many(c("n"), " generado", " generados"), " (no se editan a mano)"), say(c("words"), "."), "Se excluyen del riesgo y de los rankings. Cambia el generador o su plantilla, no el archivo.")
    kinds = F.array_join(F.array_distinct(F.transform("dyn", lambda d: d["what"])), ", ")
    whole(own.filter("dynamic"), "reflexión", say(name, " (", kinds, ")"), [c("id")], 4, " · ", say(c("n"), plural, many(c("n"), " usa", " usan"), " reflexión o carga dinámica"), say(c("words"), "."), "El grafo no ve esas dependencias: el impacto real puede ser mayor al mostrado.")
    if recursion is not None:
        called = F.when(c("kind") == "mutua", F.array_join("names", "⇄")).otherwise(say(F.element_at("names", 1), "()"))
        rec = recursion.join(own.select("id"), "id", "left_semi")
        per = listed(rec, called, [c("line"), called], NAMED, ", ", "id").withColumnRenamed("words", "calls")
        whole(per.drop("n"), "recursión", say(name, ": ", c("calls")), [c("id")], 4, " · ", say(c("n"), plural, " con funciones recursivas"), say(c("words"), "."), "Verifica el caso base y la profundidad máxima con entradas grandes.")
    wip = files.filter(has_flag("sin-commit") & (~c("skipped") | c("is_test")))
    whole(wip, "trabajo", say(text.stem(c("id")), F.when(c("status") == "untracked", " (nuevo)").otherwise(" (modificado)")), [c("is_test"), c("id")], NAMED, ", ", say(c("n"), plural, " con cambios sin commit"), say(c("words"), "."), None)

    if groups is not None and members is not None:
        dear = groups.filter("sev = 'costosa'").orderBy(c("score").desc(), "group").limit(5)
        called = F.coalesce("name", F.lit("(anónima)"))
        kind = say(c("type"), F.when(c("type") == "similar", say(", ", percent(c("sim")), " parecidas")))
        who = F.when(F.size("owners") > 1, say("; las tocan ", F.array_join("owners", " y ")))
        detail = say(c("copies"), " copias de ~", c("lines"), " líneas (", kind, "). Aparecieron juntas en ", c("co_count"), " commits (", percent(c("co_rate")), " de los cambios del menos tocado)", who, ".")
        action = say(c("suggest"), F.when(F.size("warn") > 0, say(" Ojo: ", F.array_join("warn", "; "), ".")))
        out.append(_told(dear, "duplicación", F.when(c("score") >= 60, "alta").otherwise("media"), say(called, "() está copiada en ", c("files"), " archivos y las copias cambian juntas"), detail, action, c("group"), -c("score")))
        in_files = members.select("group", "file").distinct()
        about.append(_about(in_files.join(dear.select("group"), "group", "left_semi"), "duplicación", "file", "group"))
        latent = groups.filter("sev = 'latente'")
        words = listed(latent, say(called, "() ×", c("copies")), [-c("score"), c("group").cast("string")], 4)
        out.append(_told(words, "latente", "info", say(c("n"), many(c("n"), " grupo", " grupos"), " de código parecido que hoy no cambia junto"), say(c("words"), ". Por ahora no cuestan: se editan por separado."), "Déjalas así hasta que una tercera copia o un cambio conjunto justifique extraer."))
        about.append(_about(in_files.join(latent.select("group"), "group", "left_semi"), "latente", "file"))
    if constants is not None:
        top = constants.orderBy(c("files").desc(), c("count").desc(), "key").limit(4)
        value = F.when(c("kind") == "num", c("value")).otherwise(say('"', c("value"), '"'))
        places = F.array_join(F.transform(F.slice("at", 1, 5), lambda a: F.concat(base(a["file"]), F.lit(":"), a["line"].cast("string"))), ", ")
        action = F.when(c("existing").isNotNull(), say("Ya existe ", c("existing.name"), " en ", base(c("existing.file")), ": úsala en lugar del literal.")).otherwise("Defínela una vez con nombre y reemplaza los literales.")
        out.append(_told(top, "constante", c("sev"), say(value, " se repite ", c("count"), " veces en ", c("files"), " archivos"), say(places, F.when(F.size("at") > 5, "…"), "."), action, c("key"), -c("files") * 1e9 - c("count")))
        about.append(_about(top.select("key", F.explode("at.file").alias("id")), "constante", key="key"))
    if homonyms is not None:
        top = homonyms.select("name", "files", "units").distinct().orderBy(c("units").desc(), "name").limit(2)
        rows = homonyms.join(top.select("name"), "name", "left_semi")
        words = listed(rows, say(base(c("file")), ":", c("start")), [c("file")], NAMED, ", ", "name").join(top, "name")
        out.append(_told(words, "homónimo", "info", say(c("name"), "() existe en ", c("files"), " archivos"), say(c("words"), "."), "Comprueba si hacen lo mismo con otro nombre o si el nombre confunde.", c("name"), -c("units")))
        about.append(_about(rows, "homónimo", "file", "name"))

    rank = F.coalesce(*[F.when(c("sev") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)])
    turn = F.coalesce(*[F.when(c("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    all_ = numbered(reduce(DataFrame.unionByName, out), "place", rank, turn, c("pos"), c("key"))
    ids = all_.withColumn("id", F.concat(F.lit("i"), c("place").cast("string")))
    files_of = reduce(DataFrame.unionByName, about).join(ids.select("kind", "key", "id"), ["kind", "key"]).select("id", "file")
    shown = F.when(c("kind") == "latente", "duplicación").otherwise(c("kind"))
    return ids.select("id", "place", shown.alias("kind"), "sev", "title", "detail", "action"), files_of
