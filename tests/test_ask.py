"""Answers to questions over small facts written by hand."""

import pytest
from pyspark.sql import functions as F

from tarn.plans import ask

FILES = "id string, score int, level string, parts struct<fan_in double, churn double, cycle double, untested double, owner double, size double, dup double>, fan_in long, c90 long, commits long, coverage string, role string, lines int, last timestamp, gen string, dyn array<struct<line int, what string>>, skipped boolean, is_test boolean, owner string, owner_share double, bus_factor long, sole_owner boolean"


def file(name, score, **more):
    base = {"parts": (1.0, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0), "fan_in": 3, "c90": 2, "commits": 8, "coverage": "directa", "role": "module", "lines": 10, "last": None, "gen": None, "dyn": None, "skipped": False, "is_test": False, "owner": "Ana", "owner_share": 0.755, "bus_factor": 1, "sole_owner": False}
    base |= more
    return (name, score, "alto" if score > 54 else "bajo", *[base[k.strip().split()[0]] for k in ("parts", "fan_in", "c90", "commits", "coverage", "role", "lines", "last", "gen", "dyn", "skipped", "is_test", "owner", "owner_share", "bus_factor", "sole_owner")])


@pytest.fixture(scope="module")
def facts(spark):
    of = spark.createDataFrame
    files = of([
        file("src/pay.js", 80, parts=(0.2, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), sole_owner=True, coverage="ninguna"), file("src/cart.js", 71), file("src/old.js", 5, role="orphan", coverage="ninguna", commits=0),
        file("gen/x.pb.go", 0, gen="nombre", skipped=True), file("src/Señal.py", 40, dyn=[(4, "getattr"), (9, "getattr")]), file("test/pay.test.js", 0, skipped=True, is_test=True),
    ], FILES)
    return ask.Facts(
        files,
        of([("src/pay.js", 2, 1, 2, True, ["src/cart.js", "src/Señal.py"])], "node string, total long, direct long, depth int, capped boolean, ids array<string>"),
        of([("src/cart.js", "src/pay.js", 7, 0.875, 0.9, 0.875, 2.0, True), ("src/old.js", "src/pay.js", 2, 0.5, 0.5, 0.5, 1.25, True), ("a", "b", 9, 1.0, 1.0, 1.0, 1.0, False)], "a string, b string, count long, strength double, conf_ab double, conf_ba double, lift double, hidden boolean"),
        of([(1, "paginate", "src/pay.js", 2, 12, "costosa", 60, 5, False, ["src/pay.js", "src/cart.js"], True), (2, "t", "test/pay.test.js", 2, 9, "latente", 90, 0, True, [], False)], "`group` int, name string, file string, copies int, lines int, sev string, score int, co_count int, test boolean, files array<string>, warned boolean"),
        of([("src/pay.js", "Ana", 6, 0.75, 1), ("src/pay.js", "Luz", 2, 0.25, 2)], "id string, author string, commits long, share double, place int"),
        of([("src/cart.js", "sum", 0), ("src/cart.js", "add", 4), ("gen/x.pb.go", "Get", 0)], "file string, name string, total long"),
        of([("src/cart.js", "src/cart.js"), ("src/pay.js", "src/cart.js")], "node string, component string"),
        of([("src/cart.js", "directa", ["f"], 3), ("src/cart.js", "mutua", ["g", "h"], 9)], "id string, kind string, names array<string>, line int"),
        of([("src/pay.js", "riesgo", "20", "80"), ("n", "añadido", None, "activo"), ("gone", "eliminado", "x", None), ("s", "estado", "activo", "dormido")], "id string, change string, `from` string, `to` string"),
        of([("alta", "src/pay.js", "hotspot 1", 1), ("media", "x", "pruebas 1", 1)], "sev string, id string, title string, place int"),
        of([(64, "atención")], "score long, grade string"),
        of([("src/pay.js", "test/pay.test.js")], "file string, test string"),
        commits=20, dynamic_imports=1, dynamic_files=1, reflective=True, when="ayer",
    )


CASES = {
    "¿Qué es lo más RIESGOSO?": ("risk", None, "pay (riesgo 80/100). Principal motivo: cambia seguido (63% del puntaje).", "media", "riesgo 80 · 3 dependientes · 2 cambios/90 d · sin pruebas"),
    "qué se rompe si cambio pay": ("impact", "src/pay.js", "pay afecta a al menos 2 archivos (1 directos, hasta 2 niveles); 2 de producción.", "media", "depende directamente"),
    "y cart.js?": ("impact", "src/cart.js", "cart afecta a 0 archivos (0 directos, hasta 0 niveles); 0 de producción.", "media", None),
    "impacto": ("impact", None, "El mayor radio de impacto es pay: 2 archivos dependen de él directa o indirectamente.", "media", "2 afectados (1 directos)"),
    "cambian juntos": ("hidden", None, "2 pares cambian juntos sin importarse. El más fuerte: cart ↔ pay (7 commits, 88%).", "media", "↔ src/pay.js · 7 commits juntos · confianza 90%/88% · lift 2"),
    "duplicación": ("dup", None, "1 grupo de duplicación. Peor: paginate (2 copias de 12 líneas, costosa; han cambiado juntas 5 veces).", "media", "paginate · 2 copias en src/pay.js, src/cart.js · costosa · puntaje 60"),
    "pruebas": ("tests", None, "1 archivos relevantes sin pruebas. El más delicado: pay (riesgo 80, 3 dependientes).", "media", "riesgo 80 · 3 dependientes · 2 cambios/90 d"),
    "¿quién?": ("owner", None, "1+ archivos dependen de una sola persona. El de más riesgo: pay (Ana).", "media", "Ana · 76% de 8 commits"),
    "quien conoce src/pay.js": ("owner", "src/pay.js", "Ana concentra 76% de los 8 commits; factor autobús 1.", "media", "Ana · 6 commits · 75%"),
    "quien conoce old.js": ("owner", "src/old.js", "1+ archivos dependen de una sola persona. El de más riesgo: pay (Ana).", "media", "Ana · 76% de 8 commits"),
    "código muerto": ("dead", None, "1 archivo huérfano y 1 símbolo exportados sin uso.", "media", "nadie lo importa · 10 líneas · último cambio ?"),
    "ciclos": ("cycles", None, "1 ciclo; el mayor involucra 2 archivos.", "media", "participa en un ciclo"),
    "generado": ("generated", None, "1 archivo generado: se excluyen del riesgo y de los rankings.", "alta", "10 líneas · nombre"),
    "reflexión": ("dynamic", None, "1 archivo usa reflexión o carga dinámica: sus dependencias reales pueden ser más de las dibujadas.", "media", "getattr (línea 4)"),
    "recursión": ("recursion", None, "1 archivo contiene funciones recursivas.", "media", "f() se llama a sí misma · línea 3"),
    "novedades": ("since", None, "Desde ayer: 1 nuevos, 1 borrados, 1 con más riesgo, 1 cambiaron de estado.", "alta", "riesgo 20 → 80"),
    "salud": ("health", None, "Salud 64/100 (atención) con 1 hallazgo de atención alta y 2 en total.", "alta", "hotspot 1"),
    "blablabla": ("none", None, ask.MISUNDERSTOOD, "baja", None),
    "": ("none", None, ask.MISUNDERSTOOD, "baja", None),
    None: ("none", None, ask.MISUNDERSTOOD, "baja", None),
}


def test_every_question(spark, facts):
    asked = spark.createDataFrame([(n, q, "x") for n, q in enumerate(CASES)] * 2, "n int, question string, title string")
    found = {}
    for r in ask.ask(asked, facts).collect():
        found.setdefault(r["question"], []).append((r["intent"], r["file"], r["headline"], r["level"], r["rows"][0]["text"] if r["rows"] else None))
    assert found == {q: [e, e] for q, e in CASES.items()}


def test_evidence_and_doubts(spark, facts):
    asked = spark.createDataFrame([("que se rompe si cambio pay",), ("blablabla",)], "question string")
    told = {r["question"]: r for r in ask.ask(asked, facts).withColumn("said", ask.evidence("question")).collect()}
    a = told["que se rompe si cambio pay"]
    assert a["title"] == "¿Qué se rompe si cambio pay?" and a["follow"] == ["tests", "hidden"]
    assert a["why"] == "Calculado sobre los imports del proyecto. Límites: 1 imports dinámicos que el grafo no sigue; 1 archivo usa reflexión o carga dinámica; lenguajes con reflexión/inyección (los enlaces por tipo son aproximados)."
    assert len(a["challenge"]) == 4 and a["challenge"][2].startswith("1 prueba lo importa directamente")
    assert a["said"].split("\n")[:4] == ["PREGUNTA: que se rompe si cambio pay", f"HALLAZGO: {a['headline']}", "EVIDENCIA:", "- src/cart.js: depende directamente"]
    assert told["blablabla"]["follow"] == list(ask.TITLES)


def test_a_selected_file_and_suggestions(spark, facts):
    asked = spark.createDataFrame([("impacto", "src/pay.js"), ("riesgo", "src/pay.js"), ("impacto", None)], "question string, sel string")
    found = {(r["question"], r["file"]): r["headline"][:3] for r in ask.ask(asked, facts, selected="sel").collect()}
    assert found == {("impacto", "src/pay.js"): "pay", ("riesgo", None): "pay", ("impacto", None): "El "}
    told = ask.suggest(facts, spark.createDataFrame([("src/pay.js",), (None,), ("none.js",)], "id string")).orderBy("id", "place").collect()
    own = [(r["intent"], r["text"]) for r in told if r["id"] == "src/pay.js"]
    assert len(own) == 9 and own[:3] == [("impact", "¿Qué se rompe si cambio pay?"), ("owner", "¿Quién conoce pay?"), ("risk", ask.TITLES["risk"])] and ("impact", ask.TITLES["impact"]) not in own
    assert [r["intent"] for r in told if r["id"] is None] == list(ask.TITLES)[:9] == [r["intent"] for r in told if r["id"] == "none.js"]


def test_nothing_measured(spark, facts):
    bare = ask.Facts(facts.files.limit(0))
    found = {r["asked"]: (r["a"]["intent"], r["a"]["headline"]) for r in ask.catalogue(bare).collect()}
    assert len(found) == 14
    assert {k for k, (i, _) in found.items() if i == "none"} == {"risk", "impact", "hidden", "dup", "owner", "health", "none"}
    assert found["cycles"][1] == "No hay ciclos entre archivos de producción." and found["owner"][1] == "Sin historial git no hay autores."
    assert ask.ask(spark.createDataFrame([], "question string"), facts).collect() == []


def test_many_questions_are_one_plan(spark, facts):
    many = spark.range(10_000).select(F.concat(F.when(F.col("id") % 3 == 0, "riesgo ").otherwise("que rompe pay "), F.col("id").cast("string")).alias("question"))
    rows = ask.ask(many, facts).groupBy("intent", "file").count().collect()
    assert {(r["intent"], r["file"]): r["count"] for r in rows} == {("risk", None): 3334, ("impact", "src/pay.js"): 6666}
