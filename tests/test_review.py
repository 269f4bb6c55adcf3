"""Changes in words, on small tables."""

from tarn.plans import ask, guard, review

FACTS = "id string, known boolean, gen string, aux boolean, dynamic boolean, capped boolean, coverage string, fan_in long"


def test_advice_is_a_sentence_for_each_thing(spark):
    told = spark.createDataFrame([
        ("s/a.js", True, None, False, True, True, "ninguna", 3), ("s/b.js", True, "marca", True, False, None, "directa", 0), ("s/new.js", False, None, None, None, None, None, None)], FACTS)
    files = spark.createDataFrame([("s/a.js", [(1, "eval"), (4, "eval"), (5, "require")]), ("s/b.js", None)], "id string, dyn array<struct<line:int,what:string>>")
    cycles = spark.createDataFrame([(f"s/{x}.js", "s/a.js") for x in "acdef"], "node string, component string")
    # of seven partners of a the five strongest are looked at; b is changed itself, and what is linked isn't told
    pairs = spark.createDataFrame([("s/a.js", f"s/p{i}.js", 10 - i, 1.0, i != 1) for i in range(7)] + [("s/a.js", "s/b.js", 99, 1.0, True)], "a string, b string, count long, strength double, hidden boolean")
    members = spark.createDataFrame([("g", "s/a.js", "f"), ("g", "s/z.js", "f"), ("g", "s/y.js", "g"), ("h", "s/a.js", None), ("h", "s/a.js", None)], "`group` string, file string, name string")
    bridges = spark.createDataFrame([("s/a.js", "api.cs", "GET", "/x"), ("s/a.js", "api.cs", "POST", "/x"), ("s/a.js", "api.cs", "PUT", "/x"), ("web.js", "s/b.js", "GET", "/y")], "source string, target string, method string, path string")
    found = {r.text for r in review.advice(told, files, pairs=pairs, members=members, bridges=bridges, cycles=cycles).collect()}
    assert found == {
        "s/new.js: no está en el análisis (archivo nuevo o ruta distinta): no hay datos previos.",
        "s/b.js es código GENERADO (marca): no lo edites a mano; cambia el generador o su plantilla.",
        "s/b.js vive en una carpeta de ejemplos/herramientas, fuera del producto.",
        "s/a.js usa reflexión o carga dinámica (eval, require): hay dependientes que el grafo no ve; el impacto real puede ser mayor.",
        "s/a.js está en un ciclo con s/c.js, s/d.js, s/e.js: un cambio de interfaz puede propagarse en círculo.",
        "s/a.js: el cálculo de impacto se cortó por tamaño; el alcance real es mayor.",
        "s/a.js no tiene pruebas y lo usan 3 archivos: añade una antes de cambiarlo.",
        *[f"s/a.js suele cambiar junto con s/p{i}.js ({10 - i} commits) aunque no se importan: revisa si también hay que tocar ese." for i in (0, 2, 3, 4)],
        "s/a.js contiene f(), copiada en s/y.js, s/z.js: si lo cambias, cambia las copias.",
        "s/a.js contiene (anónima)(), copiada en otro lugar del mismo archivo: si lo cambias, cambia las copias.",
        "s/a.js llama a api.cs por HTTP (GET /x, POST /x): el contrato no lo comprueba ningún compilador.",
        "s/b.js la llaman desde web.js por HTTP (GET /y): el contrato no lo comprueba ningún compilador.",
    }
    assert review.advice(told.limit(0), files, pairs=pairs, members=members, bridges=bridges, cycles=cycles).count() == 0


def test_issues_say_what_got_worse(spark):
    form = "id string, risk int, fan_in int, loc int, covered boolean, dynamic boolean, skipped boolean, test boolean"
    row = lambda p, risk=1, used=0, loc=9, covered=True, dynamic=False: (p, risk, used, loc, covered, dynamic, False, False)
    before = spark.createDataFrame([row("a"), row("b", 50), row("c", used=1), row("gone", used=2), row("same")], form)
    after = spark.createDataFrame([row("a", 10), row("b", 60), row("c", used=4, dynamic=True), row("same"), row("new", covered=False), row("tiny", loc=2)], form)
    # two groups of copies have the same first file: each is told by its own files
    signed = lambda rows: spark.createDataFrame(rows, "kind string, signature string, id string")
    old = signed([("cycle", "x", "a"), ("cycle", "x", "b"), ("bridge", "c→a", "c")])
    new = signed([("cycle", "y", p) for p in ("a", "b", "c", "same", "new")] + [("dup", f"{n}|new,{f}", p) for n, f in (("f", "same"), ("g", "tiny")) for p in ("new", f)] + [("bridge", "a→c", "a"), ("bridge", "c→a", "c")])
    found = guard.compare(before, after, old, new, (80, 70))
    told = {(r.sev, r.text) for r in review.issues(found, before, after, new, (80, 70)).collect()}
    assert told == {
        ("revisar", "Ciclo nuevo entre a, b, c, new…."), ("nota", "a: el riesgo sube de 1 a 10."), ("revisar", "b: el riesgo sube de 50 a 60."), ("nota", "c: ahora lo usan 4 archivos (antes 1); se está volviendo un punto central."),
        ("nota", "c: ahora usa reflexión o carga dinámica (el grafo ya no ve todo lo que depende de él)."), ("revisar", "new es nuevo (9 líneas) y no tiene pruebas."), ("nota", "tiny es nuevo."),
        ("revisar", "gone se borró y lo usaban 2 archivos: comprueba que ya no se referencie."), ("revisar", "Duplicación nueva: f() aparece en new, same."), ("revisar", "Duplicación nueva: g() aparece en new, tiny."),
        ("nota", "Puente HTTP nuevo: a→c."), ("revisar", "La salud del proyecto baja 10 puntos (80 → 70)."),
    }
    assert found.filter("rule = 'resuelto'").count() == 1


def test_group_facts_are_what_answers_need(spark):
    groups = spark.createDataFrame([("g", None, 3, 9, "latente", 40, 0, False, ["w"]), ("h", "f", 2, 5, "costosa", 70, 4, False, None)], "`group` string, name string, copies long, lines long, sev string, score int, co_count long, test boolean, warn array<string>")
    members = spark.createDataFrame([("g", "b.js"), ("g", "a.js"), ("g", "a.js"), ("h", "c.js")], "`group` string, file string")
    found = {r.group: r for r in ask.group_facts(groups, members).collect()}
    assert (found["g"].name, found["g"].files, found["g"].file, found["g"].warned) == ("(anónima)", ["a.js", "b.js"], "a.js", True) and not found["h"].warned
