"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçý"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncy"

#: Names and marks of generated code.
GENERATED_NAME = r"(?i:\.(?:g|generated|designer)\.(?:cs|ts|js|dart|vb)$)|\.pb\.(?:go|cc|h)$|_pb2(?:_grpc)?\.pyi?$|\.min\.(?:js|css)$|\.pb\.(?:js|ts)$|(?i:(?:^|/)(?:generated|__generated__|gen)/)|(?i:\.generated\.)|Grpc\.java$"
GENERATED_MARK = r"(?i)@generated|DO NOT EDIT|<auto-generated|auto-?generated|code generated by|generated by (?:the )?\w+|this file (?:is|was) (?:auto)?-?generated|archivo generado"

#: Folders whose files are beside the point.
AUXILIARY = r"(?i)(?:^|/)(?:examples?|samples?|demos?|fixtures?|playground|bench(?:marks?)?|docs?|vendor|third_party)(?:/|$)"

#: The questions in the order in which they are tried, and the words that ask them.
INTENTS = (
    ("risk", "riesg|peligros|fragil|delicad|risk|cuidado"),
    ("impact", "rompe|romper|afecta|afectar|impact|depend|cambio en|tocar|borro|cambiar"),
    ("hidden", "junto|acopl|co-?cambi|oculto|tunel|coupl"),
    ("dup", "duplic|dry|copia|repet|clon"),
    ("tests", "prueba|test|cobertura|coverage"),
    ("owner", "quien|autor|bus|propiet|conoce|owner|equipo"),
    ("dead", "borr|muert|huerfan|sin uso|elimin|dead|unused|limpi"),
    ("cycles", "ciclo|circular|cycle"),
    ("generated", "generad|autogen|codegen|minific"),
    ("dynamic", "reflex|dinamic|reflect|eval|inyecc"),
    ("recursion", "recurs"),
    ("since", "desde|ultima vez|novedad|que cambio|since|diferenc"),
    ("health", "salud|general|estado|resumen|health|empeor|mejor|tendencia"),
)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def intent(question: Column, has_file: Column | None = None) -> Column:
    """What a question asks: the first intent whose words it has, else impact if it names a file, else none."""
    folded = fold(question)
    out = None
    for name, words in INTENTS:
        out = F.when(folded.rlike(words), name) if out is None else out.when(folded.rlike(words), name)
    return (out if has_file is None else out.when(has_file, "impact")).otherwise("none")


#: Messages of commits that mend something.
FIX = r"(?i)(?:^|[^A-Za-z0-9_])(?:fix(?:es|ed)?|hotfix|bug|corrig\w*|arregl\w*|error(?:es)?|revert\w*|parche)(?:$|[^A-Za-z0-9_])"


def normal_url(url: Column) -> Column:
    """A route or URL without host, query and case; parameters are ``:p``."""
    out = F.regexp_replace(F.regexp_replace(url, r"(?i)^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    out = F.regexp_replace(out, r"\$\{[^}]*\}|\{[^}]*\}|<[^>]*>|:\w+|\[[^\]]*\]", ":p")
    return F.lower(F.regexp_replace(F.regexp_replace(out, "/+", "/"), "^/|/$", ""))


def same_route(a: Column, b: Column) -> Column:
    """Whether two split routes agree segment by segment; ``:p`` agrees with any."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == ":p") | (y == ":p")), lambda x: x)


def generated(path: Column, content: Column) -> Column:
    """Why a file counts as generated, else null."""
    head = F.substring_index(content, "\n", 25)
    lines = F.size(F.split(content, "\n"))
    return F.when(path.rlike(GENERATED_NAME), "nombre").when(head.rlike(GENERATED_MARK), "marca").when((lines <= 3) & (F.length(content) > 3000), "minificado")


def match_lines(content: Column, pattern: Column, whole: Column) -> Column:
    """The lines in which the matches ``whole`` of a pattern begin: what stands between them is counted, so equal matches have lines of their own."""
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    pieces = F.arrays_zip(F.slice(F.split(content, pattern, -1), F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["line"] + breaks(x["before"])
        return F.struct((here + breaks(x["whole"])).cast("int").alias("line"), F.concat(acc["lines"], F.array(here.cast("int"))).alias("lines"))

    return F.aggregate(pieces, start, step)["lines"]


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|spec)/") | path.rlike(r"(?i)\.(test|spec)\.[^.]+$|_test\.(go|py|c|cc|cpp|rs)$|(^|/)test_[^/]+\.py$|(^|/)conftest\.py$|Tests?\.(cs|java|kt|php)$")


def folder(path: Column) -> Column:
    """The folder of a path; ``(raíz)`` at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("(raíz)")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def package(spec: Column, lang: Column) -> Column:
    """The external package that an import names."""
    parts = F.split(spec, "/")
    first = F.element_at(parts, 1)
    dotted = F.split(spec, r"::|\.")
    return (
        F.when(lang == "javascript", F.when(spec.startswith("@") & (F.size(parts) > 1), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(first))
        .when(lang == "go", F.when(first.contains("."), F.array_join(F.slice(parts, 1, 3), "/")).otherwise(first))
        .when(lang.isin("java", "kotlin"), F.array_join(F.slice(dotted, 1, 2), "."))
        .otherwise(F.element_at(F.split(first, r"::|\."), 1))
    )


def fuzzy(query: Column, name: Column) -> Column:
    """(score, hit) of how well a name fits what is typed; null unless it has all its letters in order.

    One scan with a state takes each letter at the first place where it can stand: 1 for it, 3 if it follows the
    letter before, 2 more at the beginning or behind one of ``/._-``; 8 if the last part of the name
    has the query whole; and 0.02 off for each character.  hit are the places, from 0.
    """
    q, s = F.lower(query), F.lower(name)
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("qi"), F.lit(0).alias("score"), F.lit(-2).alias("last"), F.lit(0).alias("i"), F.lit("").alias("before"), F.array().cast("array<int>").alias("hit"))

    def step(acc: Column, c: Column) -> Column:
        met = (acc["qi"] < F.length(q)) & (F.substring(q, acc["qi"] + 1, F.lit(1)) == c)
        worth = F.when(acc["i"] == acc["last"] + 1, 3).otherwise(1) + F.when((acc["i"] == 0) | acc["before"].isin("/", ".", "_", "-"), 2).otherwise(0)
        return F.struct(
            F.when(met, acc["qi"] + 1).otherwise(acc["qi"]).alias("qi"), F.when(met, acc["score"] + worth).otherwise(acc["score"]).alias("score"), F.when(met, acc["i"]).otherwise(acc["last"]).alias("last"),
            (acc["i"] + 1).alias("i"), c.alias("before"), F.when(met, F.concat(acc["hit"], F.array(acc["i"]))).otherwise(acc["hit"]).alias("hit"),
        )

    done = F.aggregate(letters, start, step)
    base = F.when(F.contains(F.element_at(F.split(s, "/"), -1), q), 8).otherwise(0)
    score = done["score"] + base - F.length(s) * F.lit(0.02).cast("double")
    return F.when(done["qi"] == F.length(q), F.struct(score.alias("score"), done["hit"].alias("hit")))
