"""Languages as data: what their comments, imports and definitions look like and how imports are resolved."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Import:
    """``spec`` and ``names`` are groups of ``pattern``; ``style`` says how names are written: clause, star
    (a clause that is exported again), python, pyimport.  ``each`` (pattern, spec, alias) finds several in group 1."""

    pattern: str
    spec: int = 1
    kind: str = "import"
    names: int = 0
    style: str = ""
    multi: bool = False
    each: tuple[str, int, int] | None = None
    how: str = ""


@dataclass(frozen=True)
class Define:
    """``exported``: always, noUnderscore, capitalized, public or group (``group`` isn't empty)."""

    pattern: str
    name: int
    kind: str = "function"
    kind_group: int = 0
    exported: str = "always"
    group: int = 0


@dataclass(frozen=True)
class Language:
    id: str
    exts: tuple[str, ...]
    ignore: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    triple: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()
    imports: tuple[Import, ...] = ()
    defs: tuple[Define, ...] = ()
    #: (pattern, group, what): name, list or default
    exports: tuple[tuple[str, int, str], ...] = ()
    namespace: str = ""
    resolver: str = ""
    sep: str = "."
    lazy: bool = False
    dynamic: tuple[tuple[str, str], ...] = ()


_C = {"line": ("//",), "block": (("/*", "*/"),), "strings": ('"', "'")}

# Each language's extensions, folders that hold no code of the project, signs and patterns.
_JAVASCRIPT = Language(
    "javascript", (".mjs", ".js", ".cjs", ".jsx", ".ts", ".tsx", ".mts", ".cts"), ("node_modules", "dist", "build", "coverage", ".next", ".cache"), (r"(^|/)(tests?|__tests__|spec)/", r"\.(test|spec)\.[^.]+$"),
    **{**_C, "strings": ('"', "'", "`")}, resolver="script",
    imports=(
        Import(r"(^|[;\n}])\s*import\s+(type\s+)?([^'\"()]*?)\s*from\s*['\"]([^'\"]+)['\"]", 4, "import", 3, "clause"),
        Import(r"(^|[;\n}])\s*import\s*['\"]([^'\"]+)['\"]", 2, "import", 0, "side"),
        Import(r"(^|[;\n}])\s*export\s+(type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*['\"]([^'\"]+)['\"]", 4, "reexport", 3, "star"),
        Import(r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1, "dynamic"),
        Import(r"(?:(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*)?\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 2, "require", 1, "clause"),
    ),
    defs=(
        Define(r"^(export\s+)?(default\s+)?(async\s+)?function\*?\s+([\w$]+)", 4, "function", exported="group", group=1),
        Define(r"^(export\s+)?(default\s+)?(abstract\s+)?class\s+([\w$]+)", 4, "class", exported="group", group=1),
        Define(r"^(export\s+)?(const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(async\s*)?(\([^)]*\)|[\w$]+)\s*=>", 3, "function", exported="group", group=1),
        Define(r"^(export\s+)?(const|let|var)\s+([\w$]+)", 3, "const", exported="group", group=1),
        Define(r"^(export\s+)?(interface|type|enum)\s+([\w$]+)", 3, "type", exported="group", group=1),
    ),
    exports=((r"\bexport\s+(?:async\s+)?(?:default\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([\w$]+)", 1, "name"), (r"\bexport\s*\{([^}]*)\}(?!\s*from)", 1, "list"), (r"\bexport\s+(default)\b", 1, "name")),
    dynamic=((r"\brequire\(\s*(?!['\"`])[^)]", "require(variable)"), (r"\bimport\(\s*(?!['\"`])[^)]", "import(variable)"), (r"\beval\(", "eval"), (r"\bnew\s+Function\(", "new Function"), (r"\bReflect\.(?:get|apply|construct)\(", "Reflect")),
)
_PYTHON = Language(
    "python", (".py",), ("__pycache__", "venv", ".venv", "site-packages", ".tox", ".mypy_cache", ".pytest_cache", "egg-info"), (r"(^|/)tests?/", r"(^|/)test_[^/]+\.py$", r"_test\.py$", r"conftest\.py$"),
    line=("#",), triple=('"""', "'''"), strings=('"', "'"), resolver="dotted", lazy=True,
    imports=(
        Import(r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]*\(([^)]*)\)", 1, names=2, style="python"),
        Import(r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+([^\n(][^\n]*)", 1, names=2, style="python"),
        Import(r"^[ \t]*import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)", 1, style="pyimport", multi=True),
    ),
    defs=(Define(r"^(?:async[ \t]+)?def[ \t]+(\w+)", 1, "function", exported="noUnderscore"), Define(r"^class[ \t]+(\w+)", 1, "class", exported="noUnderscore"), Define(r"^([A-Z][A-Z0-9_]+)[ \t]*(?::[^=]+)?=", 1, "const")),
    dynamic=((r"\bgetattr\(", "getattr"), (r"\bimportlib\.import_module\(|\b__import__\(", "import dinámico"), (r"\beval\(|\bexec\(", "eval/exec")),
)
_CSHARP = Language(
    "csharp", (".cs",), ("bin", "obj", "packages", ".vs"), (r"(^|/)tests?/", r"Tests?\.cs$", r"\.Tests?/", r"UnitTests?/"), **_C, resolver="namespace",
    imports=(Import(r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?([\w.]+)[ \t]*;"),), namespace=r"^[ \t]*namespace[ \t]+([\w.]+)",
    defs=(
        Define(r"^[ \t]*(?:\[[^\]]*\][ \t]*)*(?:(?:public|internal|private|protected|static|abstract|sealed|partial|readonly|unsafe|new|file)[ \t]+)*(class|interface|struct|enum|record(?:[ \t]+(?:class|struct))?)[ \t]+(\w+)", 2, "", 1, "public"),
        Define(r"^[ \t]+(?:public|internal|protected)[ \t]+(?:(?:static|async|virtual|override|abstract|sealed|unsafe|new|extern)[ \t]+)*[\w<>\[\],.?]+[ \t]+(\w+)[ \t]*\(", 1),
    ),
    dynamic=((r"\bActivator\.CreateInstance\(", "Activator.CreateInstance"), (r"\bType\.GetType\(", "Type.GetType"), (r"\bAssembly\.(?:Load|LoadFrom|GetTypes)\(", "Assembly.Load"), (r"\.GetMethod\(|\.GetProperty\(|\.Invoke\(", "reflexión (GetMethod/Invoke)")),
)
_JAVA = Language(
    "java", (".java",), ("target", "build", ".gradle", "out", ".idea"), (r"(^|/)src/test/", r"Tests?\.java$", r"(^|/)tests?/"), **_C, resolver="namespace",
    imports=(Import(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;"),), namespace=r"^[ \t]*package[ \t]+([\w.]+)[ \t]*;",
    defs=(Define(r"^[ \t]*(?:@\w+(?:\([^)]*\))?[ \t]+)*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed)[ \t]+)*(class|interface|enum|record|@interface)[ \t]+(\w+)", 2, "", 1, "public"),),
    dynamic=((r"\bClass\.forName\(", "Class.forName"), (r"\.getMethod\(|\.getDeclaredMethod\(|\.newInstance\(", "reflexión (getMethod/newInstance)"), (r"\bServiceLoader\.load\(", "ServiceLoader")),
)
_KOTLIN = Language(
    "kotlin", (".kt",), ("build", ".gradle", "out", ".idea"), (r"(^|/)src/test/", r"Tests?\.kt$", r"(^|/)tests?/"), **_C, resolver="namespace",
    imports=(Import(r"^[ \t]*import[ \t]+([\w.]+(?:\.\*)?)(?:[ \t]+as[ \t]+\w+)?[ \t]*$"),), namespace=r"^[ \t]*package[ \t]+([\w.]+)",
    defs=(
        Define(r"^[ \t]*(?:@\w+[ \t]+)*(?:(?:public|private|internal|protected|data|sealed|open|abstract|enum|annotation|inner)[ \t]+)*(class|interface|object)[ \t]+(\w+)", 2, "", 1, "public"),
        Define(r"^[ \t]*(?:(?:public|internal|private|override|suspend|inline)[ \t]+)*fun[ \t]+(?:<[^>]+>[ \t]+)?(?:[\w.]+\.)?(\w+)[ \t]*\(", 1, exported="public"),
    ),
    dynamic=((r"\bClass\.forName\(|::class\.java\.get|\.newInstance\(", "reflexión"),),
)
_PHP = Language(
    "php", (".php",), ("vendor", "cache", "storage"), (r"(^|/)tests?/", r"Test\.php$"), line=("//", "#"), block=(("/*", "*/"),), strings=('"', "'"), resolver="namespace", sep="\\",
    imports=(Import(r"^[ \t]*use[ \t]+(?:function[ \t]+|const[ \t]+)?([\w\\]+)(?:[ \t]+as[ \t]+\w+)?[ \t]*;"), Import(r"(?:require|include)(?:_once)?[ \t]*\(?[ \t]*['\"]([^'\"]+\.php)['\"]", 1, "require", how="file")),
    namespace=r"^[ \t]*namespace[ \t]+([\w\\]+)[ \t]*;",
    defs=(Define(r"^[ \t]*(?:(?:abstract|final|readonly)[ \t]+)*(class|interface|trait|enum)[ \t]+(\w+)", 2, "", 1), Define(r"^[ \t]*(?:(?:public|protected|private|static|abstract|final)[ \t]+)*function[ \t]+(\w+)", 1)),
    dynamic=((r"\bnew\s+\$\w+|\$\w+::\w+\(|call_user_func", "clase/función dinámica"), (r"\beval\(", "eval")),
)
_GO = Language(
    "go", (".go",), ("vendor",), (r"_test\.go$",), **{**_C, "strings": ('"', "'", "`")}, resolver="go",
    imports=(Import(r"^[ \t]*import[ \t]+(?:(\w+|\.|_)[ \t]+)?\"([^\"]+)\"", 2), Import(r"^[ \t]*import[ \t]*\(([\s\S]*?)\)", 1, each=(r"^[ \t]*(?:(\w+|\.|_)[ \t]+)?\"([^\"]+)\"", 2, 1))),
    defs=(
        Define(r"^func[ \t]+(\w+)", 1, exported="capitalized"), Define(r"^func[ \t]*\([^)]*\)[ \t]*(\w+)", 1, exported="capitalized"),
        Define(r"^type[ \t]+(\w+)[ \t]+(struct|interface)?", 1, "type", exported="capitalized"), Define(r"^(?:var|const)[ \t]+(\w+)", 1, "const", exported="capitalized"),
    ),
    dynamic=((r"\breflect\.\w+", "reflect"), (r"\bplugin\.Open\(", "plugin.Open")),
)
_RUST = Language(
    "rust", (".rs",), ("target",), (r"(^|/)tests/", r"_test\.rs$"), line=("//",), block=(("/*", "*/"),), strings=('"',), resolver="rust",
    imports=(Import(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;", 1, "mod"), Import(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+((?:crate|self|super)(?:::\w+)*)")),
    defs=(Define(r"^[ \t]*(pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+)*(fn|struct|enum|trait|type|const|static|mod)[ \t]+(\w+)", 3, "", 2, "group", 1),),
    dynamic=((r"\blibloading\b|\bdlopen\b", "carga dinámica"),),
)
_CPP = Language(
    "cpp", (".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"), ("build", "cmake-build-debug", "out", "third_party"), (r"(^|/)tests?/", r"_test\.(c|cc|cpp)$"), **_C, resolver="include",
    imports=(Import(r"^[ \t]*#[ \t]*include[ \t]*\"([^\"]+)\"", 1, "include"), Import(r"^[ \t]*#[ \t]*include[ \t]*<([^>]+)>", 1, "include")),
    defs=(Define(r"^[ \t]*(?:typedef[ \t]+)?(class|struct|enum|union)[ \t]+(\w+)", 2, "", 1), Define(r"^[\w:<>*&\t ]*?[ \t*&]([A-Za-z_]\w*)[ \t]*\([^;{]*\)[ \t]*(?:const)?[ \t]*\{?[ \t]*$", 1)),
)
#: Kinds of definitions that are types.
TYPES = ("class", "interface", "struct", "enum", "record", "trait", "object", "type", "union")


def _quote(s: str) -> str:
    """A literal for Java's patterns."""
    return re.sub(r"([.*+?^${}()|\[\]\\/#'\"`<>-])", r"\\\1", s)


class Grammar:
    """The languages that are known, by id.  Its tables have a row for each language or pattern: they grow with the
    settings, not with the files, so they are broadcast."""

    def __init__(self, languages: tuple[Language, ...]):
        self.languages = {x.id: x for x in languages}

    @staticmethod
    def builtin() -> Grammar:
        return Grammar((_JAVASCRIPT, _PYTHON, _CSHARP, _JAVA, _KOTLIN, _PHP, _GO, _RUST, _CPP))

    def with_settings(self, settings: dict) -> Grammar:
        """With the ``languages`` of a settings file: an id with false goes, any other replaces the one of its id or is added.

        One whose patterns don't compile, or that has no extensions, is left out.
        """
        found = dict(self.languages)
        for name, spec in settings.items():
            if spec is False:
                found.pop(name, None)
            elif (own := _from_settings(name, spec)) is not None:
                found.pop(name, None)
                found[name] = own
        return Grammar(tuple(found.values()))

    @property
    def extensions(self) -> dict[str, str]:
        """The language of each extension; of several the one that was there first."""
        out: dict[str, str] = {}
        for x in self.languages.values():
            for e in x.exts:
                out.setdefault(e, x.id)
        return out

    @property
    def ignored(self) -> set[str]:
        return {i for x in self.languages.values() for i in x.ignore}

    def with_resolver(self, how: str) -> list[str]:
        return [x.id for x in self.languages.values() if x.resolver == how]

    def is_test(self, lang: Column, path: Column) -> Column:
        """Whether a path is a test's by its language's own patterns; case doesn't count."""
        out = None
        for x in self.languages.values():
            holds = F.lit(False)
            for p in x.tests:
                holds = holds | path.rlike(f"(?i){p}")
            out = F.when(lang == x.id, holds) if out is None else out.when(lang == x.id, holds)
        return F.lit(False) if out is None else out.otherwise(False)

    def lexers(self, spark: SparkSession) -> DataFrame:
        """(lang, pieces, opens, blocked, closes, quoted): what cuts a text into strings, comments and the rest, and what a piece of each begins and ends with."""
        rows = []
        for x in self.languages.values():
            blocks = [f"{_quote(a)}[\\s\\S]*?(?:{_quote(b)}|\\z)" for a, b in x.block]
            lines = [f"{_quote(t)}[^\\n]*" for t in x.line]
            triples = [f"{_quote(t)}[\\s\\S]*?(?:{_quote(t)}|\\z)" for t in x.triple]
            # a string ends with its line, but for one in back quotes
            strings = [f"{q}[^{q}\\\\{'' if q == '`' else chr(92) + 'n'}]*+(?:\\\\[\\s\\S][^{q}\\\\{'' if q == '`' else chr(92) + 'n'}]*+)*+{q}?" for q in x.strings]
            firsts = "".join(sorted({t[0] for t in (*x.line, *(a for a, _ in x.block), *x.triple, *x.strings)}))
            rest = f"[^{''.join(map(_quote, firsts))}]++" if firsts else "[\\s\\S]++"
            pieces = "|".join([*blocks, *lines, *triples, *strings, rest, "[\\s\\S]"])
            opens = "|".join(_quote(t) for t in (*(a for a, _ in x.block), *x.line)) or "(?!)"
            closes = "|".join(_quote(b) for _, b in x.block) or "(?!)"
            quoted = "|".join(_quote(t) for t in (*x.triple, *x.strings)) or "(?!)"
            blocked = "|".join(_quote(a) for a, _ in x.block) or "(?!)"
            rows.append((x.id, pieces, f"^(?:{opens})", f"^(?:{blocked})", f"(?:{closes})$", f"^(?:{quoted})"))
        return spark.createDataFrame(rows, "lang string, pieces string, opens string, blocked string, closes string, quoted string")

    def imports(self, spark: SparkSession) -> DataFrame:
        """A row for each pattern of an import."""
        rows = [
            (x.id, n, p.pattern if p.pattern.startswith("(^") else f"(?m){p.pattern}", p.kind, p.spec, p.names, p.style, p.multi, f"(?m){p.each[0]}" if p.each else None, p.each[1] if p.each else 0, p.each[2] if p.each else 0, p.how or x.resolver, x.lazy)
            for x in self.languages.values() for n, p in enumerate(x.imports)
        ]
        return spark.createDataFrame(rows, "lang string, place int, pattern string, kind string, spec_at int, names_at int, style string, multi boolean, each string, each_spec int, each_alias int, how string, lazy boolean")

    def definitions(self, spark: SparkSession) -> DataFrame:
        """A row for each pattern of a definition; the first that fits a line counts."""
        rows = [(x.id, n, p.pattern, p.name, p.kind, p.kind_group, p.exported, p.group) for x in self.languages.values() for n, p in enumerate(x.defs)]
        return spark.createDataFrame(rows, "lang string, place int, pattern string, name_at int, kind string, kind_at int, rule string, group_at int")

    def exports(self, spark: SparkSession) -> DataFrame:
        rows = [(x.id, p, n, what) for x in self.languages.values() for p, n, what in x.exports]
        return spark.createDataFrame(rows, "lang string, pattern string, name_at int, what string")

    def namespaces(self, spark: SparkSession) -> DataFrame:
        rows = [(x.id, f"(?m){x.namespace}", x.sep) for x in self.languages.values() if x.namespace]
        return spark.createDataFrame(rows, "lang string, pattern string, sep string")

    def dynamic(self, spark: SparkSession) -> DataFrame:
        rows = [(x.id, n, p, what) for x in self.languages.values() for n, (p, what) in enumerate(x.dynamic)]
        return spark.createDataFrame(rows, "lang string, place int, pattern string, what string")


def _from_settings(name: str, spec: dict) -> Language | None:
    """A language as settings tell it: the same fields, patterns as ``re``, groups by number."""
    try:
        lexer = spec.get("lexer", {})
        imports = tuple(
            Import(p["re"], p.get("spec", 1), p.get("kind", "import"), p.get("names", 0), p.get("namesStyle", ""), bool(p.get("multi")), (p["each"]["re"], p["each"]["spec"], p["each"].get("alias", 0)) if p.get("each") else None, p.get("resolve", ""))
            for p in spec.get("imports", [])
        )
        defs = tuple(Define(d["re"], d["name"], d.get("kind", "function"), d.get("kindGroup", 0), d.get("exported", "always"), d.get("exportGroup", 0)) for d in spec.get("defs", []))
        made = Language(
            name, tuple(e.lower() for e in spec["exts"]), tuple(spec.get("ignore", [])), tuple(spec.get("tests", [])), tuple(lexer.get("line", [])), tuple((a, b) for a, b in lexer.get("block", [])), tuple(lexer.get("triple", [])), tuple(lexer.get("strings", [])),
            imports, defs, (), spec.get("namespace", ""), spec.get("resolver", ""), spec.get("sep", "."), bool(spec.get("lazyIndented")),
        )
        for p in (*(i.pattern for i in imports), *(i.each[0] for i in imports if i.each), *(d.pattern for d in defs), *made.tests, made.namespace):
            re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", p))
    except (KeyError, TypeError, ValueError, AttributeError, re.error):
        return None
    return made if made.exts else None


BUILTIN = Grammar.builtin()
