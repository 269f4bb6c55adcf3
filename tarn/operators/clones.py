"""Duplicates: equal and similar units, repeated literals, and names used for different things."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.stats import half_up
from ..session import cut, shares
from .graph import components
from .measures import numbered


#: Names too common to tell anything.
COMMON = ["constructor", "default", "handler", "render", "init", "main", "run", "test", "setup", "teardown", "toString", "toJSON", "create", "update", "delete", "remove", "index", "handle", "start", "stop", "build", "get", "set", "then", "catch", "callback", "validate", "format"]


#: Rows whose words are hashed at once.
ROWS = 100


def exact_groups(units: DataFrame, unit: str, content: str) -> DataFrame:
    """(unit, digest, copies, first): a row for each unit whose content another has too; a group is never one row."""
    keyed = units.select(F.col(unit).alias("unit"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("digest"))
    sized = keyed.groupBy("digest").agg(F.count("*").alias("copies"), F.min("unit").alias("first")).filter("copies > 1")
    return keyed.join(sized, "digest").select("unit", "digest", "copies", "first")


def shingles(units: DataFrame, unit: str, tokens: Column, k: int = 5) -> DataFrame:
    """(unit, shingle): distinct runs of ``k`` tokens, as hashes."""
    with_tokens = units.select(F.col(unit).alias("unit"), tokens.alias("t"))
    runs = F.transform(F.sequence(F.lit(1), F.size("t") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("t", i, k), " ")))
    return with_tokens.filter(F.size("t") >= k).select("unit", F.explode(F.array_distinct(runs)).alias("shingle"))


def classes(units: DataFrame, unit: str, content: Column) -> DataFrame:
    """(unit, rep): each unit and the smallest with the same content, so that copies are compared once."""
    keyed = units.select(F.col(unit).alias("unit"), F.sha2(content, 256).alias("digest"))
    least = keyed.groupBy("digest").agg(F.min("unit").alias("rep"))
    return keyed.join(least, "digest").select("unit", "rep")


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``strings`` in one piece, and where each begins, with the end."""
    strings = strings.cast(pa.large_string())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _hashed(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each of the words of ``sizes`` bytes that ``data`` is made of: a sum of random numbers by byte and place, mixed."""
    most = int(sizes.max(initial=0))
    drawn = np.random.default_rng(5).integers(1, 2**63, 256 + most, np.uint64) * np.uint64(2) + np.uint64(1)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(begin, sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(drawn[data] * drawn[256 + place], dtype=np.uint64)])
    words = sums[begin + sizes] - sums[begin]
    return (words ^ (words >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts or of lists of words, and the number of the first of each row, with the end."""
    if pa.types.is_list(column.type):
        first = column.offsets.to_numpy()
        data, ends = _bytes(column.values.slice(first[0], first[-1] - first[0]))
        return _hashed(data, np.diff(ends)), first - first[0]
    data, ends = _bytes(column)
    inside = (data != 32) & (data != 9) & (data != 10)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = ends[:-1][ends[:-1] < len(data)]
    begins[at] = inside[at]
    begins = np.flatnonzero(begins)
    place = np.cumsum(inside)[begins] - 1
    return _hashed(data[inside], np.diff(place, append=np.count_nonzero(inside))), np.searchsorted(begins, ends)


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct runs of ``k`` of hashed words, as sorted hashes."""
    found = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
    return np.unique(found).view(np.int64)


def shingle_sets(units: DataFrame, unit: str, tokens: Column, k: int = 5) -> DataFrame:
    """(unit, n, digest, s): of each unit with ``k`` tokens or more its n distinct runs of ``k`` as sorted hashes.

    ``tokens`` are a list, or a text whose words are parted by spaces, tabs and line ends.  Units of the same digest have the
    same tokens, as far as 64-bit hashes of them tell; units without a name are left out.
    """
    listed = units.select(F.col(unit).alias("unit"), tokens.alias("t")).filter(F.col("unit").isNotNull() & F.col("t").isNotNull())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some rows at a time: a byte takes some forty in between
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            words, ends = _words(batch.column("t"))
            at = np.flatnonzero(np.diff(ends) >= k)
            each = [words[ends[i] : ends[i + 1]] for i in at]
            runs = [_runs(x, k) for x in each]
            sizes = np.array([len(x) for x in runs], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(runs) if runs else [], pa.int64()))
            digests = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("unit").take(pa.array(at)), pa.array(sizes), digests, lists], names=["unit", "n", "digest", "s"])

    fields = [listed.schema["unit"], StructField("n", IntegerType()), StructField("digest", StringType()), StructField("s", ArrayType(LongType()))]
    return listed.mapInArrow(sets, StructType(fields))


def near_pairs(shingled: DataFrame, *, similarity: float = 0.8, least: int = 10, share: float = 0.2, floor: int = 8) -> DataFrame:
    """``near_sets`` of the units' shingles (unit, shingle), each once."""
    sets = shingled.groupBy("unit").agg(F.collect_list("shingle").alias("s"))
    return near_sets(cut(sets.select("unit", F.size("s").alias("n"), "s")), similarity=similarity, least=least, share=share, floor=floor)


def near_sets(sets: DataFrame, *, similarity: float = 0.8, least: int = 10, share: float = 0.2, floor: int = 8) -> DataFrame:
    """(a, b, sim): pairs of units of ``similarity`` or more over their rare shingles; ``sets`` has unit and its n shingles s.

    A shingle is rare in max(``floor``, ``share`` of all units) units or fewer; both units need ``least``
    rare ones.  Pairs meet by their rarest: with each unit's shingles in order of how many units have
    them, two of the similarity have one in common among the first (1 - similarity) of each, and there
    the frequent ones, which would make most pairs, don't come up.  Shingles that one unit alone has, by far the most, count
    in its size and are the first of its order; no more of them is dealt on.
    """
    counted = sets.agg(F.count("*"), F.sum("n")).first()
    most, parts = max(floor, math.ceil(counted[0] * share)), shares((counted[1] or 0) / 8, sets.sparkSession)
    dealt = sets.select("unit", "n", F.explode("s").alias("shingle")).repartition(parts, "shingle")
    shared = dealt.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).filter("df > 1")
    rare = F.col("df") <= most
    gathered = shared.groupBy("unit").agg(F.array_sort(F.collect_list(F.when(rare, F.struct("df", "shingle")))).alias("s"), (F.max("n") - F.count_if(~rare)).cast("int").alias("n"))
    own = cut(gathered.filter(F.col("n") >= least))
    n = F.col("n")
    # of the first ones those that no other unit has leave these
    first = F.greatest(F.lit(0), n - F.ceil(n * similarity - 1e-9) + 1 - (n - F.size("s"))).cast("int")
    prefix = cut(own.select("unit", "n", F.explode(F.slice("s", F.lit(1), first)).alias("x")).select("unit", "n", "x.shingle"))
    a, b = (prefix.select("shingle", F.col("unit").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    fit = (F.col("na") >= F.col("nb") * (similarity - 1e-9)) & (F.col("nb") >= F.col("na") * (similarity - 1e-9))
    met = cut(a.join(b, "shingle").filter((F.col("a") < F.col("b")) & fit).select("a", "b").distinct())
    whole = own.select("unit", "n", F.col("s.shingle").alias("s"))
    both = met.join(whole.select(F.col("unit").alias("a"), F.col("n").alias("na"), F.col("s").alias("x")), "a").join(whole.select(F.col("unit").alias("b"), F.col("n").alias("nb"), F.col("s").alias("y")), "b")
    told = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), "na", "nb")
    return told.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim")).filter(F.col("sim") >= similarity)


def groups(pairs: DataFrame) -> DataFrame:
    """(unit, group): units that pairs connect, named by the smallest of them."""
    return components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("unit"), F.col("component").alias("group"))


def summary(members: DataFrame, pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """(group, name, type, sim, lines, tokens, copies, files, same_file, test) of clone groups.

    ``members`` has group, unit, name, file, loc, len, test and two hashes: hash of the normalised
    tokens and raw_hash of the tokens as they are; pairs (a, b, sim) are those that joined the units.
    The name is the commonest, the smallest of equals; anonymous units name nothing.  ``exact`` (unit,
    rep) tells which unit stood for which in the pairs.
    """
    named = members.filter("name is not null").groupBy("group", "name").agg(F.count("*").alias("n"))
    best = named.groupBy("group").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"))
    of = members.join(exact.select("unit", "rep"), "unit").select(F.col("rep").alias("a"), "group").distinct()
    sims = pairs.join(of, "a").groupBy("group").agg(F.min("sim").alias("sim"))
    rolled = members.groupBy("group").agg(
        F.count_distinct("hash").alias("kinds"), F.count_distinct("raw_hash").alias("raws"), F.floor(F.avg("loc") + 0.5).alias("lines"), F.floor(F.avg("len") + 0.5).alias("tokens"),
        F.count("*").alias("copies"), F.count_distinct("file").alias("files"), F.bool_and("test").alias("test"),
    )
    kind = F.when(F.col("raws") == 1, "exacto").when(F.col("kinds") == 1, "parametrizado").otherwise("similar")
    sim = F.when(F.col("kinds") == 1, 1.0).otherwise(F.floor(F.coalesce("sim", F.lit(1.0)) * 100 + 0.5) / 100)
    joined = rolled.join(best, "group", "left").join(sims, "group", "left")
    return joined.select("group", "name", kind.alias("type"), sim.alias("sim"), "lines", "tokens", "copies", "files", (F.col("files") == 1).alias("same_file"), "test")


def co_rate(members: DataFrame, together: DataFrame, commits: DataFrame) -> DataFrame:
    """(group, co_rate, co_count): the highest share of common commits of two of a group's files.

    ``together`` (a, b, count) with a < b counts common commits, ``commits`` (file, commits) each
    file's; the pairs come from ``together``, so a group's files are never paired with each other.
    Where it has each pair's group as well, that is taken.
    """
    met = together
    if "group" not in together.columns:
        files = members.select("group", "file").distinct()
        met = together.join(files.withColumnRenamed("file", "a"), "a").join(files.select(F.col("file").alias("b"), F.col("group").alias("g")), "b").filter("group = g")
    each = met.join(commits.select(F.col("file").alias("a"), F.col("commits").alias("ca")), "a").join(commits.select(F.col("file").alias("b"), F.col("commits").alias("cb")), "b")
    rate = F.floor(F.col("count") / F.least("ca", "cb") * 100 + 0.5) / 100
    return each.groupBy("group").agg(F.max(F.struct(rate.alias("r"), F.col("count").alias("n"))).alias("m")).select("group", F.col("m.r").alias("co_rate"), F.col("m.n").alias("co_count"))


def severity(test: Column, co_rate_: Column, co_count: Column) -> Column:
    return F.when(test, "inofensiva").when((co_rate_ >= 0.5) & (co_count >= 2), "costosa").otherwise("latente")


def ranked(groups_: DataFrame, score: str = "score") -> DataFrame:
    """``groups_`` with id: d0 for the dearest, and so on."""
    placed = numbered(groups_, "__place", F.col(score).desc(), F.col("group"))
    return placed.withColumn("id", F.concat(F.lit("d"), F.col("__place").cast("string"))).drop("__place")


def suggestion(groups_: DataFrame, members: DataFrame, coupling: DataFrame, folders: DataFrame) -> DataFrame:
    """(group, dir, file, warn): where a group's copies could be put once, and folders that would then depend in a circle.

    The folder is the copies' own if they share one; else a shared one (utils, common, ...) below the
    deepest folder above them all, else that folder.  ``groups_`` has group and name, ``coupling`` (from,
    to), ``folders`` (dir).
    """
    own = members.select("group", "file").distinct().withColumn("parts", F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1))
    ends = own.groupBy("group").agg(F.min("parts").alias("lo"), F.max("parts").alias("hi"), F.count_distinct("parts").alias("dirs"), F.min("file").alias("first"))
    # what the first and the last of sorted paths share, all between them share
    depth = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size("lo"), F.size("hi"))), lambda n: (n > 0) & (F.slice("lo", F.lit(1), n) == F.slice("hi", F.lit(1), n))))
    above = ends.withColumn("above", F.array_join(F.slice("lo", F.lit(1), depth), "/"))
    shared = folders.filter(F.col("dir").rlike(r"(?i)(^|/)(utils?|shared|common|lib|helpers)$")).agg(F.min_by("dir", F.struct(F.length("dir"), F.col("dir"))).alias("shared"))
    placed = above.crossJoin(F.broadcast(shared))
    fits = F.col("shared").isNotNull() & ((F.col("above") == "") | F.col("shared").startswith(F.col("above")))
    target = F.when(F.col("dirs") == 1, F.col("above")).when(fits, F.col("shared")).when(F.col("above") != "", F.col("above")).otherwise(F.coalesce("shared", F.lit(".")))
    named = placed.withColumn("dir", target).join(groups_.select("group", "name"), "group")
    ext = F.regexp_extract("first", r"\.[^./]+$", 0)
    file = F.concat(F.when(F.col("dir") != "", F.concat("dir", F.lit("/"))).otherwise(""), F.coalesce("name", F.lit("compartido")), ext)
    found = named.select("group", "dir", file.alias("file"))
    there = own.select("group", F.array_join("parts", "/").alias("to")).distinct()
    circle = found.join(there, "group").filter(F.col("dir") != F.col("to")).join(coupling.select(F.col("from").alias("dir"), "to"), ["dir", "to"]).groupBy("group").agg(F.array_sort(F.collect_set("to")).alias("warn"))
    return found.join(circle, "group", "left").select("group", "dir", "file", F.coalesce("warn", F.array().cast("array<string>")).alias("warn"))


def repeated_literals(literals: DataFrame, value: str, owner: str, *, uses: int = 3, files: int = 2, sample: int = 12) -> DataFrame:
    """(value, count, files, sample, sev): literals used ``uses`` times or more in ``files`` files or more."""
    per = literals.groupBy(value, owner).agg(F.count("*").alias("n"))
    found = per.groupBy(value).agg(F.sum("n").alias("count"), F.count("*").alias("files")).filter((F.col("count") >= uses) & (F.col("files") >= files))
    # of each value's owners just the first are gathered
    first = per.join(found.select(value), value, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(value).orderBy(owner))).filter(F.col("place") <= sample)
    found = found.join(first.groupBy(value).agg(F.array_sort(F.collect_list(owner)).alias("sample")), value)
    return found.withColumn("sev", F.when((F.col("files") >= 3) & (F.col("count") >= 4), "media").otherwise("info"))


def homonyms(names: DataFrame, name: str, owner: str, *, least: int = 5) -> DataFrame:
    """(name, owner, files): names of ``least`` characters or more in two files or more, a row for each file."""
    each = names.filter((F.length(name) >= least) & ~F.col(name).isin(COMMON)).select(F.col(name).alias("name"), F.col(owner).alias("owner")).distinct()
    sized = each.groupBy("name").agg(F.count("*").alias("files")).filter("files >= 2")
    return each.join(sized, "name").select("name", "owner", "files")


def named_constant(literals: DataFrame, constants: DataFrame, value: str) -> DataFrame:
    """``literals`` with existing: of the ``constants`` (value, file, name, line) that hold the value the first by file and line."""
    first = constants.groupBy(value).agg(F.min(F.struct("file", "line", "name")).alias("existing"))
    return literals.join(first, value, "left")


def line_differences(left: DataFrame, right: DataFrame, line: str) -> DataFrame:
    """(side, line): lines, white space made single, that only one side has."""
    norm = F.trim(F.regexp_replace(line, r"[ \t]+", " "))
    a, b = (x.select(norm.alias("line")).filter("line <> ''").distinct() for x in (left, right))
    only = lambda x, y, side: x.join(y, "line", "left_anti").select(F.lit(side).alias("side"), "line")
    return only(a, b, "left").union(only(b, a, "right"))


def cost(lines: Column, copies: Column, co_rate: Column, owners: Column, test: Column, files: Column) -> Column:
    """What a group of copies costs to keep, at most 100."""
    score = 8 * F.sqrt(lines * (copies - 1)) * (1 + 2 * co_rate) * F.when(owners > 1, 1.25).otherwise(1.0) * F.when(test, 0.3).otherwise(1.0) * F.when(files == 1, 0.7).otherwise(1.0)
    return F.least(F.lit(100), F.floor(score + 0.5).cast("int"))


def overlap_in_file(units: DataFrame) -> DataFrame:
    """Units (file, start, end) that lie within no other of the same file."""
    inner = Window.partitionBy("file").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("__end", F.max("end").over(inner)).filter("__end is null or __end < end").drop("__end")


#: Members of a group above which nested ones aren't looked for.
MANY = 60


def apart(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) without those whose units (unit, file, start, end) overlap in one file; ends are inclusive."""
    side = lambda x: units.select(F.col("unit").alias(x), *[F.col(c).alias(f"__{c}_{x}") for c in ("file", "start", "end")])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    over = (F.col("__file_a") == F.col("__file_b")) & (F.col("__start_a") <= F.col("__end_b")) & (F.col("__start_b") <= F.col("__end_a"))
    return met.filter(~F.coalesce(over, F.lit(False))).select(*pairs.columns)


def outermost(members: DataFrame) -> DataFrame:
    """``members`` (group, unit, file, start, end, ...) without units that lie in a longer one of their group and file.

    Groups of more than MANY keep all, and a group of which one unit is left goes.  Whether a longer one holds a unit is
    told by the furthest end of those that begin before it, and of those that begin with it.
    """
    place = Window.partitionBy("group", "file").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("group", "file", "start")
    size = members.groupBy("group").agg(F.count("*").alias("__n"))
    held = (F.coalesce(F.max("end").over(place), F.lit(-1)) >= F.col("end")) | (F.max("end").over(same) > F.col("end"))
    kept = members.withColumn("__held", held).join(size, "group").filter((F.col("__n") > MANY) | ~F.col("__held")).drop("__held", "__n")
    left = kept.groupBy("group").agg(F.count("*").alias("__n")).filter("__n > 1").select("group")
    return kept.join(left, "group", "left_semi")


def duplicated(members: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """(file, lines, pct, groups, sev, cost) of files with copies.

    ``members`` (group, file, start, end) with inclusive ends, ``groups`` (group, sev, score), ``files`` (file, loc).  Lines
    that several ranges cover count once; pct is their share of loc, 1 at most, to two digits; a file
    has the severity ``costosa`` if one of its groups has it.
    """
    before = Window.partitionBy("file").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end").over(before)
    # of each range the lines that no earlier one has: summed they are the union
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(reached + 1, F.col("start"))) + 1)
    lines = members.withColumn("__new", new).groupBy("file").agg(F.sum("__new").cast("long").alias("lines"))
    about = members.select("file", "group").distinct().join(groups.select("group", "sev", "score"), "group").groupBy("file").agg(F.count("*").alias("groups"), F.when(F.bool_or(F.col("sev") == "costosa"), "costosa").otherwise("latente").alias("sev"), F.max("score").alias("cost"))
    whole = F.greatest(F.lit(1), F.when(F.coalesce("loc", F.lit(0)) == 0, F.col("lines")).otherwise(F.col("loc")))
    return lines.join(about, "file").join(files.select("file", "loc"), "file", "left").select("file", "lines", half_up(F.least(F.lit(1.0), F.col("lines") / whole)).alias("pct"), "groups", "sev", "cost")
