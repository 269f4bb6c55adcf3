"""A repository's parsed files and links, kept in a folder and changed where files change."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut
from ..sources.languages import BUILTIN, Grammar
from . import links, parse

#: Folders that a table is dealt to by its file's name; only those with a change are written anew.
BUCKETS = 64
TABLES = ("coded", "statements", "defined", "offered", "spaced", "links", "outside")
SOURCE = "id string, ext string, lang string, content string"


def _key(table: DataFrame) -> str:
    """The column that says whose row it is."""
    return next(k for k in ("source", "file", "id") if k in table.columns)


@dataclass
class Update:
    """What an update did: the version that it made, the files that it parsed, those that went, and those whose links it told again."""

    version: int
    parsed: DataFrame
    removed: DataFrame
    relinked: DataFrame


class Repository:
    """Tables of a repository under ``path``, a folder that all executors share.

    Each table lies in ``path/table/version=v/bucket=b`` by the hash of a file's name; ``path/manifest``
    tells which version of each bucket is the newest.  An update writes the buckets in which
    something changed under its own number and the manifest last, so a reader never sees half of
    one, and one that failed is written over by the next.
    """

    def __init__(self, spark: SparkSession, path: str, grammar: Grammar = BUILTIN, buckets: int = BUCKETS):
        self.spark, self.path, self.grammar, self.buckets = spark, path.rstrip("/"), grammar, buckets

    def _exists(self, name: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(conf).exists(at)

    def _manifest(self, version: int | None = None) -> tuple[int, list[tuple[int, int]]]:
        """The newest version whose manifest is whole (-1: none), and (version, bucket) of what is in force: at most one for each bucket."""
        number = -1
        while self._exists(f"manifest/{number + 1}/_SUCCESS") and number != version:
            number += 1
        if number < 0:
            return -1, []
        return number, [(r["version"], r["bucket"]) for r in self.spark.read.parquet(f"{self.path}/manifest/{number}").collect()]

    @property
    def version(self) -> int:
        return self._manifest()[0]

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """One of TABLES as it is now, or as it was."""
        _, live = self._manifest(version)
        if not live:
            raise ValueError(f"{self.path} holds no version")
        kept = self.spark.read.parquet(f"{self.path}/schemas").filter(F.col("name") == name).head()["fields"]
        all_ = self.spark.read.schema(StructType.fromJson(json.loads(kept)).add("version", "integer").add("bucket", "integer")).parquet(f"{self.path}/{name}")
        return all_.filter(F.concat_ws("/", F.col("version").cast("string"), F.col("bucket").cast("string")).isin([f"{v}/{b}" for v, b in live])).drop("version", "bucket")

    def parsed(self) -> links.Parsed:
        return links.Parsed(*[self.table(n) for n in TABLES[:5]])

    def linked(self) -> tuple[links.Parsed, DataFrame, DataFrame]:
        """What ``world.build`` takes as ``parsed``."""
        return self.parsed(), self.table("links"), self.table("outside")

    def create(self, files: DataFrame, modules: DataFrame | None = None) -> Update:
        """The first version, of all ``files`` (id, ext, lang, content)."""
        said, found, outside = links.linked(files, modules, self.grammar)
        ids = said.coded.select("id")
        tables = dict(zip(TABLES, [*said.tables().values(), found, outside], strict=True))
        # a table may be empty, which leaves no file to tell its columns
        self.spark.createDataFrame([(n, t.schema.json()) for n, t in tables.items()], "name string, fields string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schemas")
        self._write(tables, self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket")), 0, [])
        return Update(0, ids, ids.limit(0), ids)

    def _write(self, tables: dict[str, DataFrame], touched: DataFrame, version: int, live: list[tuple[int, int]]) -> None:
        buckets = sorted(r["bucket"] for r in touched.collect())
        for name, table in tables.items():
            rows = table.withColumn("bucket", self._bucket(_key(table))).filter(F.col("bucket").isin(buckets))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/version={version}")
        kept = [(v, b) for v, b in live if b not in set(buckets)] + [(version, b) for b in buckets]
        self.spark.createDataFrame(kept, "version int, bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")

    def update(self, files: DataFrame, removed: DataFrame | None = None, modules: DataFrame | None = None) -> Update:
        """Takes in ``files`` (id, ext, lang, content), new or changed, and drops ``removed`` (id).

        Content is held against what is stored; a file that is the same isn't parsed.  Links are told again for files
        that changed; for those that import a path which came or went, by any of the paths they try; and for those with a word
        that a changed file defines or defined, as those of languages that link by name may
        see another file now.  All other rows stay, and the result is that of parsing everything.
        """
        number, live = self._manifest()
        old = Repository.parsed(self)
        stored = old.coded.select("id", F.col("content").alias("__was"))
        fresh = files.join(stored, "id", "left").filter(F.col("__was").isNull() | (F.col("__was") != F.col("content")))
        changed = cut(fresh.withColumn("__new", F.col("__was").isNull()).drop("__was"))
        gone = removed if removed is not None else changed.select("id").limit(0)
        gone = cut(gone.select("id").join(changed, "id", "left_anti").join(stored.select("id"), "id", "left_semi").distinct())
        if changed.isEmpty() and gone.isEmpty():
            return Update(number, changed.select("id"), gone, gone)
        said = links.Parsed.of(changed.drop("__new"), self.grammar)
        away = cut(changed.select("id").union(gone))
        now = {}
        for name, before, after in zip(TABLES, old.tables().values(), said.tables().values(), strict=False):
            kept = before.join(away.withColumnRenamed("id", _key(before)), _key(before), "left_anti")
            now[name] = kept.unionByName(after.select(*before.columns))
        every = links.Parsed(*[now[n] for n in TABLES[:5]])
        moved = changed.filter("__new").select("id").union(gone)
        again = cut(self._affected(every, old, away, moved).union(changed.select("id")).distinct())
        found, outside = links.link(every, modules, self.grammar, again)
        drop = cut(again.union(gone).withColumnRenamed("id", "source"))
        for name, after in (("links", found), ("outside", outside)):
            before = self.table(name)
            now[name] = before.join(drop, "source", "left_anti").unionByName(after.select(*before.columns))
        touched = cut(drop.select(self._bucket("source").alias("bucket")).distinct())
        self._write({n: cut(t.withColumn("__b", self._bucket(_key(t))).join(F.broadcast(touched.withColumnRenamed("bucket", "__b")), "__b", "left_semi").drop("__b")) for n, t in now.items()}, touched, number + 1, live)
        return Update(number + 1, changed.select("id"), gone, again)

    def _affected(self, every: links.Parsed, old: links.Parsed, away: DataFrame, moved: DataFrame) -> DataFrame:
        """(id) of the files that aren't ``away`` themselves but whose links may be others now."""
        out = []
        if not moved.isEmpty():
            # a path that came or went, without its ending, is a tail that some statement may have meant
            stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]+$", "")
            folder = F.element_at(F.split("id", "/"), -2)
            tails = moved.select(F.explode(F.array(stem(F.col("id")), F.when(F.size(F.split("id", "/")) > 1, folder), F.regexp_extract("id", r"([^/]+)$", 1))).alias("tail")).filter("tail is not null").distinct()
            said = F.concat(F.array("spec"), F.transform("names", lambda n: n["name"]))
            parts = every.statements.select("id", F.explode(F.flatten(F.transform(said, lambda s: F.split(s, r"[/.\\:]+")))).alias("tail"), "spec")
            whole = every.statements.select("id", F.regexp_extract("spec", r"([^/]+)$", 1).alias("tail"))
            # ``./`` and ``..`` alone mean a folder's index
            folders = every.statements.filter(r"spec rlike '^(\\.{1,2}/?)*$' or spec rlike '/$'").select("id")
            out += [parts.select("id", "tail").union(whole).join(F.broadcast(tails), "tail").select("id"), folders]
            crates = moved.filter("id rlike '(^|/)(lib|main)\\.rs$'")
            out.append(every.coded.filter("lang = 'rust'").select("id") if not crates.isEmpty() else moved.limit(0))
        defined = lambda p: p.defined.join(away.withColumnRenamed("id", "file"), "file", "left_semi").select(F.col("name").alias("token"))
        names = cut(defined(every).union(defined(old)).distinct())
        linking = every.coded.filter(F.col("lang").isin([*self.grammar.with_resolver("namespace"), *self.grammar.with_resolver("go")]))
        out.append(parse.words(linking).join(names, "token").select("id"))
        # a namespace or a Go folder that came or went makes imports inner or outer
        spaces = lambda p: p.spaced.join(away, "id", "left_semi").select("lang", "ns").distinct()
        shifted = cut(spaces(every).unionByName(spaces(old)).filter("ns <> ''").distinct())
        told = every.statements.filter("how = 'namespace'").select("id", "lang", F.explode(F.array(F.regexp_replace(F.translate("spec", "\\", "."), r"\.\*$", ""), F.regexp_extract(F.translate("spec", "\\", "."), r"^(.+)\.[^.]*$", 1))).alias("ns"))
        out.append(told.join(F.broadcast(shifted), ["lang", "ns"], "left_semi").select("id"))
        went_go = away.filter("id like '%.go'")
        out.append(every.statements.filter("how = 'go'").select("id") if not went_go.isEmpty() and not moved.isEmpty() else away.limit(0))
        near = reduce(DataFrame.union, out).distinct()
        return near.join(away, "id", "left_anti").join(every.coded.select("id"), "id", "left_semi")
