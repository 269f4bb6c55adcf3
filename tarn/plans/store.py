"""Keeping results: graphs and prompts as text, prints, saved sets and overrides as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json): a JSON line for each node and edge, to be written as text."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("json"))
    return line(nodes, "node").union(line(edges, "edge"))


def prompt(files: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """(id, text): for each file (id, role, summary) what it exports (file, name) and where its edges go, in order of names."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("kind", F.lit("→"), "target"))), "; ").alias("out"))
    named = exports.groupBy(F.col("file").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    dash = lambda c: F.coalesce(F.col(c), F.lit("—"))
    note = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" | "), "summary")).otherwise("")
    text = F.concat(F.lit("- "), "id", F.lit(" ["), "role", F.lit("] exports: "), dash("names"), note, F.lit("\n    sale: "), dash("out"))
    return files.join(out, "id", "left").join(named, "id", "left").select("id", text.alias("text"))


def suggested(answers: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Relations (source, target, card, label) that a model proposed, those that can be taken.

    Both ends are ``nodes`` (id) and differ, no edge ``known`` (source, target) joins them either way,
    and of a pair proposed twice the first by source counts; labels are cut at 60 characters.
    """
    ends = lambda x, y: [F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")]
    real = answers.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi").filter("source <> target")
    fresh = real.select("*", *ends("source", "target")).join(known.select(*ends("source", "target")).distinct(), ["lo", "hi"], "left_anti")
    one = fresh.groupBy("lo", "hi").agg(F.min(F.struct("source", "target", "card", F.substring("label", 1, 60).alias("label"))).alias("r"))
    return one.select("r.*")


def save(df: DataFrame, folder: str, name: str, *, add: bool = False) -> None:
    """A print, a saved set (name, id) or overrides, as the table ``name`` below ``folder``; ``add`` keeps what is there."""
    df.write.mode("append" if add else "overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")


def region(masks: DataFrame, mask: int, name: str) -> DataFrame:
    """(name, id): a region of sets (id, mask) as a set of its own, to be saved."""
    return masks.filter(F.col("mask") == mask).select(F.lit(name).alias("name"), "id")
