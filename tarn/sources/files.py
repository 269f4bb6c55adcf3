"""Source trees as tables of files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .languages import BUILTIN, Grammar

#: Files read by one task.
FILES_PER_TASK = 200


def paths(root: str, grammar: Grammar = BUILTIN) -> list[tuple[str, str]]:
    """(id, ext) of the files under ``root`` whose extension is known; hidden names and those that a language ignores are left out."""
    found, known, ignored = [], grammar.extensions, grammar.ignored
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in ignored and not n.startswith("."))
        for name in files:
            ext = os.path.splitext(name)[1].lower()
            if not name.startswith(".") and name not in ignored and ext in known:
                found.append((os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/"), ext))
    return sorted(found)


def source_tree(spark: SparkSession, root: str, grammar: Grammar = BUILTIN) -> DataFrame:
    """(id, ext, lang, content) of a tree that all executors can read.

    The driver lists names only; tasks read the files, wrong bytes replaced.  Spark's own binary reader
    won't do, as it passes over names that begin with an underscore.
    """
    listed = paths(root, grammar)
    names = spark.createDataFrame(listed, "id string, ext string").repartition(max(1, len(listed) // FILES_PER_TASK), "id") if listed else spark.createDataFrame([], "id string, ext string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for name in b["id"]:
                with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
                    texts.append(f.read())
            yield b.assign(content=texts)

    return names.mapInPandas(read, "id string, ext string, content string").withColumn("lang", language(F.col("ext"), grammar))


def language(ext: Column, grammar: Grammar = BUILTIN) -> Column:
    out = None
    for e, lang in grammar.extensions.items():
        out = F.when(ext == e, lang) if out is None else out.when(ext == e, lang)
    return out


def modules(root: str, grammar: Grammar = BUILTIN) -> list[tuple[str, str]]:
    """(dir, module) of each go.mod."""
    found = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in grammar.ignored and not n.startswith(".")]
        if "go.mod" in files:
            with open(os.path.join(folder, "go.mod"), encoding="utf-8", errors="replace") as f:
                named = [line.split()[1] for line in f if line.startswith("module ")]
            rel = os.path.relpath(folder, root).replace(os.sep, "/")
            found += [("" if rel == "." else rel, m) for m in named[:1]]
    return found
