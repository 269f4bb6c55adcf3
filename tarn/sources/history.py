"""Change histories as tables of commits and touches."""

from __future__ import annotations

import contextlib
import io
import json
import os
import shutil
import subprocess
import tarfile
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gitlog


def _git(root: str, *args: str) -> str:
    return subprocess.run(gitlog.git(root, *args), capture_output=True, text=True, check=True, errors="replace").stdout


def history(spark: SparkSession, root: str, most: int = gitlog.MOST, per_task: int = gitlog.PER_TASK) -> tuple[DataFrame, DataFrame]:
    """commits (i, hash, author, ts, msg) and touches (i, status, path, from_path, add, del), read in ranges of commits."""
    return gitlog.read(spark, root, "commits", most, per_task), gitlog.read(spark, root, "touches", most, per_task)


def status(spark: SparkSession, root: str) -> DataFrame:
    """(path, status) of what isn't committed."""
    rows = spark.createDataFrame([(x,) for x in _git(root, "status", "--porcelain=v1").splitlines()], "line string")
    code, path = F.substring("line", 1, 2), F.element_at(F.split(F.substring("line", 4, 4096), " -> "), -1)
    named = F.when(code == "??", "untracked").when(code.contains("A"), "added").when(code.contains("D"), "deleted").otherwise("modified")
    return rows.select(path.alias("path"), named.alias("status"))


def head(root: str) -> str | None:
    """The commit that is checked out, as a key for what is kept; None where there is none."""
    try:
        return _git(root, "rev-parse", "HEAD").strip()
    except (subprocess.CalledProcessError, OSError):
        return None


def diff(root: str, path: str) -> str:
    """What isn't committed of one file."""
    return _git(root, "diff", "HEAD", "--", path)


def blame(root: str, names: DataFrame) -> DataFrame:
    """(id, line, hash, author, ts, content): who last changed each line of the files ``names`` (id), white space aside.

    Tasks ask git for a file each, so the repository must be readable by all executors; a file that git
    doesn't know has no rows.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["id"]:
                done = subprocess.run(["git", "-C", root, "blame", "-w", "--line-porcelain", "--", name], capture_output=True, text=True, errors="replace")
                rows, about = [], {}
                for x in done.stdout.split("\n") if done.returncode == 0 else []:
                    if x.startswith("\t"):
                        rows.append((name, len(rows) + 1, about["hash"], about["author"], int(about["author-time"]), x[1:]))
                        about = {}
                    elif not about:
                        about = {"hash": x.split(" ")[0]}
                    else:
                        key, _, value = x.partition(" ")
                        about[key] = value
                yield pd.DataFrame(rows, columns=["id", "line", "hash", "author", "t", "content"])

    found = names.select("id").mapInPandas(ask, "id string, line int, hash string, author string, t long, content string")
    return found.withColumn("t", F.timestamp_seconds("t")).withColumnRenamed("t", "ts")


def changed_since(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(path, status): A, M or D for each file that differs from ``ref``; a rename is D and A, an untracked file A."""
    lines = [x.split("\t") for x in _git(root, "diff", "--name-status", "-M", ref).splitlines() if x]
    rows = [(x[1], x[0][0]) for x in lines if x[0][0] in "AMD"]
    rows += [y for x in lines if x[0][0] == "R" for y in ((x[1], "D"), (x[2], "A"))]
    rows += [(x, "A") for x in _git(root, "ls-files", "--others", "--exclude-standard").splitlines() if x]
    return spark.createDataFrame(rows, "path string, status string")


@contextlib.contextmanager
def base_tree(root: str, ref: str) -> Iterator[str]:
    """A folder with the tree as it was at ``ref``, for as long as it is used.

    It lies where ``root`` does, which all executors can read, below a hidden name that no scan enters.
    """
    top = tempfile.mkdtemp(prefix=".base-", dir=os.path.dirname(os.path.abspath(root)))
    try:
        packed = subprocess.run(["git", "-C", root, "archive", ref], capture_output=True, check=True).stdout
        with tarfile.open(fileobj=io.BytesIO(packed)) as t:
            t.extractall(top, filter="data")
        yield top
    finally:
        shutil.rmtree(top, ignore_errors=True)


def info(root: str) -> dict[str, str] | None:
    """branch and head of a repository; None where there is none."""
    key = head(root)
    return None if key is None else {"head": key, "branch": _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()}


def settings(path: str) -> dict:
    """languages, dupes, aux and auxOff of a JSON file; empty where it is absent or isn't JSON."""
    empty = {"languages": {}, "dupes": {}, "aux": [], "auxOff": []}
    if not os.path.exists(path):
        return empty
    with open(path, encoding="utf-8") as f:
        try:
            found = json.load(f)
        except ValueError:
            return empty
    return empty | {k: v for k, v in found.items() if k in empty} if isinstance(found, dict) else empty
