"""A git log as a data source whose partitions are ranges of commits.

    spark.dataSource.register(GitHistory)
    spark.read.format("git_history").options(path=root, table="touches").load()
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Newest commits that are read, and commits that one task reads.
MOST, PER_TASK = 5000, 500
#: Rows of a batch.
ROWS = 10_000

SCHEMAS = {
    "commits": "i long, hash string, author string, ts timestamp, msg string",
    "touches": "i long, status string, path string, from_path string, add long, del long",
}
_FORM = "--format=@@%h\x1f%an\x1f%aI\x1f%s"
_NUMBERS = re.compile(r"(\d+|-)\t(\d+|-)\t(.+)$")


def git(root: str, *args: str) -> list[str]:
    return ["git", "-c", "safe.directory=*", "-c", "core.quotepath=off", "-C", root, *args]


def _lines(root: str, *args: str) -> Iterator[str]:
    """What git says, line by line; an error if it ends with one."""
    with subprocess.Popen(git(root, *args), stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        for line in run.stdout:
            yield line.rstrip(b"\n").decode("utf-8", "replace")
        said = run.stderr.read().decode("utf-8", "replace")
    if run.returncode:
        raise RuntimeError(f"git {args[0]}: {said.strip()[:500]}")


_ESCAPED = re.compile(rb"\\([0-7]{3}|.)")
_NAMED = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v"}


def _path(name: str) -> str:
    """A path as it is; git quotes one that has quotes or control characters."""
    if not (len(name) > 1 and name[0] == name[-1] == '"'):
        return name
    raw = _ESCAPED.sub(lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _NAMED.get(m[1], m[1]), name[1:-1].encode("utf-8", "surrogateescape"))
    return raw.decode("utf-8", "replace")


def _by_commit(lines: Iterator[str]) -> Iterator[tuple[str, list[str]]]:
    """(head, lines below it) for each commit."""
    head, below = None, []
    for line in lines:
        if line.startswith("@@"):
            if head is not None:
                yield head, below
            head, below = line[2:], []
        elif line:
            below.append(line)
    if head is not None:
        yield head, below


def commits_of(log: Iterator[str], first: int = 0) -> Iterator[tuple]:
    """(i, hash, author, ts, msg) of the commits in a log's lines, numbered from ``first``."""
    for i, (head, _) in enumerate(_by_commit(log), first):
        name, author, moment, msg = head.split("\x1f", 3)
        yield i, name, author, datetime.fromisoformat(moment).astimezone(timezone.utc), msg


def touches_of(named: Iterator[str], counted: Iterator[str], first: int = 0) -> Iterator[tuple]:
    """(i, status, path, from_path, add, del) from a log with statuses and renames and one of the same commits with line counts."""
    for i, ((_, names), (_, numbers)) in enumerate(zip(_by_commit(named), _by_commit(counted), strict=True), first):
        size = {_path(m[3]): (int(m[1]) if m[1] != "-" else 0, int(m[2]) if m[2] != "-" else 0) for m in map(_NUMBERS.match, numbers) if m}
        for line in names:
            code, *paths = line.split("\t")
            paths = [_path(p) for p in paths]
            yield i, code[0], paths[-1], paths[0] if code[0] in "RC" else None, *size.get(paths[-1], (0, 0))


@dataclass
class CommitRange(InputPartition):
    """``count`` commits after the newest ``skip`` of ``head``; ``first`` is the number of the oldest of them."""

    head: str
    skip: int
    count: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, root: str, table: str, most: int, per_task: int):
        self.root, self.table, self.most, self.per_task = root, table, most, per_task

    def partitions(self) -> list[CommitRange]:
        """The driver asks for the head and a number only.  Ranges keep the head, so that commits made meanwhile don't move the ranges."""
        found = subprocess.run(git(self.root, "rev-parse", "--verify", "-q", "HEAD"), capture_output=True, text=True)
        if found.returncode:
            return [CommitRange("", 0, 0, 0)]
        head = found.stdout.strip()
        n = int(next(_lines(self.root, "rev-list", "--count", f"--max-count={self.most}", head, "--", ".")))
        return [CommitRange(head, at, min(self.per_task, n - at), max(0, n - at - self.per_task)) for at in range(0, n, self.per_task)] or [CommitRange(head, 0, 0, 0)]

    def _log(self, part: CommitRange, *more: str) -> Iterator[str]:
        return _lines(self.root, "log", "--reverse", "--relative", f"--skip={part.skip}", f"--max-count={part.count}", *more, part.head, "--", ".")

    def read(self, partition: CommitRange) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        long, text = pa.int64(), pa.string()
        types = {"commits": (long, text, text, pa.timestamp("us", "UTC"), text), "touches": (long, text, text, text, long, long)}[self.table]
        names = [x.split()[0] for x in SCHEMAS[self.table].split(", ")]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        if self.table == "commits":
            rows = commits_of(self._log(partition, _FORM), partition.first)
        else:
            rows = touches_of(self._log(partition, _FORM, "--name-status", "-M"), self._log(partition, _FORM, "--numstat", "--no-renames"), partition.first)
        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class GitHistory(DataSource):
    """Commits or touches of a repository that all executors can read.

    Options: path; table, ``commits`` or ``touches``; most, the newest commits that are read (5,000);
    perTask, commits of one task (500).  Commits are numbered from 0, oldest first.  A task asks git for its own range and reads
    what it says line by line, holding one commit at most; it names the same commits when it runs again.
    A folder without commits gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def _table(self) -> str:
        table = self.options.get("table", "touches")
        if table not in SCHEMAS:
            raise ValueError(f"table is {' or '.join(SCHEMAS)}, not {table}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._table(), int(self.options.get("most", MOST)), int(self.options.get("perTask", PER_TASK)))


def read(spark: SparkSession, root: str, table: str, most: int = MOST, per_task: int = PER_TASK):
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").options(path=root, table=table, most=str(most), perTask=str(per_task)).load()
