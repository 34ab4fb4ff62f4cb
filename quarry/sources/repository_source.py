"""Repositories as a Spark data source: committed files, the changes between commits, and a stream of changes.

    register(spark)
    spark.read.format("repositories").load("/code")
    spark.read.format("repositories").option("since", '{"shop": "4f0c"}').load("/code")
    spark.readStream.format("repositories").load("/code")

The driver lists the repositories below the root and their commits; files are
listed and read by the executors, a repository per task. Filters on ``repo``,
``path`` and ``length`` are applied before any content is read. A stream's offset
is the commit of each repository, so what a batch holds is what git says lies
between two offsets, and a batch that is delivered again is the same.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from quarry.operators.fixed_values import MAX_FILE_BYTES
from quarry.sources import git, repositories

SCHEMA = "repo string, path string, change string, length long, commit string, content string"
#: Letters of git's diff; without one git lists a tree, all of which was added.
CHANGES = {"A": "added", "M": "modified", "T": "modified", "D": "deleted"}


@dataclass(frozen=True)
class Span(InputPartition):
    """The files of a repository at ``to``, or what has changed since ``since``."""

    repo: str
    path: str
    since: str | None
    to: str


def _output(span: Span, *args: str) -> bytes:
    return subprocess.run(["git", "-C", span.path, *args], capture_output=True, check=True, timeout=600).stdout


def listed(span: Span) -> list[tuple[str, str, str]]:
    """(path, change, object) of a span, '' for the object of a deleted file. A commit that has gone counts as none."""
    if span.since is None or not git.reachable(span.path, span.since):
        rows = _output(span, "ls-tree", "-r", "-z", span.to).decode("utf-8", "replace").split("\0")
        found = [row.split("\t", 1) for row in rows if row]
        return [(path, "added", meta.split()[2]) for meta, path in found if meta.split()[1] == "blob"]
    parts = _output(span, "diff", "--raw", "--no-renames", "--no-abbrev", "-z", span.since, span.to).decode("utf-8", "replace").split("\0")
    return [(path, CHANGES[letter[0]], "" if letter[0] == "D" else obj) for (_, _, _, obj, letter), path in zip((m.split() for m in parts[:-1:2]), parts[1::2]) if letter[0] in CHANGES]


def read_span(span: Span, keep: list[tuple[str, str, object]], max_bytes: int) -> Iterator[tuple]:
    """Rows of a span; ``keep`` are conditions (column, kind, value) that are checked before a file's content is read."""
    checks = {"eq": lambda x, v: x == v, "in": lambda x, v: x in v, "starts": lambda x, v: x.startswith(v), "ends": lambda x, v: x.endswith(v), "lt": lambda x, v: x < v, "le": lambda x, v: x <= v}
    passes = lambda column, x: all(x is not None and checks[kind](x, v) for c, kind, v in keep if c == column)
    files = [f for f in listed(span) if passes("path", f[0])] if passes("repo", span.repo) else []
    if not files:
        return
    with subprocess.Popen(["git", "-C", span.path, "cat-file", "--batch-command"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as talk:

        def ask(command: str, obj: str) -> int:
            talk.stdin.write(f"{command} {obj}\n".encode())
            talk.stdin.flush()
            return int(talk.stdout.readline().split()[2])

        for path, change, obj in files:
            size = ask("info", obj) if obj else None
            if not passes("length", size):
                continue
            content = None
            if obj and size <= max_bytes:
                ask("contents", obj)
                content = talk.stdout.read(size).decode("utf-8", "replace")
                talk.stdout.read(1)
            yield span.repo, path, change, size, span.to, content
        talk.stdin.close()


def heads(root: str) -> dict[str, tuple[str, str]]:
    """Path and commit of every repository below a root that has one."""
    found = {p.rsplit("/", 1)[-1]: (p, git.current_commit(p)) for p in repositories.discover(root)}
    return {name: at for name, at in found.items() if at[1]}


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, which then lets Python sources see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)

    def streamReader(self, schema) -> RepositoryStream:
        return RepositoryStream(self.options)


class _Reading:
    def __init__(self, options: dict):
        self.root, self.keep = options["path"], []
        self.max_bytes = int(options.get("maxbytes", MAX_FILE_BYTES))
        self.since = json.loads(options.get("since", "{}"))

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition, self.keep, self.max_bytes)


class RepositoryReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in ("repo", "path", "length"):
                self.keep.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Span]:
        wanted = lambda name: all(name == v if kind == "eq" else name in v if kind == "in" else True for c, kind, v in self.keep if c == "repo")
        return [Span(name, path, self.since.get(name), to) for name, (path, to) in heads(self.root).items() if wanted(name) and self.since.get(name) != to]


class RepositoryStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return self.since

    def latestOffset(self) -> dict:
        return {name: to for name, (_, to) in heads(self.root).items()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        at = {p.rsplit("/", 1)[-1]: p for p in repositories.discover(self.root)}
        return [Span(name, at[name], start.get(name), to) for name, to in sorted(end.items()) if start.get(name) != to and name in at]

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the offset."""
