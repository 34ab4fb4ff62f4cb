"""Commits and change sets of repositories, by git's own commands."""

from __future__ import annotations

import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH_SECONDS = 30


def _git(repo: str, *args: str, timeout: int = 10) -> str | None:
    """Output of a command, null if it fails."""
    try:
        return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=timeout, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def current_commit(repo: str) -> str | None:
    return _git(repo, "rev-parse", "HEAD") or None


def branch_commit(repo: str, branch: str) -> str | None:
    return _git(repo, "rev-parse", f"refs/heads/{branch}") or None


def default_branch(repo: str) -> str | None:
    """main if there is such a branch, else master, else none."""
    return next((b for b in ("main", "master") if branch_commit(repo, b)), None)


def reachable(repo: str, commit: str) -> bool:
    return _git(repo, "cat-file", "-t", commit) == "commit"


def refresh(repo: str, branch: str) -> dict:
    """Fetches and resets a clean working tree to the remote branch; says what stood in the way otherwise."""
    if _git(repo, "fetch", "origin", branch, timeout=FETCH_SECONDS) is None:
        return {"refreshed": False, "error": "fetch failed or timed out"}
    on = _git(repo, "rev-parse", "--abbrev-ref", "HEAD")
    if on != branch:
        if _git(repo, "status", "--porcelain"):
            return {"refreshed": False, "error": "dirty working tree"}
        if _git(repo, "checkout", branch) is None:
            return {"refreshed": False, "error": f"cannot check out {branch}"}
    return {"refreshed": _git(repo, "reset", "--hard", f"origin/{branch}") is not None}


def error_category(message: str) -> str:
    """worktree_conflict, dirty_tree, timeout, no_branch or other."""
    text = message.lower()
    rules = {"worktree_conflict": ("worktree", "already checked out"), "dirty_tree": ("dirty", "local changes", "uncommitted"), "timeout": ("timed out", "timeout", "etimedout"), "no_branch": ("no branch", "no main or master", "not found")}
    return next((k for k, words in rules.items() if any(w in text for w in words)), "other")


PROBE_ROW = "name string, path string, head string, branch string, tip string, reachable boolean, refresh_error string"


def probe(name: str, path: str, last: str | None, refreshed: bool = False) -> dict:
    """What git says of one repository: its commits, and whether ``last`` is still one of them.

    With ``refreshed`` it is fetched and reset first; what stood in the way of that is stated, and
    the repository is taken as it is.
    """
    branch = default_branch(path)
    error = refresh(path, branch).get("error") if refreshed and branch else None
    reach = bool(last and reachable(path, last))
    return {"name": name, "path": path, "head": current_commit(path), "branch": branch, "tip": branch_commit(path, branch) if branch else None, "reachable": reach, "refresh_error": error}


def probes(spark: SparkSession, repos: list[tuple[str, str, str | None]], refreshed: bool = False) -> list[dict]:
    """Probes of (name, path, last), by the executors, which see the same file system; one row per repository comes back."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PROBE_ROW))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([probe(r["name"], r["path"], r["last"], refreshed) for r in batch.to_pylist()], schema=schema)

    rows = spark.createDataFrame(repos, "name string, path string, last string").repartition(max(1, len(repos) // 8))
    return sorted((r.asDict() for r in rows.mapInArrow(run, PROBE_ROW).collect()), key=lambda r: r["name"])


def name_status(repo: str, since: str, branch: str) -> str:
    """The output of a diff by names and letters, empty if it fails."""
    return _git(repo, "diff", "--name-status", f"{since}..{branch}", timeout=60) or ""


def diff_lines(spark: SparkSession, repos: list[tuple[int, str, str]]) -> DataFrame:
    """(repo_id, line) of the changes up to HEAD of (repo_id, path, since), by the executors; no diff reaches the driver."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lines = name_status(r["path"], r["since"], "HEAD").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([r["repo_id"]] * len(lines), pa.int64()), pa.array(lines, pa.string())], names=["repo_id", "line"])

    rows = spark.createDataFrame(repos, "repo_id long, path string, since string").repartition(max(1, len(repos) // 8))
    return rows.mapInArrow(run, "repo_id long, line string")


def parsed_changes(lines: DataFrame) -> DataFrame:
    """(repo_id, path, status) of rows (repo_id, line): added, modified or deleted.

    A renamed file is deleted under its old name and added under its new one; other letters are
    ignored.
    """
    parts = F.split("line", "\t")
    letter = F.substring(parts[0], 1, 1)
    one = lambda p, s: F.struct(p.alias("path"), F.lit(s).alias("status"))
    found = (
        F.when(letter == "A", F.array(one(F.get(parts, F.lit(1)), "added")))
        .when(letter == "M", F.array(one(F.get(parts, F.lit(1)), "modified")))
        .when(letter == "D", F.array(one(F.get(parts, F.lit(1)), "deleted")))
        .when(letter == "R", F.array(one(F.get(parts, F.lit(1)), "deleted"), one(F.get(parts, F.lit(2)), "added")))
    )
    return lines.select("repo_id", F.explode(found).alias("c")).select("repo_id", "c.path", "c.status")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same from two snapshots (repo_id, path, hash), where there is no git: by content."""
    rows = before.withColumnRenamed("hash", "was").join(after.withColumnRenamed("hash", "is"), ["repo_id", "path"], "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    return rows.select("repo_id", "path", status.alias("status")).filter("status is not null")


def repo_snapshot(spark: SparkSession, repos: list[tuple[str, str]]) -> DataFrame:
    """(name, head, branch, tip) of (name, path), asked by the executors."""
    rows = [(p["name"], p["head"], p["branch"], p["tip"]) for p in probes(spark, [(n, p, None) for n, p in repos])] if repos else []
    return spark.createDataFrame(rows, "name string, head string, branch string, tip string")
