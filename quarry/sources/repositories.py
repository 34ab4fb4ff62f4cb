"""Repositories and their working trees as DataFrames.

Directories are walked and files read by the executors, one repository per row,
so the driver only lists the immediate children of the root. All need to see
the same file system. Hidden and underscored names are files like any others,
which Spark's own listing would leave out.
"""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import number_of_key
from quarry.operators import fixed_values as V
from quarry.operators.parsers import first_paragraph

FILE_ROW = "repo_id long, repo string, path string, length long, content string"


def is_repository(folder: Path) -> bool:
    """A directory with .git (a directory, or a file as in submodules) and a project marker in it or in src."""
    if folder.name in V.SKIPPED_DIRS or not folder.is_dir() or not (folder / ".git").exists():
        return False
    return any((folder / m).exists() or (folder / "src" / m).exists() for m in V.PROJECT_MARKERS)


def discover(root: str) -> list[str]:
    """Paths of the repositories that are immediate children of ``root``, links to directories included, sorted."""
    base = Path(root)
    if not base.exists():
        raise FileNotFoundError(f"Root directory does not exist: {root}")
    if not base.is_dir():
        raise NotADirectoryError(f"Root path is not a directory: {root}")
    return sorted(str(p) for p in base.iterdir() if is_repository(p))


def repository_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, name, path); the id is a number of the name."""
    rows = spark.createDataFrame([(os.path.basename(p.rstrip("/")), p) for p in paths], "name string, path string")
    return rows.select(number_of_key(F.lit("repo"), F.col("name")).alias("id"), "name", "path")


def working_tree(repos: DataFrame, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """(repo_id, repo, path, length, content) of every regular file below the repositories, without skipped directories.

    The content of a file beyond ``max_bytes`` or that cannot be read is null; bytes that are no
    UTF-8 are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(FILE_ROW)

    def content(path: str, size: int) -> str | None:
        if size > max_bytes:
            return None
        try:
            with open(path, "rb") as f:
                return f.read().decode("utf-8", "replace")
        except OSError:
            return None

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for repo_id, name, root in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for top, dirs, files in os.walk(root):
                    dirs[:] = sorted(d for d in dirs if d not in V.SKIPPED_DIRS and not os.path.islink(os.path.join(top, d)))
                    for f in sorted(files):
                        full = os.path.join(top, f)
                        if os.path.islink(full) or not os.path.isfile(full):
                            continue
                        size = os.path.getsize(full)
                        rows.append({"repo_id": repo_id, "repo": name, "path": os.path.relpath(full, root).replace(os.sep, "/"), "length": size, "content": content(full, size)})
                        held += min(size, max_bytes)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    n = max(1, min(200, repos.sparkSession.sparkContext.defaultParallelism * 4))
    return repos.select("id", "name", "path").repartition(n, "id").mapInArrow(run, schema)


def tech_stack(files: DataFrame) -> DataFrame:
    """(repo_id, stack): languages by their marker at the root, with the known dependencies that it names."""
    at = lambda p: F.max(F.when(F.col("path") == p, F.coalesce("content", F.lit("")))).alias(p.replace(".", "_"))
    rows = files.filter(F.col("path").isin("mix.exs", "package.json", "Gemfile", "Cargo.toml", "go.mod")).groupBy("repo_id").agg(*[at(p) for p in ("mix.exs", "package.json", "Gemfile", "Cargo.toml", "go.mod")])
    mix, pkg = F.col("mix_exs"), F.col("package_json")
    deps = F.from_json(pkg, "dependencies map<string,string>, devDependencies map<string,string>")
    names = F.concat(*[F.coalesce(F.map_keys(deps[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    flags = [F.when(mix.isNotNull(), "elixir"), *[F.when(F.contains(mix, F.lit("{:" + d + ",")), d) for d in V.ELIXIR_DEPS]]
    flags += [F.when(pkg.isNotNull(), "node"), *[F.when(F.array_contains(names, d) | F.array_contains(names, f"@{d}/core"), d) for d in V.NODE_DEPS]]
    flags += [F.when(F.col(c).isNotNull(), name) for c, name in (("Gemfile", "ruby"), ("Cargo_toml", "rust"), ("go_mod", "go"))]
    return rows.select("repo_id", F.array_compact(F.array(*flags)).alias("stack"))


def key_files(files: DataFrame) -> DataFrame:
    """(repo_id, key_files): known files at the root, then known top-level directories that hold any file."""
    flags = [F.max(F.when(F.col("path") == f, f)) for f in V.KEY_FILES] + [F.max(F.when(F.startswith("path", F.lit(d + "/")), d + "/")) for d in V.KEY_DIRS]
    return files.groupBy("repo_id").agg(F.array_compact(F.array(*flags)).alias("key_files"))


def descriptions(files: DataFrame) -> DataFrame:
    """(repo_id, description): the first paragraph of README.md, or of CLAUDE.md where that has none."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([first_paragraph(c or "") for c in batch.column(2).to_pylist()], pa.string())], names=["repo_id", "path", "text"])

    rows = files.filter(F.col("path").isin("README.md", "CLAUDE.md")).select("repo_id", "path", F.substring("content", 1, V.README_CHARS).alias("head"))
    found = rows.mapInArrow(run, "repo_id long, path string, text string").filter("text is not null")
    return found.groupBy("repo_id").agg(F.max_by("text", "path").alias("description"))


def metadata(repos: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, path, description, stack, key_files) of every repository."""
    rows = repos
    for part in (descriptions(files), tech_stack(files), key_files(files)):
        rows = rows.join(part.withColumnRenamed("repo_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("stack", F.coalesce("stack", none)).withColumn("key_files", F.coalesce("key_files", none))
