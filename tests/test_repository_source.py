"""Repositories as a data source: trees, changes, filters before contents, and a stream into the store."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.plans.store import Store
from quarry.sources import git, repository_source
from quarry.streaming import ingest


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def commit(folder):
    run = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    if not (folder / ".git").exists():
        run("init", "-b", "main")
    run("add", "-A")
    run("commit", "-m", "x", "--allow-empty")
    return git.current_commit(str(folder))


@pytest.fixture()
def code(tmp_path):
    for name in ("shop", "pay"):
        write(tmp_path / "code" / name / "mix.exs", name)
        write(tmp_path / "code" / name / "lib" / "a b.ex", f"defmodule {name.title()}.A do\nend\n")
        write(tmp_path / "code" / name / "lib" / "é.ex", "x" * 50)
        commit(tmp_path / "code" / name)
    return tmp_path / "code"


def load(spark, root, **options):
    repository_source.register(spark)
    return spark.read.format("repositories").options(**options).load(str(root))


def test_trees_and_changes(spark, code):
    rows = {(r.repo, r.path): r for r in load(spark, code, maxbytes="40").collect()}
    assert {k[1] for k in rows} == {"mix.exs", "lib/a b.ex", "lib/é.ex"} and len(rows) == 6
    assert rows["shop", "mix.exs"].content == "shop" and rows["pay", "lib/é.ex"].content is None and rows["pay", "lib/é.ex"].length == 50
    since = {n: git.current_commit(str(code / n)) for n in ("shop", "pay")}
    (code / "shop" / "mix.exs").unlink()
    write(code / "shop" / "lib" / "a b.ex", "changed")
    write(code / "shop" / "src" / "mix.exs", "new")
    write(code / "shop" / "uncommitted", "no")
    subprocess.run(["git", "-C", str(code / "shop"), "add", "lib", "src", "mix.exs"], check=True)
    subprocess.run(["git", "-C", str(code / "shop"), "-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "y"], check=True)
    changes = {(r.repo, r.path, r.change, r.content) for r in load(spark, code, since=json.dumps(since)).collect()}
    assert changes == {("shop", "mix.exs", "deleted", None), ("shop", "lib/a b.ex", "modified", "changed"), ("shop", "src/mix.exs", "added", "new")}
    assert load(spark, code, since=json.dumps({"shop": "0" * 40, "pay": since["pay"]})).count() == 3  # a commit that has gone


def test_filters_come_before_contents(spark, code, monkeypatch):
    seen = []
    monkeypatch.setattr(repository_source.RepositoryReader, "partitions", lambda self, real=repository_source.RepositoryReader.partitions: seen.append(list(self.keep)) or real(self))
    reader = repository_source.RepositoryReader({"path": str(code)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("repo",), "shop"), StringStartsWith(("path",), "lib/"), LessThan(("length",), 45), GreaterThan(("length",), 1)]))
    assert [type(f) for f in left] == [GreaterThan] and [s.repo for s in reader.partitions()] == ["shop"]
    assert [(r[1], r[3]) for s in reader.partitions() for r in reader.read(s)] == [("lib/a b.ex", 24)]
    df = load(spark, code).filter((F.col("repo") == "shop") & F.col("path").startswith("lib/") & (F.col("length") < 45))
    assert [(r.repo, r.path) for r in df.collect()] == [("shop", "lib/a b.ex")]


def drain(store, spark, root, checkpoint):
    q = ingest.start(store, ingest.repository_stream(spark, str(root)), checkpoint)
    q.processAllAvailable()
    q.stop()


def test_commits_reach_the_store_and_so_do_deletions(spark, code, tmp_path):
    store, place = Store(spark, str(tmp_path / "kb")), str(tmp_path / "cp")
    drain(store, spark, code, place)
    assert {r["name"] for r in store.model().modules.collect()} == {"Shop.A", "Pay.A"}
    version = store.state["version"]
    drain(store, spark, code, place)
    assert store.state["version"] == version  # nothing new
    (code / "shop" / "lib" / "a b.ex").unlink()
    write(code / "shop" / "lib" / "b.ex", "defmodule Shop.B do\nend\n")
    commit(code / "shop")
    drain(store, spark, code, place)
    assert {r["name"] for r in store.model().modules.collect()} == {"Shop.B", "Pay.A"}
    docs, index = store.index()
    assert {r.term for r in index.postings.filter("entity_type = 'module'").collect()} >= {"b", "pay"} and docs.filter("entity_type = 'module'").count() == 2
