"""The stored model: tables in buckets of repositories, facts, text index and graph, in versions.

A version is one small file that says which folders make up every table. Changes
write new folders beside the old ones, and a version that names them appears whole
or not at all once everything is written: a run that dies between two tables
leaves the former version, all of it. Whoever has opened a version goes on reading
its folders until ``vacuum`` deletes what the last versions no longer name. One
writer at a time is assumed; a second one gets an error in place of a version.

A repository's rows are replaced by writing its bucket anew: what the bucket held
of other repositories, and the new rows. Spark splits a large bucket among several
tasks and files, and there are more buckets as tables grow. Facts are the only
state that cannot be derived again; a schema change drops the rest and keeps them.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.text import number_of_key
from quarry.operators import graph, search
from quarry.plans.stored_graph import GraphStore
from quarry.plans.text_index import TextIndex
from quarry.schema import SCHEMA_VERSION, TABLES, Model, empty_model
from quarry.sources import folders

#: Tables whose rows belong to a repository, by the column that says to which.
OWNED = {"repos": "id", "files": "repo_id", "modules": "repo_id", "services": "repo_id", "events": "repo_id", "edges": "repo_id", "fields": "repo_id"}
PART, BUCKETS = "part_repo", 64
#: Bytes of a bucket from which tables get more buckets.
BUCKET_BYTES = 1 << 30
#: Versions that readers can count on.
KEPT = 8
MAX_CHANGED, MAX_CHANGED_SHARE = 200, 0.5


class Store:
    """Tables below one folder, which all executors must see, as of one version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._open = spark, path.rstrip("/"), False
        self.state = {"version": 0, "schema": SCHEMA_VERSION, "buckets": buckets, "tables": {}, "facts": [], "index": None, "graph": None}
        self.refresh()
        if self.state["schema"] != SCHEMA_VERSION:
            with self.transaction():
                self.state |= {"schema": SCHEMA_VERSION, "tables": {}, "index": None, "graph": None}

    # -- versions

    def _versions(self) -> list[str]:
        return folders.matching(self.spark, f"{self.path}/versions/*.json")

    def refresh(self) -> None:
        """Goes to the last version; frames that were made of the former one stay as they are."""
        if found := self._versions():
            self.state = json.loads(folders.read_text(self.spark, found[-1]))

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """A scope whose changes become one version at its end, or none if it fails; inner scopes belong to the outer one."""
        if self._open:
            yield
            return
        before, self._open = copy.deepcopy(self.state), True
        try:
            yield
            if self.state != before:
                self.state["version"] += 1
                folders.write_text(self.spark, f"{self.path}/versions/{self.state['version']:012d}.json", json.dumps(self.state))
        except BaseException:
            self.state = before
            raise
        finally:
            self._open = False

    def vacuum(self, keep: int = KEPT) -> int:
        """Deletes what none of the last ``keep`` versions names, and older versions; returns how many folders went."""
        found = self._versions()
        if not found:
            return 0
        states = [json.loads(folders.read_text(self.spark, p)) for p in found[-keep:]]
        named = {c for s in states for c in s["facts"]} | {c for s in states for t in s["tables"].values() for c in t.values()}
        gone = [p for p in folders.matching(self.spark, f"{self.path}/data/*/commit=*") + folders.matching(self.spark, f"{self.path}/data/*/{PART}=*/commit=*") if p.rsplit("commit=", 1)[-1] not in named]
        for path in [*gone, *found[:-keep]]:
            folders.delete(self.spark, path)
        indexes = [TextIndex.of(self.spark, self._at("index"), s["index"]) for s in states]
        indexes[-1].discard_unused(indexes)
        GraphStore.of(self.spark, self._at("graph"), states[-1]["graph"]).discard_unused([s["graph"] for s in states])
        return len(gone)

    # -- tables

    def _at(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def table(self, name: str) -> DataFrame:
        schema = StructType.fromDDL(TABLES[name])
        if name == "learned_facts":
            paths = [f"{self._at(name)}/commit={c}" for c in self.state["facts"]]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return self._stored(name).select(*schema.names)

    def _stored(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as it is stored, all of it or some buckets."""
        known = self.state["tables"].get(name, {})
        paths = [f"{self._at(name)}/{PART}={b}/commit={c}" for b, c in sorted(known.items()) if buckets is None or int(b) in buckets]
        schema = StructType([*StructType.fromDDL(TABLES[name]).fields, *StructType.fromDDL(f"{PART} int, commit string").fields])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self._at(name)).parquet(*paths)

    def model(self) -> Model:
        return Model(**{name: self.table(name) for name in TABLES})

    def rows_of(self, name: str, repo_ids: list[int]) -> DataFrame:
        """The rows of some repositories, from their buckets."""
        columns = StructType.fromDDL(TABLES[name]).names
        return self._stored(name, self._buckets(repo_ids)).filter(F.col(OWNED[name]).isin(repo_ids)).select(*columns)

    def _buckets(self, repo_ids: list[int]) -> list[int]:
        return sorted({i % self.state["buckets"] for i in repo_ids})

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """All columns of a table, missing ones null, and the bucket."""
        fields = StructType.fromDDL(TABLES[name]).fields
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        return shaped.withColumn(PART, F.pmod(F.col(OWNED[name]), F.lit(self.state["buckets"])).cast("int"))

    def _put(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """Writes shaped rows as the touched buckets' new folders."""
        commit = uuid.uuid4().hex
        rows.withColumn("commit", F.lit(commit)).hint("rebalance", PART).write.mode("append").partitionBy(PART, "commit").parquet(self._at(name))
        made = {p.split(f"{PART}=")[1].split("/")[0] for p in folders.matching(self.spark, f"{self._at(name)}/{PART}=*/commit={commit}")}
        known = self.state["tables"].setdefault(name, {})
        for bucket in map(str, touched):
            known.pop(bucket, None)
            if bucket in made:
                known[bucket] = commit

    def replace(self, name: str, rows: DataFrame | None, repo_ids: list[int]) -> None:
        """Puts ``rows`` (None: nothing) in place of all rows of these repositories."""
        touched = self._buckets(repo_ids)
        with self.transaction():
            ids = self.spark.createDataFrame([(i,) for i in repo_ids], f"{OWNED[name]} long")
            kept = self._shaped(name, self._stored(name, touched).join(ids, OWNED[name], "left_anti"))
            self._put(name, kept if rows is None else kept.unionByName(self._shaped(name, rows)), touched)

    def clear(self, name: str, repo_ids: list[int]) -> None:
        """Removes all rows of repositories."""
        if self.state["tables"].get(name):
            self.replace(name, None, repo_ids)

    def grow(self, bucket_bytes: int = BUCKET_BYTES) -> int:
        """More buckets for tables whose buckets have become large, all in one version; returns how many there are."""
        size = max([sum(folders.size(self.spark, f"{self._at(n)}/{PART}={b}/commit={c}") for b, c in t.items()) for n, t in self.state["tables"].items()], default=0)
        wanted = self.state["buckets"]
        while size > bucket_bytes * wanted:
            wanted *= 2
        if wanted > self.state["buckets"]:
            with self.transaction():
                old = {name: self.table(name) for name in self.state["tables"]}
                self.state["buckets"], self.state["tables"] = wanted, {}
                for name, rows in old.items():
                    self._put(name, self._shaped(name, rows), list(range(wanted)))
        return wanted

    # -- whole and incremental writes

    def persist(self, tables: dict[str, DataFrame], repo_ids: list[int]) -> None:
        """All rows of these repositories, in place of what was stored of them."""
        with self.transaction():
            for name in OWNED:
                if name in tables:
                    self.replace(name, tables[name], repo_ids)

    def persist_changed(self, tables: dict[str, DataFrame], changed: DataFrame, repo_ids: list[int]) -> None:
        """Rows of changed files (repo_id, path) in place of those stored of them; rows of other files stay.

        Services and edges are replaced whole: both are made from all files.
        """
        merged = {k: v for k, v in tables.items() if k in ("repos", "services", "edges")}
        keys = changed.select("repo_id", F.col("path").alias("__path")).distinct()
        files = self.rows_of("files", repo_ids).select(F.col("id").alias("file_id"), F.col("path").alias("__file"))
        for name, path in (("files", F.col("path")), ("modules", F.col("__file")), ("events", F.col("source_file")), ("fields", F.col("source_file"))):
            if name not in tables:
                continue
            old = self.rows_of(name, repo_ids)
            old = old.join(files, "file_id", "left") if name == "modules" else old
            old = old.withColumn("__path", path).join(keys, ["repo_id", "__path"], "left_anti")
            new = tables[name].withColumn("__path", F.col("path") if name in ("files", "modules") and "path" in tables[name].columns else F.col("source_file")).join(keys, ["repo_id", "__path"], "left_semi")
            columns = StructType.fromDDL(TABLES[name]).names
            shape = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(StructType.fromDDL(TABLES[name])[c].dataType).alias(c) for c in columns])  # noqa: B023, E731
            merged[name] = shape(old).unionByName(shape(new))
        self.persist(merged, repo_ids)

    # -- text index

    def _text_index(self) -> TextIndex:
        return TextIndex.of(self.spark, self._at("index"), self.state["index"])

    def write_index(self) -> None:
        """Makes the text index anew, in one segment; a fact is found by its repository too."""
        with self.transaction():
            self.state["index"] = TextIndex(self.spark, self._at("index")).changed(search.index_texts(self.model())).state()

    def update_index(self, repo_ids: list[int]) -> None:
        """Brings the index up to date with the stored rows of these repositories; only texts that differ are written."""
        if self.state["index"] is None:
            return self.write_index()
        with self.transaction():
            owners, index = self.spark.createDataFrame([(i,) for i in repo_ids], "owner long"), self._text_index()
            own = empty_model(self.spark).with_tables(**{name: self.rows_of(name, repo_ids) for name in OWNED})
            self.state["index"] = index.changed(*index.differences(search.index_texts(own), owners)).merged().state()

    def index(self) -> tuple[DataFrame, search.Index]:
        """(documents, index) as stored, or made for the question where nothing is stored."""
        if self.state["index"] is None:
            docs = search_index(self.model())
            return docs, search.Index.over(docs)
        index = self._text_index()
        return index.docs(), index.searchable()

    # -- graph

    def _graph(self) -> GraphStore:
        return GraphStore.of(self.spark, self._at("graph"), self.state["graph"])

    def write_graph(self) -> None:
        """Stores the service graph of the whole model."""
        with self.transaction():
            self.state["graph"] = self._graph().written(self.model()).state

    def update_graph(self, before: Model, repo_ids: list[int]) -> None:
        """Brings the stored graph up to date after rows of these repositories changed; ``before`` is the model as it was."""
        if self.state["graph"] is None:
            return self.write_graph()
        with self.transaction():
            self.state["graph"] = self._graph().updated(before, self.model(), repo_ids).state

    def graph(self) -> GraphStore | None:
        """The stored graph, None where there is none."""
        return None if self.state["graph"] is None else self._graph()

    def edges(self) -> DataFrame:
        return graph.graph_edges(self.model()) if self.state["graph"] is None else self._graph().edges()

    # -- facts

    def learn(self, content: str, repo: str | None = None) -> int:
        """Stores a fact and returns its id, a number of its content, repository and moment. It is found by its content."""
        now = self.spark.sql("SELECT current_timestamp() AS t").first()["t"]
        row = self.spark.createDataFrame([(content, repo, now)], "content string, repo string, created_at timestamp")
        row = row.withColumn("id", number_of_key(F.lit("fact"), F.col("content"), F.col("repo"), F.col("created_at"), F.lit(uuid.uuid4().hex))).select("id", "content", "repo", "created_at")
        fact = row.collect()
        stored = self.spark.createDataFrame(fact, TABLES["learned_facts"])
        with self.transaction():
            self._put_facts(stored, self.state["facts"])
            if self.state["index"] is not None:
                texts = search.index_texts(empty_model(self.spark).with_tables(learned_facts=stored), "content")
                self.state["index"] = self._text_index().changed(texts).merged().state()
        return fact[0]["id"]

    def _put_facts(self, rows: DataFrame, others: list[str]) -> None:
        commit = uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{self._at('learned_facts')}/commit={commit}")
        self.state["facts"] = [*others, commit]

    def forget(self, fact_id: int) -> bool:
        facts = self.table("learned_facts")
        if facts.filter(F.col("id") == fact_id).isEmpty():
            return False
        with self.transaction():
            self._put_facts(facts.filter(F.col("id") != fact_id), [])
            if self.state["index"] is not None:
                gone = self.spark.createDataFrame([("learned_fact", fact_id)], "entity_type string, entity_id long")
                self.state["index"] = self._text_index().changed(None, gone).merged().state()
        return True

    # -- hygiene

    def prune(self, names: list[str]) -> int:
        """Deletes these repositories with all they own, and the edges of others that lead to them."""
        gone = self.table("repos").filter(F.col("name").isin(names))
        ids = [r["id"] for r in gone.select("id").collect()]
        if not ids:
            return 0
        before = self.model()
        into = before.edges.filter((F.col("target_type") == "repo") & F.col("target_id").isin(ids) & ~F.col("repo_id").isin(ids))
        others = [r["repo_id"] for r in into.select("repo_id").distinct().collect()]
        with self.transaction():
            if others:
                self.persist({"edges": before.edges.filter(F.col("repo_id").isin(others) & ~((F.col("target_type") == "repo") & F.col("target_id").isin(ids)))}, others)
            for name in OWNED:
                self.clear(name, ids)
            if self.state["index"] is not None:
                self.update_index(ids)
            if self.state["graph"] is not None:
                self.update_graph(before, [*ids, *others])
        return len(ids)


def facts_listed(facts: DataFrame, repo: str | None = None) -> DataFrame:
    """Facts, of one repository or all, the latest first."""
    rows = facts if repo is None else facts.filter(F.col("repo") == repo)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())


def stale_facts(facts: DataFrame, days: int = 90, now: Column | None = None) -> DataFrame:
    """Facts that are more than ``days`` days old."""
    moment = F.current_timestamp() if now is None else now
    return facts.filter(F.col("created_at") < moment - F.make_dt_interval(F.lit(days)))


def missing_repositories(repos: DataFrame, present: DataFrame) -> DataFrame:
    """Stored repositories whose path is not among the paths that exist."""
    return repos.join(present.select("path"), "path", "left_anti")


def status_counts(model: Model) -> DataFrame:
    """(name, count) of the seven counted tables; fields are not counted."""
    parts = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("name"), "count") for name, df in model.items() if name != "fields"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def staleness(repos: DataFrame, snapshot: DataFrame, limit: int = 20) -> DataFrame:
    """(name, state) of the first repositories by name: missing, stale or current, from a snapshot (name, head)."""
    rows = repos.orderBy("name").limit(limit).join(snapshot.select("name", "head", F.lit(True).alias("there")), "name", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("head").eqNullSafe(F.col("last_indexed_commit")), "current").otherwise("stale")
    return rows.select("name", state.alias("state"))


def unchanged(repos: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Repositories whose stored commit is the tip of their branch: they are skipped."""
    return repos.join(snapshot.select("name", "tip"), "name").filter(F.col("last_indexed_commit") == F.col("tip")).select(*repos.columns)


def modes(work: DataFrame) -> DataFrame:
    """(repo_id, mode) of rows (repo_id, force, last, tip, reachable, changed, files).

    surgical where the last commit is known, another and reachable, force is off, and 1 to 200
    files and at most half of all have changed; full otherwise.
    """
    known = ~F.col("force") & F.col("last").isNotNull() & (F.col("last") != F.col("tip")) & F.col("reachable")
    few = (F.col("changed") > 0) & (F.col("changed") <= MAX_CHANGED) & (F.col("changed") <= F.col("files") * MAX_CHANGED_SHARE)
    return work.select("repo_id", F.when(known & few, "surgical").otherwise("full").alias("mode"))


def search_index(model: Model, fact_text: str = "repo") -> DataFrame:
    """Documents of the full-text index over a model."""
    return search.fts_docs(search.index_texts(model, fact_text))


__all__ = ["Store", "empty_model", "facts_listed", "missing_repositories", "modes", "search_index", "stale_facts", "staleness", "status_counts", "unchanged"]
