"""The service graph as it is stored: edges by their source and by their target, links of dependencies by their service.

Each of the four tables is kept in buckets of the service that a question starts
from, so a level of a search reads the buckets of its frontier and nothing else.
When repositories change, the edges that can differ are made twice, from the
former and from the present model: those that touch a changed repository, and
those by way of an event that was added or has gone. The former ones leave their
buckets, the present ones enter theirs; no other bucket is read or written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dependencies, graph
from quarry.schema import UNRESOLVED, Model
from quarry.session import swept
from quarry.sources import folders

BUCKETS, PART = 64, "part"
EDGE_SCHEMA = "src_id long, dst_id long, mechanism string, confidence string, via string, relationship_type string, cls int, e1 long, e2 long"
LINK_SCHEMA = "repo_id long, linked_id long, name string, mechanism string, confidence string, segment string, unresolved string, kind string, cls int, e1 long, e2 long"
#: Table: the column it is bucketed by, its schema, and what tells its rows apart.
TABLES = {
    "out": ("src_id", EDGE_SCHEMA, ("cls", "e1", "e2", "src_id", "dst_id")),
    "in": ("dst_id", EDGE_SCHEMA, ("cls", "e1", "e2", "src_id", "dst_id")),
    "upstream": ("repo_id", LINK_SCHEMA, ("cls", "e1", "e2", "repo_id", "linked_id")),
    "downstream": ("repo_id", LINK_SCHEMA, ("cls", "e1", "e2", "repo_id", "linked_id")),
}


def made(kind: str, model: Model, touching: graph.Touched | None = None) -> DataFrame:
    """All rows of a table over a model, or those that touch given repositories and events."""
    if kind in ("upstream", "downstream"):
        return dependencies.links(model, kind, touching=touching)
    edges = graph.graph_edges(model, touching)
    return edges if kind == "out" else edges.filter(F.col("dst_id") != UNRESOLVED)


@dataclass(frozen=True)
class GraphStore:
    spark: SparkSession
    root: str
    state: dict

    @staticmethod
    def of(spark: SparkSession, root: str, state: dict | None) -> GraphStore:
        return GraphStore(spark, root, state or {"buckets": BUCKETS, "tables": {}})

    # -- reading

    def _paths(self, kind: str, buckets: list[int] | None) -> list[str]:
        known = self.state["tables"].get(kind, {})
        return [f"{self.root}/{kind}/{PART}={b}/commit={c}" for b, c in sorted(known.items()) if buckets is None or int(b) in buckets]

    def read(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of it."""
        if self.state["tables"] and kind not in self.state["tables"]:
            raise ValueError(f"this graph was stored without {kind}")
        schema, paths = TABLES[kind][1], self._paths(kind, buckets)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, {PART} int, commit string").option("basePath", f"{self.root}/{kind}").parquet(*paths).drop(PART, "commit")

    def edges(self) -> DataFrame:
        return self.read("out")

    def buckets_of(self, nodes: DataFrame, column: str) -> list[int]:
        """The buckets of these services; there are at most as many as buckets."""
        return [r[0] for r in nodes.select(self._part(F.col(column))).distinct().collect()]

    def _part(self, key: F.Column) -> F.Column:
        return F.pmod(key, F.lit(self.state["buckets"])).cast("int")

    def near(self, kind: str, nodes: DataFrame, column: str) -> DataFrame:
        """The rows of a table in the buckets of these services."""
        return self.read(kind, self.buckets_of(nodes, column))

    def upstream(self, seeds: DataFrame, max_depth: int | None = 3, mechanism: str | None = None) -> DataFrame:
        """(seed, node, depth) of what leads to the seeds, as ``graph.upstream`` finds it."""
        return graph.reached_by(seeds, self._steps("in", "dst_id", "src_id", mechanism), max_depth)

    def downstream(self, seeds: DataFrame, max_depth: int | None = None, mechanism: str | None = None) -> DataFrame:
        return graph.reached_by(seeds, self._steps("out", "src_id", "dst_id", mechanism), max_depth)

    def _steps(self, kind: str, here: str, there: str, mechanism: str | None) -> Callable[[DataFrame], DataFrame]:
        def step(frontier: DataFrame) -> DataFrame:
            rows = self.near(kind, frontier, "node").filter(F.col("dst_id") != UNRESOLVED)
            rows = rows if mechanism is None else rows.filter(F.col("mechanism") == mechanism)
            return rows.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct()

        return step

    def walks(self, frontier: DataFrame) -> DataFrame:
        """The walks of ``graph.walks_of`` that begin at these nodes, both ways."""
        buckets = self.buckets_of(frontier, "node")
        return graph.walks_of(self.read("out", buckets), self.read("in", buckets))

    # -- writing

    def _put(self, kind: str, rows: DataFrame, tables: dict, touched: list[int]) -> None:
        commit = uuid.uuid4().hex
        rows = rows.withColumn(PART, self._part(F.col(TABLES[kind][0]))).withColumn("commit", F.lit(commit))
        with swept(self.spark):
            rows.hint("rebalance", PART).write.mode("append").partitionBy(PART, "commit").parquet(f"{self.root}/{kind}")
        there = {p.split(f"{PART}=")[1].split("/")[0] for p in folders.matching(self.spark, f"{self.root}/{kind}/{PART}=*/commit={commit}")}
        for bucket in map(str, touched):
            tables[kind].pop(bucket, None)
            if bucket in there:
                tables[kind][bucket] = commit

    def written(self, model: Model) -> GraphStore:
        """The graph of a whole model in place of what was stored."""
        return GraphStore(self.spark, self.root, {**self.state, "tables": {}}).completed(model, tuple(TABLES))

    def completed(self, model: Model, kinds: tuple[str, ...]) -> GraphStore:
        """With these tables of the same model, of which those that are stored already stay."""
        store = self
        for kind in [k for k in TABLES if k in kinds and k not in self.state["tables"]]:
            # both orders of the edges are written from one derivation
            there = kind == "in" and "out" in store.state["tables"]
            rows = store.read("out").filter(F.col("dst_id") != UNRESOLVED) if there else made(kind, model)
            tables: dict[str, dict[str, str]] = {**store.state["tables"], kind: {}}
            self._put(kind, rows, tables, list(range(self.state["buckets"])))
            store = GraphStore(self.spark, self.root, {**self.state, "tables": tables})
        return store

    def updated(self, before: Model, after: Model, repo_ids: list[int]) -> GraphStore:
        """The graph, in the tables that it has, after all rows of these repositories changed from ``before`` to ``after``."""
        touching = graph.touched(before, after, repo_ids)
        tables = {kind: dict(self.state["tables"].get(kind, {})) for kind in self.state["tables"] or TABLES}
        for source, kinds in (("out", ("out", "in")), ("upstream", ("upstream",)), ("downstream", ("downstream",))):
            kinds = tuple(k for k in kinds if k in tables)
            if not kinds:
                continue
            old, new = made(source, before, touching), made(source, after, touching)
            both = folders.staged(self.spark, old.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True))), f"{self.root}/_stage")
            for kind in kinds:
                by, _, key = TABLES[kind]
                rows = both.frame if kind != "in" else both.frame.filter(F.col("dst_id") != UNRESOLVED)
                buckets = self.buckets_of(rows, by)
                if buckets:
                    stays = self.read(kind, buckets).join(rows.filter("not new").select(*key), list(key), "left_anti")
                    self._put(kind, stays.unionByName(rows.filter("new").drop("new")), tables, buckets)
            both.discard()
        return GraphStore(self.spark, self.root, {**self.state, "tables": tables})

    def discard_unused(self, states: list[dict | None]) -> None:
        """Deletes the folders that none of these states names."""
        named = {c for s in states if s for t in s["tables"].values() for c in t.values()}
        for path in folders.matching(self.spark, f"{self.root}/*/{PART}=*/commit=*"):
            if path.rsplit("commit=", 1)[-1] not in named:
                folders.delete(self.spark, path)
