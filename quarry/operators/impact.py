"""Blast radius: who is affected when a service changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import named, upstream
from quarry.schema import Model
from quarry.session import staged

TIERS = {1: "direct", 2: "indirect"}


def impact_nodes(model: Model, edges: DataFrame, seeds: DataFrame, mechanism: str | None = None, max_depth: int = 3, found: DataFrame | None = None) -> DataFrame:
    """(seed, service, node, name, depth, tier): one row per affected service of each seed; ``found`` if what leads to the seeds is known."""
    nodes = upstream(seeds, edges, max_depth, mechanism) if found is None else found
    tier = F.when(F.col("depth") == 1, TIERS[1]).when(F.col("depth") == 2, TIERS[2]).otherwise("transitive")
    return named(named(nodes.withColumn("tier", tier), model.repos, "seed", "service"), model.repos, "node", "name")


def _inner_links(nodes: DataFrame, seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed, node, dst_id, what ``pairs`` says): the pairs (src_id, dst_id) from a node into its seed or the seed's nodes."""
    inside = nodes.select("seed", F.col("node").alias("dst_id")).unionByName(seeds.select("seed", F.col("seed").alias("dst_id"))).distinct()
    return nodes.select("seed", "node").join(pairs, F.col("node") == F.col("src_id")).join(inside, ["seed", "dst_id"])


def impact_entries(model: Model, edges: DataFrame, seeds: DataFrame, mechanism: str | None = None, max_depth: int = 3, found: DataFrame | None = None) -> DataFrame:
    """The affected services with ``mechanisms`` and ``confidence``.

    Mechanisms are distinct, in the order of the edges; confidences are all, in the same order.
    What is said of a service depends on the seed only by which of its callees lie inside, so
    seeds are gathered by these and meet the service's edges once; no list of edges is sent to a seed.
    With ``found``, ``edges`` need to hold only those that begin at a service in it.
    """
    nodes = upstream(seeds, edges, max_depth, mechanism) if found is None else found
    followed = edges if mechanism is None else edges.filter(F.col("mechanism") == mechanism)
    inner = _inner_links(nodes, seeds, followed.select("src_id", "dst_id").distinct()).groupBy("seed", "node").agg(F.array_sort(F.collect_set("dst_id")).alias("inner"))
    # written, so that the shuffles of nodes times callees are gone before the edges move
    inner = staged(inner, "impact-inner")
    known = impact_nodes(model, edges, seeds, mechanism, max_depth, nodes).join(inner, ["seed", "node"], "left")
    alike = known.groupBy("node", "name", "inner").agg(F.collect_list(F.struct("seed", "service", "depth", "tier")).alias("of"))
    order = ("cls", "e1", "e2", "mechanism", "confidence")
    links = followed.groupBy(F.col("src_id").alias("node")).agg(F.array_sort(F.collect_list(F.struct(*order, "dst_id"))).alias("links"))
    links = links.withColumn("links", F.transform("links", lambda e: F.struct(e["dst_id"], e["mechanism"], e["confidence"])))
    kept = alike.join(links, "node", "left").withColumn("links", F.filter("links", lambda e: F.array_contains("inner", e["dst_id"])))
    none = F.array().cast("array<string>")
    said = kept.select("node", "name", "of", F.coalesce(F.array_distinct("links.mechanism"), none).alias("mechanisms"), F.coalesce("links.confidence", none).alias("confidence"))
    return said.select(F.explode("of").alias("of"), "node", "name", "mechanisms", "confidence").select("of.*", "node", "name", "mechanisms", "confidence")


def inner_edges(edges: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, node, edges): how many edges each node has into its seed or the seed's nodes; parallel ones are counted before they meet seeds."""
    pairs = edges.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))
    return _inner_links(nodes, seeds, pairs).groupBy("seed", "node").agg(F.sum("n").alias("edges"))


def impact_stats(nodes: DataFrame) -> DataFrame:
    """(seed, service, total, direct, indirect, transitive, score, summary): one row per seed that affects others."""
    count = lambda t: F.sum((F.col("tier") == t).cast("long"))
    rows = nodes.groupBy("seed", "service").agg(F.count(F.lit(1)).alias("total"), count("direct").alias("direct"), count("indirect").alias("indirect"), count("transitive").alias("transitive"))
    rows = rows.withColumn("score", 3 * F.col("direct") + 2 * F.col("indirect") + F.col("transitive"))
    return rows.withColumn("summary", F.format_string("%s: %d direct, %d indirect, %d transitive (score: %d)", "service", "direct", "indirect", "transitive", "score"))


def mechanism_histogram(nodes: DataFrame, seeds: DataFrame, edges: DataFrame, mechanism: str | None = None) -> DataFrame:
    """(seed, mechanism, entries): how many affected services (seed, node) are linked by each mechanism."""
    followed = edges if mechanism is None else edges.filter(F.col("mechanism") == mechanism)
    kinds = _inner_links(nodes, seeds, followed.select("src_id", "dst_id", "mechanism").distinct()).select("seed", "node", "mechanism").distinct()
    return kinds.groupBy("seed", "mechanism").agg(F.count(F.lit(1)).alias("entries"))
