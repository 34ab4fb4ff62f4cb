"""The service graph as a DataFrame of directed edges, and traversals of it.

Every edge carries its order: the class (direct, event, topic, unresolved) and
the ids of the stored edges that it comes from. Ties are broken by that order
everywhere, so results do not depend on partitioning.

Traversals work on many seeds at once. Each level is one join of the frontier
with the edges and one anti-join with what was seen; it ends in a reliable
checkpoint, so the plan stays as long as one level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.edges import mechanism, metadata_field
from quarry.schema import UNRESOLVED, Model
from quarry.session import cut, staged

GRAPH_COLUMNS = ("src_id", "dst_id", "mechanism", "confidence", "via", "relationship_type", "cls", "e1", "e2")
KAFKA = ("produces_kafka", "consumes_kafka")


def _edge(cls: int, src, dst, mech, confidence, via, relationship, e1, e2) -> list:
    names = (src, dst, mech, confidence, via, relationship, F.lit(cls), e1, e2)
    kinds = ("long", "long", "string", "string", "string", "string", "int", "long", "long")
    return [F.col(x).cast(k).alias(n) if isinstance(x, str) else x.cast(k).alias(n) for x, k, n in zip(names, kinds, GRAPH_COLUMNS)]


@dataclass(frozen=True)
class Touched:
    """What changed: repositories (repo_id), and events that one of two models lacks (key) with their names (name)."""

    repos: DataFrame
    events: DataFrame

    def of(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose column is one of the repositories."""
        return rows.join(F.broadcast(self.repos.withColumnRenamed("repo_id", column)), column, "left_semi")


def touched(before: Model, after: Model, repo_ids: list[int]) -> Touched:
    """The changed repositories, and the events of theirs that are only in one of the models.

    Repositories that a caller lists by id are few; the events among them are a table.
    """
    repos = before.spark.createDataFrame([(i,) for i in sorted(set(repo_ids))], "repo_id long")
    events = lambda m: m.events.filter(F.col("repo_id").isin(repo_ids)).select(F.col("id").alias("key"), "name")
    old, new = events(before), events(after)
    return Touched(repos, cut(old.exceptAll(new).unionByName(new.exceptAll(old)).distinct()))


def direct_edges(model: Model, touching: Touched | None = None) -> DataFrame:
    """Edges from repository to repository, of any relationship; loops stay."""
    rows = _own(model, touching).filter((F.col("source_type") == "repo") & (F.col("target_type") == "repo"))
    return rows.select(*_edge(0, "source_id", "target_id", mechanism(F.col("relationship_type")), metadata_field(F.col("metadata"), "confidence"), F.lit(None), "relationship_type", "id", F.lit(0)))


def _own(model: Model, touching: Touched | None) -> DataFrame:
    """The stored edges, or those of the touched repositories."""
    return model.edges if touching is None else touching.of(model.edges, "repo_id")


def met(left: DataFrame, right: DataFrame, key: str, mine: str, other: str, touching: Touched | None, named: str | None = None) -> DataFrame:
    """``left`` joined with ``right`` by ``key``; with ``touching`` only pairs with a touched end or by way of a touched event.

    Touched rows of either side meet the other side before the rest does, so the cost is that of
    their keys. ``named`` says which column holds the name of an event.
    """
    if touching is None:
        return left.join(right, key)
    parts = [touching.of(left, mine).join(right, key), left.join(touching.of(right, other), key)]
    if named:
        # pairs by another event of the same name share a row with those by a touched one
        parts.append(left.join(touching.events.select(F.col("name").alias(named)).distinct(), named, "left_semi").join(right, key))
    columns = parts[0].columns
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).distinct()


def _through(producers: DataFrame, consumers: DataFrame, cls: int, mech: str, relationship: str, touching: Touched | None) -> DataFrame:
    """Producer to consumer by a common key, once per (producer, consumer, name); a repository is not linked with itself.

    Each side is reduced to one row per (key, repository) before they meet, so a popular key
    costs distinct pairs of repositories, not pairs of mentions.
    """
    left = producers.groupBy("key", "name", "repo_id").agg(F.min("id").alias("e1"))
    right = consumers.groupBy("key", F.col("repo_id").alias("to_id")).agg(F.min("id").alias("e2"))
    pairs = met(left, right, "key", "repo_id", "to_id", touching, "name" if cls == 1 else None).filter(F.col("repo_id") != F.col("to_id"))
    first = pairs.groupBy("repo_id", "to_id", "name").agg(F.min(F.struct("e1", "e2")).alias("ord"))
    return first.select(*_edge(cls, "repo_id", "to_id", F.lit(mech), F.lit(None), "name", F.lit(relationship), F.col("ord.e1"), F.col("ord.e2")))


def event_edges(model: Model, touching: Touched | None = None) -> DataFrame:
    """Producer to consumer by way of an event."""
    named = model.edges.join(model.events.select(F.col("id").alias("target_id"), F.col("name").alias("event")), "target_id")
    rows = named.select("id", F.col("source_id").alias("repo_id"), F.col("target_id").alias("key"), F.col("event").alias("name"), "relationship_type")
    return _through(rows.filter("relationship_type = 'produces_event'"), rows.filter("relationship_type = 'consumes_event'"), 1, "event", "produces_event", touching)


def topic_edges(model: Model, touching: Touched | None = None) -> DataFrame:
    """Producer to consumer by way of a topic that their metadata name."""
    rows = model.edges.filter(F.col("relationship_type").isin(*KAFKA)).select("id", F.col("source_id").alias("repo_id"), metadata_field(F.col("metadata"), "topic").alias("key"), "relationship_type").filter("key is not null").withColumn("name", F.col("key"))
    return _through(rows.filter("relationship_type = 'produces_kafka'"), rows.filter("relationship_type = 'consumes_kafka'"), 2, "kafka", "produces_kafka", touching)


def unresolved_edges(model: Model, touching: Touched | None = None) -> DataFrame:
    """Calls whose callee is only a name; their target is 0."""
    rows = _own(model, touching).filter((F.col("source_type") == "repo") & (F.col("target_type") == "service_name") & ~F.col("relationship_type").isin(*KAFKA))
    meta = F.col("metadata")
    return rows.select(*_edge(3, "source_id", F.lit(UNRESOLVED), mechanism(F.col("relationship_type")), metadata_field(meta, "confidence"), metadata_field(meta, "targetName"), "relationship_type", "id", F.lit(0)))


def graph_edges(model: Model, touching: Touched | None = None) -> DataFrame:
    """All four classes; with ``touching`` only edges that a change of it can make, end or alter."""
    return reduce(DataFrame.unionByName, [made(model, touching) for made in (direct_edges, event_edges, topic_edges, unresolved_edges)])


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Resolved edges with their ends swapped."""
    rest = [c for c in GRAPH_COLUMNS if c not in ("src_id", "dst_id")]
    return edges.filter(F.col("dst_id") != UNRESOLVED).select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), *rest)


def reached_by(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): the least number of steps from each seed, without the seed itself.

    ``step`` gives the (node, next) of a frontier's nodes, or more. ``max_depth`` None goes on until
    nothing new is found.
    """
    frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(step(frontier), "node").select("seed", F.col("next").alias("node")).distinct()
        # a written level is columns, a fraction of a checkpoint's rows, and leaves no shuffle files
        frontier = staged(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "graph-level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def reached(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The same over a table of edges, followed from src_id to dst_id, never to 0."""
    # a written table: where it is small enough Spark broadcasts it at every level
    steps = staged(edges.filter(F.col("dst_id") != UNRESOLVED).select(F.col("src_id").alias("node"), F.col("dst_id").alias("next")).distinct(), "graph-steps")
    if max_depth is None and seeds.select("seed").limit(FEW + 1).count() > FEW:
        return reached_in_bits(seeds, steps)
    return reached_by(seeds, lambda frontier: steps, max_depth)


#: Seeds up to which a search keeps rows; seeds of a block, a bit each of Spark's bitmaps; rows that are expanded at a time.
FEW, BLOCK, AT_ONCE = 256, 32768, 64


def _fresh(batches):
    """(node, bits, had) to (node, bits): what is not in ``had``, without empty rows."""
    for batch in batches:
        bits, had = (batch.column(c).to_pylist() for c in ("bits", "had"))
        new = [np.bitwise_and(b, ~h) if h is not None else b for b, h in zip((np.frombuffer(b, np.uint8) for b in bits), (None if h is None else np.frombuffer(h, np.uint8) for h in had))]
        kept = [k for k, b in enumerate(new) if b.any()]
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(kept, pa.int64())), pa.array([new[k].tobytes() for k in kept], pa.binary())], ["node", "bits"])


def _places(batches):
    """(node, block, depth, bits) to (block, place, node, depth), a row for each bit."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            bits = np.frombuffer(b"".join(some.column("bits").to_pylist()), np.uint8).reshape(some.num_rows, -1)
            row, place = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([some.column("block").take(row), pa.array(place, pa.int64()), some.column("node").take(row), some.column("depth").take(row)], ["block", "place", "node", "depth"])


def reached_in_bits(seeds: DataFrame, steps: DataFrame) -> DataFrame:
    """``reached_by`` without a bound for many seeds: (seed, node, depth).

    What is reached is as many pairs as seeds times nodes, so a node holds a bit for each seed of a
    block instead of a row. A level sends a node's new bits along its steps; what arrives is joined
    by OR and what was there before taken off. One block is searched at a time, so shuffles and
    tables are those of a block; pairs become rows only as the result is read.
    """
    few = seeds.select("seed").filter("seed is not null").distinct()
    blocks = few.count() // (BLOCK * 3 // 4) + 1
    dealt = few.withColumn("block", F.pmod(F.xxhash64("seed"), F.lit(blocks)))
    place = F.row_number().over(W.partitionBy("block").orderBy("seed")) - 1
    # a block with more seeds than bits goes on in another one
    numbered = staged(dealt.withColumn("n", place).select("seed", (F.col("block") + F.lit(blocks) * F.floor(F.col("n") / BLOCK)).alias("block"), (F.col("n") % BLOCK).cast("long").alias("place")), "graph-seeds")
    levels = []
    for block in sorted(r["block"] for r in numbered.select("block").distinct().collect()):
        own = numbered.filter(F.col("block") == block)
        frontier = seen = staged(own.groupBy(F.col("seed").alias("node")).agg(F.bitmap_construct_agg("place").alias("bits")), "graph-bits")
        depth = 0
        while True:
            depth += 1
            sent = frontier.join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.bitmap_or_agg("bits").alias("bits"))
            frontier = staged(sent.join(seen.withColumnRenamed("bits", "had"), "node", "left").select("node", "bits", "had").mapInArrow(_fresh, "node long, bits binary"), "graph-bits")
            if frontier.isEmpty():
                break
            levels.append(frontier.select("node", F.lit(block).cast("long").alias("block"), F.lit(depth).alias("depth"), "bits"))
            seen = staged(seen.unionByName(frontier).groupBy("node").agg(F.bitmap_or_agg("bits").alias("bits")), "graph-seen")
    if not levels:
        return few.sparkSession.createDataFrame([], "seed long, node long, depth int")
    pairs = reduce(DataFrame.unionByName, levels).mapInArrow(_places, "block long, place long, node long, depth int")
    return pairs.join(numbered, ["block", "place"]).select("seed", "node", "depth")


def downstream(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Repositories that a seed leads to."""
    return reached(seeds, edges, max_depth)


def upstream(seeds: DataFrame, edges: DataFrame, max_depth: int | None = 3, mechanism_filter: str | None = None) -> DataFrame:
    """Repositories that lead to a seed; with a filter only its edges are followed."""
    if mechanism_filter:
        edges = edges.filter(F.col("mechanism") == mechanism_filter)
    return reached(seeds, reverse_edges(edges), max_depth)


def subgraph_edges(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, mechanism_filter: str | None = None) -> DataFrame:
    """(seed, node, depth, edge columns): each node's edges into the nodes of its seed or the seed itself."""
    if mechanism_filter:
        edges = edges.filter(F.col("mechanism") == mechanism_filter)
    inside = nodes.select("seed", F.col("node").alias("dst_id")).unionByName(seeds.select("seed", F.col("seed").alias("dst_id"))).distinct()
    return nodes.join(edges, F.col("node") == F.col("src_id")).join(inside, ["seed", "dst_id"])


SHOWN = ("mechanism", "via", "confidence")
HOP = {"parent": "long", "back": "int", "mechanism": "string", "via": "string", "confidence": "string"}


def walks_of(out: DataFrame, into: DataFrame) -> DataFrame:
    """(node, next, back, ord, mechanism, via, confidence): edges of ``out`` forward and of ``into`` backward.

    Of parallel edges only the first can ever be taken: forward before backward, then by the edge order.
    """
    order = F.struct("cls", "e1", "e2").alias("ord")
    walk = lambda df, a, b, back: df.filter(F.col("dst_id") != UNRESOLVED).select(F.col(a).alias("node"), F.col(b).alias("next"), F.lit(back).alias("back"), order, *SHOWN)
    best = walk(out, "src_id", "dst_id", 0).unionByName(walk(into, "dst_id", "src_id", 1)).groupBy("node", "next").agg(F.min(F.struct("back", "ord", *SHOWN)).alias("w"))
    return best.select("node", "next", "w.*")


def search_levels(sources: DataFrame, walks: DataFrame, max_depth: int | None = None) -> list[DataFrame]:
    """(from_id, node, parent, rank) of each step of a search from each source: how it first meets every node.

    A node is met first by the earlier found parent, and of a parent's walks there is one to a node, so
    the parent's rank says all; ``nth`` of ``walks`` (node, next, nth) orders what a parent finds. Edges
    lead both ways, so a node that was met before lies on one of the last two steps.
    """
    frontier = sources.select("from_id", F.col("from_id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("rank"))
    before, levels = frontier.limit(0), []
    steps = walks.select(F.col("node").alias("parent"), F.col("next").alias("node"), "nth")
    while max_depth is None or len(levels) < max_depth:
        found = frontier.select("from_id", F.col("node").alias("parent"), "rank").join(steps, "parent")
        new = found.join(frontier.unionByName(before).select("from_id", "node"), ["from_id", "node"], "left_anti")
        first = new.groupBy("from_id", "node").agg(F.min(F.struct("rank", "nth", "parent")).alias("b"))
        rank = F.row_number().over(W.partitionBy("from_id").orderBy("b.rank", "b.nth")).cast("long")
        before, frontier = frontier, staged(first.select("from_id", "node", "b.parent", rank.alias("rank")), "graph-tree")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return levels


def numbered_walks(edges: DataFrame) -> DataFrame:
    """The walks of ``edges`` both ways, a written table, with ``nth``, the place of a walk among its node's."""
    nth = F.row_number().over(W.partitionBy("node").orderBy("back", "ord"))
    return staged(walks_of(edges, edges).withColumn("nth", nth), "graph-walks")


def _with_walks(rows: DataFrame, walks: DataFrame) -> DataFrame:
    """Rows (parent, node) with what their walk says; those without a parent stay."""
    return rows.join(walks.select(F.col("node").alias("parent"), F.col("next").alias("node"), "back", *SHOWN), ["parent", "node"], "left")


def search_trees(sources: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(from_id, node, step, parent, back, mechanism, via, confidence): how a search from each source first meets every node.

    Edges are walked both ways; back is 1 where one is walked against its direction. A node is
    met first by the earlier found parent, then forward before backward, then by the edge order.
    ``max_depth`` None goes on until nothing new is found.
    """
    walks = numbered_walks(edges)
    start = sources.select("from_id", F.col("from_id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("step"))
    levels = [level.drop("rank").withColumn("step", F.lit(d)) for d, level in enumerate(search_levels(sources, walks, max_depth), 1)]
    return _with_walks(reduce(DataFrame.unionByName, levels, start), walks).select("from_id", "node", "step", *HOP)


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_depth: int | None = None, walks: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, step, src_id, dst_id, mechanism, via, confidence): the hops of one shortest path of each pair.

    One search per distinct source serves all its targets; paths are then walked back from the last
    step to the first, and meet what their walks say at the end. Hops are reported as the edges point.
    A pair that is not connected has no rows, one of equal ends too.
    """
    walks, asked = numbered_walks(edges) if walks is None else walks, pairs.select("from_id", "to_id").distinct()
    levels = search_levels(asked.select("from_id").distinct(), walks, max_depth)
    open_, hops = None, []
    for step in range(len(levels), 0, -1):
        level = levels[step - 1].drop("rank")
        ends = level.join(asked.withColumnRenamed("to_id", "node"), ["from_id", "node"], "left_semi").withColumn("to_id", F.col("node"))
        on = ends if open_ is None else ends.unionByName(open_.join(level, ["from_id", "node"]).select(*ends.columns))
        on = staged(on, "graph-hops")
        hops.append(on.withColumn("step", F.lit(step)))
        open_ = on.select("from_id", "to_id", F.col("parent").alias("node"))
    if not hops:
        return pairs.sparkSession.createDataFrame([], "from_id long, to_id long, step int, src_id long, dst_id long, mechanism string, via string, confidence string")
    return _as_edges(_with_walks(reduce(DataFrame.unionByName, hops), walks))


def meeting_levels(pairs: DataFrame, walks: Callable[[DataFrame], DataFrame], max_depth: int | None = None) -> DataFrame:
    """(from_id, to_id, node, side, level): what searches from both ends of each pair have found when they meet.

    Side 0 searches from from_id, side 1 from to_id, edges both ways. One side of all open pairs
    goes one level further at a time, the one with the smaller frontier; a pair is left as soon as
    a node is on both sides, so the levels of its two sides add up to the length of its paths.
    """
    key = ["from_id", "to_id"]
    ends = pairs.select(*key).distinct().filter(F.col("from_id") != F.col("to_id"))
    seen = cut(ends.select(*key, F.col("from_id").alias("node"), F.lit(0).alias("side"), F.lit(0).alias("level")).unionByName(ends.select(*key, F.col("to_id").alias("node"), F.lit(1).alias("side"), F.lit(0).alias("level"))))
    frontier, level = {k: seen.filter(F.col("side") == k) for k in (0, 1)}, [0, 0]
    size = {k: f.count() for k, f in frontier.items()}
    while size[0] and size[1] and (max_depth is None or sum(level) < max_depth):
        side = 0 if (size[0], level[0]) <= (size[1], level[1]) else 1
        level[side] += 1
        found = frontier[side].join(walks(frontier[side]).select("node", "next"), "node").select(*key, F.col("next").alias("node")).distinct()
        new = cut(found.join(seen.filter(F.col("side") == side).select(*key, "node"), [*key, "node"], "left_anti").select(*key, "node", F.lit(side).alias("side"), F.lit(level[side]).alias("level")))
        seen = seen.unionByName(new)
        done = cut(new.join(seen.filter(F.col("side") == 1 - side).select(*key, "node"), [*key, "node"]).select(*key).distinct())
        frontier = {side: cut(new.join(done, key, "left_anti")), 1 - side: cut(frontier[1 - side].join(done, key, "left_anti"))}
        size = {k: f.count() for k, f in frontier.items()}
    return seen


def two_ended_paths(pairs: DataFrame, walks: Callable[[DataFrame], DataFrame], max_depth: int | None = None) -> DataFrame:
    """The hops of ``shortest_paths`` for pairs that are few beside the services, found from both ends.

    Every node that can precede a node of a shortest path is on a shortest path itself, so a
    search in order over these nodes alone takes the same parents as one over all. They are
    those on a way from a meeting node back to either end, level by level.
    """
    key = ["from_id", "to_id"]
    seen = staged(meeting_levels(pairs, walks, max_depth), "graph-meeting")
    near, far = (seen.filter(F.col("side") == k) for k in (0, 1))
    met = near.join(far.select(*key, "node", F.col("level").alias("rest")), [*key, "node"])
    length = met.groupBy(*key).agg(F.min(F.col("level") + F.col("rest")).alias("length"))
    # all paths of a pair pass its first search's last level that lies on one
    met = met.join(length, key).filter(F.col("level") + F.col("rest") == F.col("length"))
    last = met.groupBy(*key).agg(F.max("level").alias("at"))
    middle = cut(met.join(last, key).filter(F.col("level") == F.col("at")).select(*key, "node", F.col("level").alias("step"), "length"))
    longest = middle.agg(F.max("length")).first()[0] or 0
    on, edge = middle, middle
    for _ in range(longest):  # towards the start, over what the first search has found
        back = edge.filter("step > 0").select(*key, "node", "step", "length")
        prior = back.join(walks(back).select("node", "next"), "node").select(*key, F.col("next").alias("node"), (F.col("step") - 1).alias("step"), "length").distinct()
        edge = cut(prior.join(near.select(*key, "node", F.col("level").alias("step")), [*key, "node", "step"]))
        if edge.isEmpty():
            break
        on = on.unionByName(edge)
    edge = middle
    for _ in range(longest):  # towards the end, over what the second one has found
        open_ = edge.filter(F.col("step") < F.col("length"))
        after = open_.join(walks(open_).select("node", "next"), "node").select(*key, F.col("next").alias("node"), (F.col("step") + 1).alias("step"), "length").distinct()
        edge = cut(after.join(far.select(*key, "node", F.col("level").alias("rest")), [*key, "node"]).filter(F.col("step") + F.col("rest") == F.col("length")).drop("rest"))
        if edge.isEmpty():
            break
        on = on.unionByName(edge)
    on = staged(on.distinct(), "graph-paths")

    frontier = on.filter("step = 0").select(*key, "node", F.lit(0).cast("long").alias("rank"))
    levels = []
    for step in range(1, longest + 1):
        found = frontier.select(*key, F.col("node").alias("parent"), "rank").join(walks(frontier).withColumnRenamed("node", "parent"), "parent")
        new = found.withColumnRenamed("next", "node").join(on.filter(F.col("step") == step).select(*key, "node"), [*key, "node"])
        first = new.groupBy(*key, "node").agg(F.min(F.struct(F.struct("rank", "back", "ord").alias("by"), "parent", "back", *SHOWN)).alias("b"))
        rank = F.row_number().over(W.partitionBy(*key).orderBy("b.by")).cast("long")
        level = cut(first.select(*key, "node", F.lit(step).alias("step"), rank.alias("rank"), *[f"b.{c}" for c in HOP]))
        levels.append(level)
        frontier = level.select(*key, "node", "rank")
    if not levels:
        return pairs.sparkSession.createDataFrame([], "from_id long, to_id long, step int, src_id long, dst_id long, mechanism string, via string, confidence string")
    tree = reduce(DataFrame.unionByName, levels).drop("rank")
    at = tree.filter(F.col("node") == F.col("to_id"))
    hops = at
    for _ in range(longest - 1):
        at = at.filter("step > 1").select(*key, F.col("parent").alias("node"), (F.col("step") - 1).alias("step")).join(tree, [*key, "node", "step"])
        hops = hops.unionByName(at.select(*hops.columns))
    return _as_edges(hops)


def _as_edges(hops: DataFrame) -> DataFrame:
    """Hops as the edges point."""
    forward = F.col("back") == 0
    src, dst = F.when(forward, F.col("parent")).otherwise(F.col("node")), F.when(forward, F.col("node")).otherwise(F.col("parent"))
    return hops.select("from_id", "to_id", "step", src.alias("src_id"), dst.alias("dst_id"), "mechanism", "via", "confidence")


def named(df: DataFrame, repos: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the repository's name; an id without a repository is ``unknown-<id>``."""
    names = repos.select(F.col("id").alias(column), F.col("name").alias(name))
    return df.join(names, column, "left").withColumn(name, F.coalesce(name, F.concat(F.lit("unknown-"), F.col(column))))
