"""Dependencies of services: what they call (upstream) or what calls them (downstream)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.edges import admitted, described, label, metadata_field
from quarry.operators import searches
from quarry.operators.graph import Touched, met, reached_by
from quarry.schema import DIRECT_TYPES, UNRESOLVED, Model
from quarry.session import staged

MAX_DEPTH = 10
LINK_COLUMNS = ("repo_id", "linked_id", "name", "mechanism", "confidence", "segment", "unresolved", "kind", "cls", "e1", "e2")


def _links(rows: DataFrame, cls: int, **columns) -> DataFrame:
    given = {"unresolved": F.lit(None).cast("string"), "e2": F.lit(0).cast("long"), "cls": F.lit(cls)} | columns
    return rows.select(*[given[c].alias(c) if c in given else F.col(c) for c in LINK_COLUMNS])


def _stated(model: Model) -> DataFrame:
    meta = F.col("metadata")
    return model.edges.withColumn("confidence", metadata_field(meta, "confidence")).withColumn("topic", metadata_field(meta, "topic")).withColumn("target_name", metadata_field(meta, "targetName"))


def links(model: Model, direction: str = "upstream", mechanism: str | None = None, touching: Touched | None = None) -> DataFrame:
    """All one-hop links of a direction: (repo_id, linked_id, name, mechanism, confidence, segment, unresolved, kind, order).

    Four classes, in this order: direct calls, events, topics and (upstream only) calls whose
    callee is only a name. With ``touching`` only links that a change of it can make, end or alter.
    """
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"direction is upstream or downstream, not {direction}")
    up = direction == "upstream"
    edges = _stated(model)
    names = model.repos.select(F.col("id").alias("linked_id"), "name")
    of_repo = edges.filter(F.col("source_type") == "repo")
    kind, conf = F.col("relationship_type"), F.col("confidence")
    parts = []
    direct = admitted(mechanism, DIRECT_TYPES)
    if direct:
        rows = of_repo.filter((F.col("target_type") == "repo") & kind.isin(*direct))
        mine, other = ("source_id", "target_id") if up else ("target_id", "source_id")
        rows = rows.select(F.col(mine).alias("repo_id"), F.col(other).alias("linked_id"), kind, conf, F.col("id").alias("e1"))
        if touching is not None:  # an end that changes its name or goes alters the links of others too
            rows = touching.of(rows, "repo_id").unionByName(touching.of(rows, "linked_id")).distinct()
        rows = rows.join(names, "linked_id")
        parts.append(_links(rows, 0, mechanism=described(kind, conf), segment=label(kind), kind=kind))
    mine_kind, other_kind = ("consumes_event", "produces_event") if up else ("produces_event", "consumes_event")
    if mine_kind in admitted(mechanism, ("produces_event", "consumes_event")):
        mine = of_repo.filter(kind == mine_kind).select(F.col("source_id").alias("repo_id"), F.col("target_id").alias("event_id"), F.col("id").alias("e1"))
        other = edges.filter((F.col("target_type") == "event") & (kind == other_kind)).select(F.col("source_id").alias("linked_id"), F.col("target_id").alias("event_id"), F.col("id").alias("e2"))
        events = model.events.select(F.col("id").alias("event_id"), F.col("name").alias("event"))
        # one row per (repository, event) on either side before they meet
        mine, other = mine.groupBy("repo_id", "event_id").agg(F.min("e1").alias("e1")), other.groupBy("linked_id", "event_id").agg(F.min("e2").alias("e2"))
        rows = met(mine.join(events, "event_id"), other, "event_id", "repo_id", "linked_id", touching, "event").join(names, "linked_id")
        parts.append(_links(rows, 1, mechanism=F.concat(F.lit("event ("), F.col("event"), F.lit(")")), confidence=F.lit(None).cast("string"), segment=F.concat(F.lit("event("), F.col("event"), F.lit(")")), kind=F.lit("event"), e2=F.col("e2")))
    mine_kind, other_kind = ("consumes_kafka", "produces_kafka") if up else ("produces_kafka", "consumes_kafka")
    if mine_kind in admitted(mechanism, ("produces_kafka", "consumes_kafka")):
        mine = of_repo.filter((kind == mine_kind) & F.col("topic").isNotNull()).groupBy(F.col("source_id").alias("repo_id"), "topic").agg(F.min("id").alias("e2"))
        # what the other side says (its label and confidence) is shown, in the other side's order
        other = of_repo.filter((kind == other_kind) & F.col("topic").isNotNull()).groupBy(F.col("source_id").alias("linked_id"), "topic", conf).agg(F.min("id").alias("e1"))
        rows = met(mine, other, "topic", "repo_id", "linked_id", touching).filter(F.col("repo_id") != F.col("linked_id")).join(names, "linked_id")
        parts.append(_links(rows, 2, mechanism=described(F.lit(other_kind), conf), segment=F.concat(F.lit("Kafka("), F.col("topic"), F.lit(")")), kind=F.lit("kafka"), e2=F.col("e2")))
    if up and direct:
        rows = (of_repo if touching is None else touching.of(of_repo, "source_id")).filter((F.col("target_type") == "service_name") & kind.isin(*direct)).withColumn("target_name", F.coalesce("target_name", F.lit("unknown")))
        rows = rows.select(F.col("source_id").alias("repo_id"), F.lit(UNRESOLVED).cast("long").alias("linked_id"), F.col("target_name").alias("name"), kind, conf, F.col("id").alias("e1"))
        parts.append(_links(rows, 3, mechanism=described(kind, conf, unresolved=F.col("name")), segment=label(kind), unresolved=F.col("name"), kind=kind))
    if not parts:
        return model.spark.createDataFrame([], "repo_id long, linked_id long, name string, mechanism string, confidence string, segment string, unresolved string, kind string, cls int, e1 long, e2 long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def admits(mechanism: str | None, direction: str) -> Column:
    """Which stored links a mechanism filter leaves: what ``links`` would make with it."""
    if mechanism is None:
        return F.lit(True)
    ends = ("consumes_event", "consumes_kafka") if direction == "upstream" else ("produces_event", "produces_kafka")
    kinds = [*admitted(mechanism, DIRECT_TYPES), *[k.split("_")[1] for k in ends if k in admitted(mechanism, ends)]]
    return F.col("kind").isin(kinds)


def depths(model: Model, seeds: DataFrame, direction: str = "upstream", depth: int | str = 1, mechanism: str | None = None) -> DataFrame:
    """(seed, node, depth) of the repositories among ``dependencies``, for who asks for neither links nor paths: a search over pairs of repositories, once each."""
    rows = links(model, direction, mechanism).filter("unresolved is null")
    steps = staged(rows.select(F.col("repo_id").alias("node"), F.col("linked_id").alias("next")).distinct(), "dependency-steps")
    start = seeds.join(model.repos.select(F.col("id").alias("seed")), "seed", "left_semi")
    return reached_by(start, lambda frontier: steps, MAX_DEPTH if depth == "all" else int(depth))


def all_paths(model: Model, direction: str = "upstream", depth: int | str = 1, mechanism: str | None = None) -> DataFrame:
    """(seed, name, type, mechanism, depth, path) of every repository's ``dependencies``, the path as a text.

    Rows are as many as repositories times what each reaches, so they are made by searches within
    tasks as the result is read; what is written are the first links of each two repositories, and
    the unresolved names, each once.
    """
    limit = MAX_DEPTH if depth == "all" else int(depth)
    rows = links(model, direction, mechanism).filter("repo_id is not null")
    between = rows.filter("unresolved is null").groupBy("repo_id", "linked_id", "mechanism", "segment", "cls", "e2").agg(F.min("e1").alias("e1"))
    order = F.struct("cls", "e1", "e2")
    first = between.groupBy(F.col("repo_id").alias("node"), F.col("linked_id").alias("next")).agg(F.min(F.struct(order.alias("by"), "mechanism", "segment")).alias("l"))
    steps = staged(first.select("node", "next", F.row_number().over(W.partitionBy("node").orderBy("l.by")).alias("nth"), "l.mechanism", "l.segment"), "dependency-steps")
    open_ = rows.filter("unresolved is not null").select(F.col("unresolved").alias("name"), "kind", "repo_id")
    # dealt by name before they are gathered: gathered lists are wider than their rows
    names = staged(open_.repartition("name", "kind").groupBy("name", "kind").agg(F.collect_set("repo_id").alias("owners")), "dependency-names")
    found = searches.all_dependencies(model, steps, names, limit) if limit > 0 else None
    if found is None:
        out = dependencies(model, model.repos.select(F.col("id").alias("seed")), direction, depth, mechanism)
        return out.select("seed", "name", "type", "mechanism", "depth", F.array_join("path", " > ").alias("path"))
    columns = ("seed", "name", "type", "mechanism", "depth", "path")
    out = found[0].withColumn("type", F.lit("repo")).select(*columns)
    for part in found[1]:
        name, kind = F.col("name"), F.col("kind")
        path = F.concat("path", F.lit(" > "), label(kind), F.lit(" > "), name)
        out = out.unionByName(part.select("seed", "name", F.lit("unresolved").alias("type"), described(kind, F.lit(None).cast("string"), unresolved=name).alias("mechanism"), "depth", path.alias("path")))
    return out


def dependencies(
    model: Model, seeds: DataFrame, direction: str = "upstream", depth: int | str = 1, mechanism: str | None = None, repo: str | None = None, near: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(seed, name, type, mechanism, confidence, depth, path, rank) of every seed's dependencies, first found first.

    A repository is found once, by the link that a search in order meets first; an unresolved
    name once per way it is shown, as a leaf. ``repo`` hides other names but still walks
    through them, and hides all unresolved ones. ``near`` gives stored links of a frontier's nodes
    (node), or more; without it all links are made first.
    """
    limit = MAX_DEPTH if depth == "all" else int(depth)
    hops = staged(links(model, direction, mechanism), "dependency-links") if near is None else None
    next_hops = (lambda frontier: hops) if near is None else (lambda frontier: near(frontier).filter(admits(mechanism, direction)))
    start = seeds.join(model.repos.select(F.col("id").alias("seed"), F.col("name")), "seed")
    frontier = start.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("rank"), F.array("name").alias("path"))
    seen = frontier.select("seed", F.concat(F.lit("repo:"), F.col("node")).alias("key"))
    levels = []
    for d in range(1, limit + 1):
        found = frontier.withColumnRenamed("path", "before").join(next_hops(frontier), F.col("node") == F.col("repo_id"))
        key = F.when(F.col("unresolved").isNull(), F.concat(F.lit("repo:"), F.col("linked_id"))).otherwise(F.concat(F.lit("unresolved:"), F.col("unresolved"), F.lit(":"), F.col("mechanism")))
        found = found.withColumn("key", key).join(seen, ["seed", "key"], "left_anti")
        path = F.concat("before", F.array("segment", "name")).alias("path")
        best = found.groupBy("seed", "key").agg(F.min_by(F.struct("linked_id", "name", "mechanism", "confidence", "unresolved", path, F.struct("rank", "cls", "e1", "e2").alias("by")), F.struct("rank", "cls", "e1", "e2")).alias("b"))
        # columns, as names and paths repeat, and no shuffle files stay behind
        level = staged(best.select("seed", "key", "b.*", F.lit(d).alias("depth"), F.row_number().over(W.partitionBy("seed").orderBy("b.by")).cast("long").alias("rank")), "dependency-level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("seed", "key"))
        frontier = level.filter("unresolved is null").select("seed", F.col("linked_id").alias("node"), "rank", "path")
    if not levels:
        return model.spark.createDataFrame([], "seed long, name string, type string, mechanism string, confidence string, depth int, path array<string>, rank long")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    if repo is not None:
        out = out.filter((F.col("name") == repo) & F.col("unresolved").isNull())
    kind = F.when(F.col("unresolved").isNull(), "repo").otherwise("unresolved")
    return out.select("seed", "name", kind.alias("type"), "mechanism", "confidence", "depth", "path", "rank")
