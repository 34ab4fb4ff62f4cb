"""Overview cards of services: connections, events, modules and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.schema import DIRECT_TYPES, Model

CONNECTION_CAP, TOP_MODULES = 20, 5


def connections(model: Model, edges: DataFrame) -> DataFrame:
    """(repo_id, side, mechanism, name): distinct partners; side is talks_to or called_by.

    Direct calls, events and topics count; loops, unresolved names and ids without a
    repository do not.
    """
    kept = edges.filter(((F.col("cls") == 0) & F.col("relationship_type").isin(*DIRECT_TYPES)) | F.col("cls").isin(1, 2))
    names = model.repos.select(F.col("id").alias("other"), "name")
    own = model.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("own_name"))
    sides = kept.select(F.col("src_id").alias("repo_id"), F.col("dst_id").alias("other"), F.lit("talks_to").alias("side"), "mechanism").unionByName(
        kept.select(F.col("dst_id").alias("repo_id"), F.col("src_id").alias("other"), F.lit("called_by").alias("side"), "mechanism")
    )
    return sides.distinct().join(names, "other").join(own, "repo_id").filter(F.col("name") != F.col("own_name")).select("repo_id", "side", "mechanism", "name").distinct()


def connection_groups(found: DataFrame) -> DataFrame:
    """(repo_id, side, mechanism, n, names): partners by mechanism, names sorted."""
    return found.groupBy("repo_id", "side", "mechanism").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def capped(groups: DataFrame, cap: int = CONNECTION_CAP) -> DataFrame:
    """The groups with at most ``cap`` names a side in all: the largest groups give names up first, down to one each.

    The largest group then also says how many are not shown. Groups of one size are taken by
    mechanism.
    """
    order = W.partitionBy("repo_id", "side").orderBy(F.col("n").desc(), "mechanism")
    side = W.partitionBy("repo_id", "side")
    excess = F.greatest(F.sum("n").over(side) - F.lit(cap), F.lit(0))
    rows = groups.withColumn("excess", excess).withColumn("place", F.row_number().over(order))
    given = F.coalesce(F.sum(F.col("n") - 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = F.least(F.col("n") - 1, F.greatest(F.col("excess") - given, F.lit(0)))
    shown = F.slice("names", F.lit(1), (F.col("n") - F.col("cut")).cast("int"))
    more = F.concat(F.lit("...and "), F.col("excess"), F.lit(" more"))
    names = F.when((F.col("excess") > 0) & (F.col("place") == 1), F.array_append(shown, more)).otherwise(shown)
    return rows.withColumn("cut", cut).select("repo_id", "side", "mechanism", "n", names.alias("names"))


def connection_summaries(model: Model, groups: DataFrame) -> DataFrame:
    """(repo_id, name, talks_to, called_by, summary): sums over mechanisms, before any cap."""
    part = F.concat(F.col("n"), F.lit(" via "), F.col("mechanism"))
    out = F.col("side") == "talks_to"
    sums = groups.groupBy("repo_id").agg(
        F.sum(F.when(out, F.col("n")).otherwise(0)).alias("talks_to"),
        F.sum(F.when(~out, F.col("n")).otherwise(0)).alias("called_by"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(out, F.struct("mechanism", part.alias("text"))))), lambda p: p["text"]), ", ").alias("parts"),
    )
    rows = model.repos.select(F.col("id").alias("repo_id"), "name").join(sums, "repo_id", "left").fillna(0, ["talks_to", "called_by"])
    breakdown = F.when(F.col("talks_to") > 0, F.concat(F.lit(" ("), F.col("parts"), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("Talks to "), F.col("talks_to"), F.lit(" services"), breakdown, F.lit(". Called by "), F.col("called_by"), F.lit(" services."))
    return rows.select("repo_id", "name", "talks_to", "called_by", text.alias("summary"))


def event_lists(model: Model) -> DataFrame:
    """(repo_id, produces, consumes): event names, sorted, repeats kept."""
    rows = model.edges.filter("source_type = 'repo' and relationship_type in ('produces_event', 'consumes_event')").join(model.events.select(F.col("id").alias("target_id"), "name"), "target_id")
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("relationship_type") == kind, F.col("name"))))
    return rows.groupBy(F.col("source_id").alias("repo_id")).agg(listed("produces_event").alias("produces"), listed("consumes_event").alias("consumes"))


def module_groups(model: Model, top: int = TOP_MODULES) -> DataFrame:
    """(repo_id, type, n, top): modules by type with their first names; modules without a type are left out."""
    rows = model.modules.filter("type is not null")
    counts = rows.groupBy("repo_id", "type").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("repo_id", "type").orderBy("name", "id"))).filter(F.col("place") <= top)
    names = first.groupBy("repo_id", "type").agg(F.array_sort(F.collect_list("name")).alias("top"))
    return counts.join(names, ["repo_id", "type"])


def counts(model: Model) -> DataFrame:
    """(repo_id, name, files, grpc_services)."""
    files = model.files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    services = model.services.groupBy("repo_id").agg(F.count(F.lit(1)).alias("grpc_services"))
    rows = model.repos.select(F.col("id").alias("repo_id"), "name")
    return rows.join(files, "repo_id", "left").join(services, "repo_id", "left").fillna(0, ["files", "grpc_services"])
