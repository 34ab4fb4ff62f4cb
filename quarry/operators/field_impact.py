"""Where a field comes from, which messages carry it and who may receive it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.graph import named
from quarry.schema import UNRESOLVED, Model

_HOP = ("field", "repo_id", "repo", "parent_type", "parent_name", "field_type", "nullable")


def occurrences(model: Model, names: DataFrame) -> DataFrame:
    """(field, id, repo_id, repo, parent_type, parent_name, field_type, nullable) of the fields named in ``names`` (field)."""
    rows = model.fields.join(names.select(F.col("field").alias("field_name")), "field_name")
    repos = model.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
    return rows.join(repos, "repo_id").select(F.col("field_name").alias("field"), "id", *_HOP[1:])


def boundaries(found: DataFrame) -> DataFrame:
    """The first message occurrence of each (field, repository, message), with its order among them."""
    first = W.partitionBy("field", "repo_id", "parent_name").orderBy("id")
    rows = found.filter("parent_type = 'proto_message'").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("field").orderBy("repo", "id")))


def boundary_topics(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(field, repo, parent_name, field_type, nullable, topics): what the boundary's repository publishes, in edge order."""
    out = edges.filter(F.col("mechanism").isin("kafka", "event") & F.col("via").isNotNull())
    listed = out.groupBy(F.col("src_id").alias("repo_id")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("cls", "e1", "e2", "via"))), lambda e: e["via"])).alias("topics"))
    return at.join(listed, "repo_id", "left").select("field", "repo", "parent_name", "field_type", "nullable", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "place")


def inferred_consumers(model: Model, edges: DataFrame, at: DataFrame) -> DataFrame:
    """(field, repo_id, repo, via_topic, via_event): subscribers of a boundary that are no boundary themselves.

    The first edge counts: by the boundaries' order, then the edges'. The event is the first
    message of the boundary's repository.
    """
    firsts = at.groupBy("field", "repo_id").agg(F.min("place").alias("place"), F.min_by("parent_name", "place").alias("event"))
    out = edges.filter(F.col("mechanism").isin("kafka", "event") & (F.col("dst_id") != UNRESOLVED))
    reach = firsts.join(out, F.col("repo_id") == F.col("src_id")).select("field", "place", "event", "dst_id", "via", "cls", "e1", "e2")
    others = reach.join(at.select("field", F.col("repo_id").alias("dst_id")).distinct(), ["field", "dst_id"], "left_anti")
    best = others.groupBy("field", "dst_id").agg(F.min_by(F.struct("via", "event"), F.struct("place", "cls", "e1", "e2")).alias("b"))
    rows = best.select("field", F.col("dst_id").alias("repo_id"), F.col("b.via").alias("via_topic"), F.when(F.col("b.via").isNotNull(), F.col("b.event")).alias("via_event"))
    return named(rows, model.repos, "repo_id", "repo")


def consumers(model: Model, edges: DataFrame, found: DataFrame) -> DataFrame:
    """Inferred consumers; one whose repository has the field in a schema or type is confirmed, with its first occurrence."""
    likely = inferred_consumers(model, edges, boundaries(found))
    order = F.struct("parent_type", "id")
    own = found.filter("parent_type <> 'proto_message'").groupBy("field", "repo_id").agg(F.min_by(F.struct("parent_type", "parent_name", "field_type", "nullable"), order).alias("own"))
    rows = likely.join(own, ["field", "repo_id"], "left")
    return rows.select("field", "repo_id", "repo", F.when(F.col("own").isNull(), "inferred").otherwise("confirmed").alias("confidence"), "via_topic", "via_event", "own.parent_type", "own.parent_name", "own.field_type", "own.nullable")


def origins(model: Model, edges: DataFrame, found: DataFrame) -> DataFrame:
    """Schema and type occurrences in repositories that are no consumers; all of them where no message carries the field."""
    likely = inferred_consumers(model, edges, boundaries(found)).select("field", "repo_id")
    return found.filter("parent_type <> 'proto_message'").join(likely, ["field", "repo_id"], "left_anti").select(*_HOP)


def field_impact_summaries(model: Model, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(field, origins, boundaries, consumers, repos, summary) of every name."""
    found = occurrences(model, names)
    parts = {"origins": origins(model, edges, found).select("field", "repo"), "boundaries": boundaries(found).select("field", "repo"), "consumers": consumers(model, edges, found).select("field", "repo")}
    rows = None
    for kind, part in parts.items():
        part = part.withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(k)
    sums = rows.groupBy("field").agg(*[count(k) for k in parts], F.count_distinct("repo").alias("repos"))
    out = names.select("field").join(sums, "field", "left")
    text = F.format_string("%s: %d origins, %d boundaries, %d consumers across %d repos", "field", *parts, "repos")
    none = F.concat("field", F.lit(": no occurrences found"))
    return out.withColumn("summary", F.when(F.col("repos").isNull(), none).otherwise(text)).fillna(0, [*parts, "repos"])
