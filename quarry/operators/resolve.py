"""Resolution of names to entities, and the edges that follow.

The reference points are sets: a name is looked up in its own repository first,
then anywhere with the least id, so results do not depend on the order in which
repositories were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import camel_of_kebab, like_anywhere, number_of_key, snake_of_kebab
from quarry.operators.names import ending, matched
from quarry.session import staged

RELATIONSHIP_OF = {"grpc": "calls_grpc", "http": "calls_http", "gateway": "routes_to"}


def edge_rows(df: DataFrame, source_type: str, source_id: str | Column, target_type: Column, target_id: Column, relationship: Column, source_file: str | Column, metadata: Column, repo_id: str | Column = "repo_id") -> DataFrame:
    """Edges with an id of their natural key."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    rows = df.select(F.lit(source_type).alias("source_type"), c(source_id).cast("long").alias("source_id"), target_type.alias("target_type"), target_id.cast("long").alias("target_id"), relationship.alias("relationship_type"), c(source_file).alias("source_file"), metadata.cast("string").alias("metadata"), c(repo_id).cast("long").alias("repo_id"))
    key = number_of_key(F.lit("edge"), *[F.col(k) for k in ("source_type", "source_id", "target_type", "target_id", "relationship_type", "source_file", "metadata")])
    return rows.withColumn("id", key).dropDuplicates(["id"])


def looked_up(df: DataFrame, table: DataFrame, name: str, found: str) -> DataFrame:
    """``df`` with the least id of the entity of that name: its own repository's, else any; null if there is none.

    ``table`` has id, repo_id and name; both lookups are reduced to one row per key first.
    """
    own = table.groupBy("repo_id", F.col("name").alias(name)).agg(F.min("id").alias("__own"))
    anywhere = table.groupBy(F.col("name").alias(name)).agg(F.min("id").alias("__any"))
    return df.join(own, ["repo_id", name], "left").join(anywhere, name, "left").withColumn(found, F.coalesce("__own", "__any")).drop("__own", "__any")


def event_links(relationships: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of event relationships, and the events that consumers name but nobody defines."""
    rows = looked_up(relationships, events, "event_name", "event_id")
    open_ = rows.filter("event_id is null and type = 'consumes_event'")
    made = open_.groupBy("repo_id", "event_name").agg(F.min("path").alias("source_file"))
    made = made.select(number_of_key(F.lit("consumed"), F.col("repo_id"), F.col("event_name")).alias("id"), "repo_id", F.col("event_name").alias("name"), F.concat(F.lit("consumed: "), "event_name").alias("schema_definition"), "source_file")
    anywhere = made.groupBy(F.col("name").alias("event_name")).agg(F.min("id").alias("made_id"))
    full = rows.join(anywhere, "event_name", "left").withColumn("target", F.coalesce("event_id", F.when(F.col("type") == "consumes_event", F.col("made_id")))).filter("target is not null")
    kept = made.join(anywhere.select(F.col("made_id").alias("id")), "id", "left_semi")
    return edge_rows(full, "repo", "repo_id", F.lit("event"), F.col("target"), F.col("type"), "path", F.lit(None)), kept


def association_links(modules: DataFrame, stored: DataFrame) -> DataFrame:
    """Module-to-module edges of schema associations; a target that is not stored gives none."""
    rows = modules.select("repo_id", "path", F.col("name").alias("source_name"), F.explode("associations").alias("a")).select("repo_id", "path", "source_name", "a.kind", F.col("a.target").alias("target_name"))
    own = stored.groupBy("repo_id", F.col("name").alias("source_name")).agg(F.min("id").alias("source_module"))
    full = looked_up(rows.join(own, ["repo_id", "source_name"]), stored, "target_name", "target_module").filter("target_module is not null")
    return edge_rows(full, "module", "source_module", F.lit("module"), F.col("target_module"), F.col("kind"), "path", F.lit(None))


def field_links(fields: DataFrame) -> DataFrame:
    """maps_to edges: a schema's field and a message's field of one name in one repository."""
    side = lambda kind, name: fields.filter(F.col("parent_type") == kind).select("repo_id", "field_name", F.col("id").alias(name), F.col("source_file").alias(f"{name}_file"))
    rows = side("ecto_schema", "ecto").join(side("proto_message", "proto"), ["repo_id", "field_name"])
    return edge_rows(rows, "field", "ecto", F.lit("field"), F.col("proto"), F.lit("maps_to"), "ecto_file", F.lit(None))


def with_parents(fields: DataFrame, modules: DataFrame, events: DataFrame) -> DataFrame:
    """Fields with the ids of their schema's module or their message's event, by name within the repository."""
    first = lambda t, name: t.groupBy("repo_id", F.col("name").alias("parent_name")).agg(F.min("id").alias(name))
    rows = fields.join(first(modules, "__module"), ["repo_id", "parent_name"], "left").join(first(events, "__event"), ["repo_id", "parent_name"], "left")
    message = F.col("parent_type") == "proto_message"
    return rows.withColumn("module_id", F.when(~message, F.col("__module"))).withColumn("event_id", F.when(message, F.col("__event"))).drop("__module", "__event")


def like_matches(names: DataFrame, table: DataFrame) -> DataFrame:
    """(name, id): the least id of ``table`` whose name contains ``name``, wildcards included.

    Candidates share the rarest run of characters of the looked-up name.
    """
    pairs = matched(names.select(F.col("name").alias("needle")), table.select("id", "name"))
    return pairs.groupBy(F.col("needle").alias("name")).agg(F.min("id").alias("id"))


def topology_targets(targets: DataFrame, repos: DataFrame, services: DataFrame) -> DataFrame:
    """(target, repo_id): repositories that topology targets name.

    In this order: a repository of that name; one whose name contains it; for a qualified name
    the owner of the service of its last part, or of one whose name contains that part.
    """
    rows = targets.select("target").distinct()
    exact = repos.groupBy(F.col("name").alias("target")).agg(F.min("id").alias("exact"))
    rows = rows.join(exact, "target", "left")
    near = like_matches(rows.filter("exact is null").select(F.col("target").alias("name")), repos).select(F.col("name").alias("target"), F.col("id").alias("near"))
    rows = rows.join(near, "target", "left").withColumn("short", F.when(F.size(F.split("target", r"\.")) > 1, F.element_at(F.split("target", r"\."), -1)))
    by_name = services.groupBy(F.col("name").alias("short")).agg(F.min("id").alias("service"))
    rows = rows.join(by_name, "short", "left")
    open_ = rows.filter("exact is null and near is null and service is null and short is not null").select(F.col("short").alias("name")).distinct()
    close = like_matches(open_, services).select(F.col("name").alias("short"), F.col("id").alias("close"))
    rows = rows.join(close, "short", "left").withColumn("service", F.coalesce("service", "close"))
    owner = services.select(F.col("id").alias("service"), F.col("repo_id").alias("owner"))
    return rows.join(owner, "service", "left").select("target", F.coalesce("exact", "near", "owner").alias("target_repo"))


def topology_links(found: DataFrame, repos: DataFrame, services: DataFrame) -> DataFrame:
    """Edges of topology rows, once per (repository, relationship, target): the first by mechanism, path and place."""
    kind = F.when(F.col("mechanism") == "kafka", F.when(F.element_at("metadata", "role") == "consumer", "consumes_kafka").otherwise("produces_kafka"))
    for mechanism, relationship in RELATIONSHIP_OF.items():
        kind = kind.when(F.col("mechanism") == mechanism, relationship)
    rows = found.withColumn("relationship", kind.otherwise(F.col("mechanism"))).join(topology_targets(found, repos, services), "target", "left")
    key = F.coalesce(F.concat(F.lit("repo:"), F.col("target_repo")), F.concat(F.lit("unresolved:"), F.col("target")))
    first = F.row_number().over(W.partitionBy("repo_id", "relationship", "key").orderBy("kind", "path", "nth"))
    rows = rows.withColumn("key", key).withColumn("first", first).filter("first = 1")
    known = F.col("target_repo").isNotNull()
    extra = F.when(known, F.create_map(F.lit("confidence"), F.col("confidence"))).otherwise(F.create_map(F.lit("confidence"), F.col("confidence"), F.lit("unresolved"), F.lit("true"), F.lit("targetName"), F.col("target")))
    meta = F.to_json(F.map_concat("metadata", extra))
    return edge_rows(rows, "repo", "repo_id", F.when(known, "repo").otherwise("service_name"), F.coalesce("target_repo", F.lit(0)), F.col("relationship"), "path", meta)


def catalog_matches(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """(catalog_id, event_id, strategy): events that catalog ids like ``event:payment-failed`` mean.

    All events of the first strategy that finds any: the camel-cased name, a name that ends in
    it, or a ``Payload`` whose file's path holds the snake-cased name.
    """
    slug = F.regexp_replace("catalog_id", "^event:", "")
    # both sides and what each strategy leaves are used several times: made once
    wanted = staged(catalog.select("catalog_id").distinct().withColumn("camel", camel_of_kebab(slug)).withColumn("snake", snake_of_kebab(slug)), "catalog-ids")
    stored = staged(events.select(F.col("id").alias("event_id"), "name", "source_file"), "catalog-events")
    exact = wanted.join(stored, F.col("camel") == F.col("name")).select("catalog_id", "event_id", F.lit(1).alias("strategy"))
    rest = staged(wanted.join(exact.select("catalog_id").distinct(), "catalog_id", "left_anti"), "catalog-rest")
    near = lambda column, table, find: rest.join(find(rest.select(F.col(column).alias("needle")), table).withColumnRenamed("needle", column), column)
    suffix = staged(near("camel", stored.select(F.col("event_id").alias("id"), "name"), ending).select("catalog_id", F.col("id").alias("event_id"), F.lit(2).alias("strategy")), "catalog-suffixes")
    rest = staged(rest.join(suffix.select("catalog_id").distinct(), "catalog_id", "left_anti"), "catalog-open")
    payloads = stored.filter("name = 'Payload'").select(F.col("event_id").alias("id"), F.col("source_file").alias("name"))
    payload = near("snake", payloads, matched).select("catalog_id", F.col("id").alias("event_id"), F.lit(3).alias("strategy"))
    return exact.unionByName(suffix).unionByName(payload)


def event_domains(domains: DataFrame, services: DataFrame) -> DataFrame:
    """(catalog_id, domain): by way of the services that domains (ord, name, services) list and the events that services (id, events) send; the last domain counts."""
    rows = domains.select("ord", F.col("name").alias("domain"), F.explode("services").alias("service_id")).join(services.select(F.col("id").alias("service_id"), F.explode("events").alias("catalog_id")), "service_id")
    return rows.groupBy("catalog_id").agg(F.max_by("domain", "ord").alias("domain"))


def enriched_events(events: DataFrame, catalog: DataFrame, domains: DataFrame) -> DataFrame:
    """Events with the domain and first owner of the catalog entry that means them; ``catalog`` has catalog_id and owners, ``domains`` catalog_id and domain."""
    stated = catalog.select("catalog_id", F.get("owners", F.lit(0)).alias("owner")).join(domains, "catalog_id", "left")
    by_event = catalog_matches(catalog, events).join(stated, "catalog_id").groupBy(F.col("event_id").alias("id")).agg(F.max_by(F.struct("domain", "owner"), "catalog_id").alias("c"))
    rows = events.join(by_event, "id", "left")
    matched = F.col("c").isNotNull()
    return rows.withColumn("domain", F.when(matched, F.col("c.domain")).otherwise(F.col("domain"))).withColumn("owner_team", F.when(matched, F.col("c.owner")).otherwise(F.col("owner_team"))).select(*events.columns)
