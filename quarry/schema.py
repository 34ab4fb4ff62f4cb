"""Tables of the relational model, their enumerations, and empty instances."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 10

#: Column definitions of every stored table. Ids are hashes of natural keys, so no table needs a global counter.
TABLES = {
    "repos": "id long, name string, path string, description string, last_indexed_commit string, default_branch string, created_at timestamp, updated_at timestamp",
    "files": "id long, repo_id long, path string, language string, summary string",
    "modules": "id long, repo_id long, file_id long, name string, type string, summary string, table_name string, schema_fields array<struct<name:string,type:string>>",
    "services": "id long, repo_id long, name string, description string, service_type string",
    "events": "id long, repo_id long, name string, schema_definition string, source_file string, file_id long, domain string, owner_team string",
    "edges": "id long, source_type string, source_id long, target_type string, target_id long, relationship_type string, source_file string, metadata string, repo_id long",
    "learned_facts": "id long, content string, repo string, created_at timestamp",
    "fields": "id long, repo_id long, parent_type string, parent_name string, field_name string, field_type string, nullable boolean, source_file string, module_id long, event_id long",
}

#: Target of an edge whose callee is not known; no repository has this id.
UNRESOLVED = 0

#: Kinds of entities and their sub-types.
COARSE_TYPES = ("repo", "file", "module", "service", "event", "learned_fact", "field")
SEARCHED_TYPES = ("repo", "module", "event", "service", "field")
MODULE_SUB_TYPES = ("schema", "context", "command", "query", "graphql_type", "graphql_query", "graphql_mutation", "absinthe_object", "absinthe_query", "absinthe_mutation")
SERVICE_SUB_TYPES = ("grpc",)
DIRECT_TYPES = ("calls_grpc", "calls_http", "routes_to")

#: Relationship type to the graph's mechanism; other types keep their name.
MECHANISM_OF = {
    "calls_grpc": "grpc",
    "calls_http": "http",
    "routes_to": "gateway",
    "produces_event": "event",
    "consumes_event": "event",
    "produces_kafka": "kafka",
    "consumes_kafka": "kafka",
}

#: Relationship type to the label that people read.
LABEL_OF = {
    "calls_grpc": "gRPC",
    "calls_http": "HTTP",
    "routes_to": "Gateway",
    "produces_kafka": "Kafka producer",
    "consumes_kafka": "Kafka consumer",
    "produces_event": "Kafka producer",
    "consumes_event": "Kafka consumer",
    "exposes_graphql": "GraphQL",
}

#: Mechanism filter to the relationship types that it admits.
FILTER_TYPES = {
    "grpc": ("calls_grpc",),
    "http": ("calls_http",),
    "gateway": ("routes_to",),
    "kafka": ("produces_kafka", "consumes_kafka"),
    "event": ("produces_event", "consumes_event"),
}


@dataclass(frozen=True)
class Model:
    """The tables that queries run over."""

    repos: DataFrame
    files: DataFrame
    modules: DataFrame
    services: DataFrame
    events: DataFrame
    edges: DataFrame
    learned_facts: DataFrame
    fields: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.repos.sparkSession

    def with_tables(self, **tables: DataFrame) -> Model:
        return replace(self, **tables)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


def empty_model(spark: SparkSession) -> Model:
    return Model(**{name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()})


def model_of(spark: SparkSession, **rows: list) -> Model:
    """A model of literal rows: lists of dicts, whose missing columns are null."""
    from pyspark.sql.types import StructType

    tables = {}
    for name, ddl in TABLES.items():
        schema = StructType.fromDDL(ddl)
        tables[name] = spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows.get(name, [])], schema)
    return Model(**tables)
