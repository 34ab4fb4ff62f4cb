"""Extraction of modules, messages, types, events and calls from source files.

Input is a table of files (repo_id, path, content). What one pattern can state
is a column expression; the three languages with nested bodies go through one
Arrow table function each, which sees each file once.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import number_of_key
from quarry.operators import fixed_values as V
from quarry.operators import parsers

MODULE_ROW = (
    "name string, type string, moduledoc string, functions array<string>, table_name string, schema_fields array<struct<name:string,type:string>>, "
    "associations array<struct<kind:string,name:string,target:string>>, absinthe_types array<struct<kind:string,name:string>>, grpc_stubs array<string>, "
    "required_fields array<string>, optional_fields array<string>, cast_fields array<string>"
)
MESSAGE_ROW = "name string, fields array<struct<name:string,type:string,optional:boolean>>"
SERVICE_ROW = "name string, rpcs array<struct<name:string,input:string,output:string>>"
TYPE_ROW = "kind string, name string, body string, extended boolean"


def lib_path(path: Column) -> Column:
    return path.rlike(V.LIB_PATH)


def test_path(path: Column) -> Column:
    return path.rlike(V.TEST_PATH)


def parsed(files: DataFrame, parse: Callable[[str], list[dict]], row: str) -> DataFrame:
    """(repo_id, path, ord, *row): the rows that ``parse`` finds in each file, in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"repo_id long, path string, ord int, {row}")

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [{"repo_id": r, "path": p, "ord": k} | found for r, p, c in zip(*(col.to_pylist() for col in batch.columns)) for k, found in enumerate(parse(c or ""))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("repo_id", "path", "content").mapInArrow(run, schema)


def elixir_modules(files: DataFrame) -> DataFrame:
    """Modules of the library's Elixir sources."""
    path = F.col("path")
    return parsed(files.filter(path.endswith(".ex") & lib_path(path)), parsers.elixir_modules, MODULE_ROW)


def proto_messages(files: DataFrame) -> DataFrame:
    return parsed(files.filter(F.col("path").endswith(".proto")), parsers.proto_messages, MESSAGE_ROW)


def proto_services(files: DataFrame) -> DataFrame:
    return parsed(files.filter(F.col("path").endswith(".proto")), parsers.proto_services, SERVICE_ROW)


def graphql_types(files: DataFrame) -> DataFrame:
    return parsed(files.filter(F.col("path").endswith(".graphql")), parsers.graphql_types, TYPE_ROW)


def graphql_fields(types: DataFrame) -> DataFrame:
    """(repo_id, path, parent_name, name, type, nullable) of the types whose bodies declare fields, by column expressions."""
    pattern = F.lit("(?m)" + V.GRAPHQL_FIELD)
    body = F.col("body")
    pairs = F.arrays_zip(F.regexp_extract_all(body, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(body, pattern, F.lit(2)).alias("type"))
    rows = types.filter(F.col("kind").isin(*parsers.FIELD_KINDS)).select("repo_id", "path", F.col("name").alias("parent_name"), F.posexplode(pairs).alias("nth", "f"))
    return rows.select("repo_id", "path", "parent_name", F.col("f.name").alias("name"), F.col("f.type").alias("type"), (~F.col("f.type").endswith("!")).alias("nullable"))


def _all(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(group))


def _sources(files: DataFrame, tests: bool = False) -> DataFrame:
    path = F.col("path")
    rows = files.filter(path.endswith(".ex") & lib_path(path) & F.col("content").isNotNull())
    return rows if tests else rows.filter(~test_path(path))


def event_relationships(files: DataFrame, messages: DataFrame) -> DataFrame:
    """(repo_id, type, event_name, path, handler_module): a message is produced where it is defined; handlers consume.

    Within a file each way of consuming names an event once.
    """
    made = messages.select("repo_id", F.lit("produces_event").alias("type"), F.col("name").alias("event_name"), "path", F.lit(None).cast("string").alias("handler_module"))
    consumer = F.col("content").rlike(V.CONSUMER_USE + r"\s*,")
    none = F.array().cast("array<string>")
    named = lambda way, names: F.transform(names, lambda n: F.struct(F.lit(way).alias("way"), n.alias("name")))
    schemas = F.filter(_all(V.SCHEMA_REF), lambda s: ~s.isin("Payload", "Schema"))
    ways = F.concat(named("handle", _all(V.HANDLED_STRUCT)), named("decoded", _all(V.DECODED_STRUCT)), named("topic", F.when(consumer, _all(V.TOPIC_KEY)).otherwise(none)), named("schema", F.when(consumer, schemas).otherwise(none)))
    module = F.nullif(F.regexp_extract("content", r"defmodule\s+([\w.]+)", 1), F.lit(""))
    used = _sources(files, tests=True).select("repo_id", "path", module.alias("handler_module"), F.explode(F.array_distinct(ways)).alias("w"))
    return made.unionByName(used.select("repo_id", F.lit("consumes_event").alias("type"), F.col("w.name").alias("event_name"), "path", "handler_module"))


def rpc_domain(name: Column, organizations: tuple[str, ...] = ()) -> Column:
    """The domain that a qualified RPC module names.

    After a leading ``Rpc`` the next part; before an inner one the nearest part that is no
    packaging and no organization; else the first part after it that is no version and no
    role; else the second part, or the name itself.
    """
    parts = F.split(name, r"\.")
    at, size = F.array_position(parts, "Rpc").cast("int"), F.size(parts)
    before = F.filter(F.reverse(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)))), lambda p: ~p.isin(*V.RPC_NOISE_BEFORE, *organizations))
    after = F.filter(F.slice(parts, at + 1, size), lambda p: ~p.rlike(r"^V\d+$") & ~p.isin(*V.RPC_NOISE_AFTER))
    first = lambda a: F.get(a, F.lit(0))
    return (
        F.when((at == 1) & (size > 1), F.get(parts, F.lit(1)))
        .when((at > 0) & first(before).isNotNull(), first(before))
        .when((at > 0) & first(after).isNotNull(), first(after))
        .when(size >= 2, F.get(parts, F.lit(1)))
        .otherwise(name)
    )


TOPOLOGY = ("repo_id", "mechanism", "path", "target", "metadata", "confidence", "kind", "nth")


def _edges(rows: DataFrame, mechanism: str, confidence: str, target: Column, kind: int, **metadata: Column) -> DataFrame:
    meta = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v)])
    return rows.select("repo_id", F.lit(mechanism).alias("mechanism"), "path", target.alias("target"), meta.alias("metadata"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"), "nth")


def grpc_edges(files: DataFrame, modules: DataFrame, organizations: tuple[str, ...] = ()) -> DataFrame:
    """One client per (repository, domain): a mockable one, the last found; else a plain one, else a stub, the first found."""
    src = _sources(files)
    mock = _edges(src.select("repo_id", "path", F.posexplode(_all(V.MOCKABLE_CLIENT)).alias("nth", "m")), "grpc", "high", F.col("m"), 0, stub=F.col("m"), pattern=F.lit("mockable"))
    pair = F.arrays_zip(_all(V.PLAIN_CLIENT, 1).alias("service"), _all(V.PLAIN_CLIENT, 2).alias("stub"))
    plain = _edges(src.select("repo_id", "path", F.posexplode(pair).alias("nth", "m")), "grpc", "high", F.col("m.service"), 1, stub=F.col("m.stub"), pattern=F.lit("client"))
    stubs = modules.filter(~test_path(F.col("path"))).select("repo_id", "path", "ord", F.posexplode("grpc_stubs").alias("k", "m")).withColumn("nth", F.col("ord") * 10_000 + F.col("k"))
    direct = _edges(stubs, "grpc", "high", F.col("m"), 2, stub=F.col("m"), pattern=F.lit("direct"))
    found = mock.unionByName(plain).unionByName(direct).withColumn("domain", F.lower(rpc_domain(F.col("target"), organizations)))
    forward = F.row_number().over(W.partitionBy("repo_id", "domain", "kind").orderBy("path", "nth"))
    backward = F.row_number().over(W.partitionBy("repo_id", "domain", "kind").orderBy(F.col("path").desc(), F.col("nth").desc()))
    place = F.struct("kind", F.when(F.col("kind") == 0, F.col("backward")).otherwise(F.col("forward")).alias("place"))
    ranked = found.withColumn("forward", forward).withColumn("backward", backward).withColumn("place", place)
    return ranked.withColumn("best", F.row_number().over(W.partitionBy("repo_id", "domain").orderBy("place"))).filter("best = 1").select(*TOPOLOGY)


def url_host(url: Column) -> Column:
    """The host of an absolute URL in lower case, null for anything else."""
    return F.nullif(F.lower(F.regexp_extract(url, V.URL_HOST, 1)), F.lit(""))


def external_host(host: Column) -> Column:
    """Whether a host is, or is below, one of the external domains; an unknown host counts as external."""
    listed = F.array(*[F.lit(d) for d in V.EXTERNAL_DOMAINS])
    return host.isNull() | F.exists(listed, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def http_edges(files: DataFrame) -> DataFrame:
    """Base addresses that are not external; the target is the first label of the host."""
    both = F.concat(_all(V.TESLA_URL), _all(V.BASE_URL))
    rows = _sources(files).select("repo_id", "path", F.posexplode(both).alias("nth", "url")).withColumn("host", url_host(F.col("url"))).filter(~external_host(F.col("host")))
    return _edges(rows, "http", "low", F.split_part("host", F.lit("."), F.lit(1)), 3, url=F.col("url"))


def gateway_edges(files: DataFrame) -> DataFrame:
    """Services that a gateway composes, by the repository of their schema."""
    pair = F.arrays_zip(_all(V.GATEWAY_SERVICE, 1).alias("service"), _all(V.GATEWAY_SERVICE, 2).alias("repo"))
    rows = files.filter(F.col("path").rlike(V.GATEWAY_PATH)).select("repo_id", "path", F.posexplode(pair).alias("nth", "m"))
    return _edges(rows, "gateway", "medium", F.col("m.repo"), 4, serviceName=F.col("m.service"), repo=F.col("m.repo"))


def kafka_edges(files: DataFrame) -> DataFrame:
    """Topics that a file produces (named by an attribute, with a sign of producing) or consumes (as keys, or as a list of one)."""
    none = F.array().cast("array<string>")
    made = F.when(F.col("content").rlike(V.PRODUCER_SIGN), _all(V.TOPIC_ATTRIBUTE)).otherwise(none)
    keys = F.when(F.col("content").rlike(V.CONSUMER_USE), _all(V.TOPIC_KEY)).otherwise(none)
    lists = F.array_except(_all(V.TOPIC_LIST), keys)
    role = lambda r, topics: F.transform(topics, lambda t: F.struct(F.lit(r).alias("role"), t.alias("topic")))
    rows = _sources(files).select("repo_id", "path", F.posexplode(F.concat(role("producer", made), role("consumer", keys), role("consumer", lists))).alias("nth", "t"))
    return _edges(rows, "kafka", "high", F.col("t.topic"), 5, topic=F.col("t.topic"), role=F.col("t.role"))


def topology_edges(files: DataFrame, modules: DataFrame, organizations: tuple[str, ...] = ()) -> DataFrame:
    """All four mechanisms; their order is (kind, path, nth)."""
    return grpc_edges(files, modules, organizations).unionByName(http_edges(files)).unionByName(gateway_edges(files)).unionByName(kafka_edges(files))


# --- rows of the model's tables -----------------------------------------------------------------------------------


def service_rows(services: DataFrame) -> DataFrame:
    call = F.transform("rpcs", lambda r: F.concat(r["name"], F.lit("("), r["input"], F.lit(") -> "), r["output"]))
    text = F.concat(F.lit("gRPC service with RPCs: "), F.array_join(call, ", "))
    rows = services.dropDuplicates(["repo_id", "name"])
    return rows.select(number_of_key(F.lit("service"), F.col("repo_id"), F.col("name")).alias("id"), "repo_id", "name", text.alias("description"), F.lit("grpc").alias("service_type"))


def event_rows(messages: DataFrame) -> DataFrame:
    fields = F.array_join(F.transform("fields", lambda f: F.concat(f["type"], F.lit(" "), f["name"])), "; ")
    text = F.concat(F.lit("message "), F.col("name"), F.lit(" { "), fields, F.lit(" }"))
    return messages.select(number_of_key(F.lit("event"), F.col("repo_id"), F.col("path"), F.col("ord"), F.col("name")).alias("id"), "repo_id", "name", text.alias("schema_definition"), F.col("path").alias("source_file"))


def module_rows(modules: DataFrame, types: DataFrame) -> DataFrame:
    """Modules of all three sources: Elixir ones, GraphQL definitions, and macros that define GraphQL types in Elixir."""
    no_fields = F.lit(None).cast("array<struct<name:string,type:string>>")
    own = modules.select("repo_id", "path", "ord", F.lit(0).alias("nth"), "name", "type", F.col("moduledoc").alias("summary"), "table_name", F.when(F.size("schema_fields") > 0, F.col("schema_fields")).alias("schema_fields"))
    graphql = types.select("repo_id", "path", "ord", F.lit(1).alias("nth"), "name", F.concat(F.lit("graphql_"), "kind").alias("type"), F.nullif("body", F.lit("")).alias("summary"), F.lit(None).cast("string").alias("table_name"), no_fields.alias("schema_fields"))
    macros = modules.select("repo_id", "path", "ord", F.col("name").alias("owner"), F.posexplode("absinthe_types").alias("k", "t"))
    absinthe = macros.select(
        "repo_id", "path", "ord", (F.col("k") + 2).alias("nth"), F.col("t.name").alias("name"), F.concat(F.lit("absinthe_"), "t.kind").alias("type"), F.concat(F.lit("Absinthe "), "t.kind", F.lit(" defined in "), "owner").alias("summary"),
        F.lit(None).cast("string").alias("table_name"), no_fields.alias("schema_fields"),
    )
    rows = own.unionByName(graphql).unionByName(absinthe)
    key = number_of_key(F.lit("module"), F.col("repo_id"), F.col("path"), F.col("ord"), F.col("nth"), F.col("type"), F.col("name"))
    return rows.select(key.alias("id"), "repo_id", number_of_key(F.lit("file"), F.col("repo_id"), F.col("path")).alias("file_id"), "name", "type", "summary", "table_name", "schema_fields", "path")


def field_rows(modules: DataFrame, messages: DataFrame, types: DataFrame) -> DataFrame:
    """(id, repo_id, parent_type, parent_name, field_name, field_type, nullable, source_file) of all three sources."""
    shape = lambda df, kind, parent, name, type_, nullable: df.select("repo_id", F.lit(kind).alias("parent_type"), parent.alias("parent_name"), name.alias("field_name"), type_.alias("field_type"), nullable.alias("nullable"), F.col("path").alias("source_file"))
    ecto = modules.filter("table_name is not null").select("repo_id", "path", "name", "required_fields", F.explode("schema_fields").alias("f"))
    proto = messages.select("repo_id", "path", "name", F.explode("fields").alias("f"))
    gql = graphql_fields(types)
    rows = shape(ecto, "ecto_schema", F.col("name"), F.col("f.name"), F.col("f.type"), ~F.array_contains(F.col("required_fields"), F.col("f.name")))
    rows = rows.unionByName(shape(proto, "proto_message", F.col("name"), F.col("f.name"), F.col("f.type"), F.col("f.optional")))
    rows = rows.unionByName(shape(gql, "graphql_type", F.col("parent_name"), F.col("name"), F.col("type"), F.col("nullable")))
    key = number_of_key(F.lit("field"), F.col("repo_id"), F.col("source_file"), F.col("parent_type"), F.col("parent_name"), F.col("field_name"), F.col("field_type"))
    return rows.withColumn("id", key)
