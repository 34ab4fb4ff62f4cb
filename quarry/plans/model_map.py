"""A star schema seen as the relational model: suppliers are services, order lines their calls.

It lets every query run over tables of any size, and every row of the tables it
maps is in the model: a line is a direct call where its discount is at most 0.05
and a call of a name otherwise, an event is produced or consumed, directly or by
way of a topic. A service calls ``FAN`` others, spread so that some steps reach
all of them, and an event's or topic's name tells the group of its user, so paths
are several steps long and the number of links grows with the rows. Ids are
numbers of natural keys, so building it needs no sort and no counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schema import TABLES, Model

TOPIC_BASE, EVENT_BASE = 2_000_000_000_000_000_000, 3_000_000_000_000_000_000
#: Services that a service calls; users of an event's or topic's name; kinds of names among which the numbers of an event choose.
FAN, GROUP, NAMES = 3, 8, 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """All columns of a model table, missing ones null."""
    from pyspark.sql.types import StructType

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[name]).fields])


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    return _shaped(s.select((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("/repos/"), "s_name").alias("path"), F.concat(F.lit("service of nation "), "s_nationkey").alias("description")), "repos")


def _line_key() -> F.Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents, F.date_format("l_shipdate", "yyyy-MM-dd"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") + 1


def _key(props: str = "props") -> F.Column:
    return F.coalesce(F.get_json_object(props, "$.k").cast("long"), F.lit(0))


def _subject(ev: DataFrame) -> DataFrame:
    """Events with ``k``, the number of the event or topic that they are about: their own number, and the user's group."""
    return ev.withColumn("k", _key() % NAMES + NAMES * F.floor(F.col("user_id") / GROUP).cast("long"))


def edges(spark: SparkSession, sf_dir: str, services: int) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    is_direct = F.coalesce(F.round("l_discount", 2) <= 0.05, F.lit(False))
    kind = F.when(F.col("l_returnflag") == "A", "calls_grpc").when(F.col("l_returnflag") == "N", "calls_http").otherwise("routes_to")
    conf = F.when(F.col("l_linestatus") == "F", "high").otherwise("low")
    base = [_line_key().alias("id"), F.lit("repo").alias("source_type"), (F.col("l_suppkey") + 1).alias("source_id"), kind.alias("relationship_type"), F.concat(F.lit("lib/order_"), "l_orderkey", F.lit(".ex")).alias("source_file")]
    callee = (F.col("l_suppkey") * FAN + F.col("l_partkey") % FAN) % services + 1
    direct = line.filter(is_direct).select(*base, F.lit("repo").alias("target_type"), callee.alias("target_id"), F.concat(F.lit('{"confidence":"'), conf, F.lit('"}')).alias("metadata"))
    name = F.concat(F.lit("part-"), "l_partkey")
    open_ = line.filter(~is_direct).select(*base, F.lit("service_name").alias("target_type"), F.lit(0).cast("long").alias("target_id"), F.concat(F.lit('{"confidence":"'), conf, F.lit('","unresolved":"true","targetName":"'), name, F.lit('"}')).alias("metadata"))
    ev = _subject(_table(spark, sf_dir, "events")).withColumn("source_id", F.col("user_id") % services + 1)
    role = F.when(F.col("event_type") == "purchase", "producer").otherwise("consumer")
    topic = F.concat(F.lit("topic-"), "k")
    topics = ev.filter("event_type in ('purchase', 'signup')").select(
        (F.lit(TOPIC_BASE) + F.col("event_id")).alias("id"), F.lit("repo").alias("source_type"), "source_id", F.when(F.col("event_type") == "purchase", "produces_kafka").otherwise("consumes_kafka").alias("relationship_type"), F.lit("lib/topics.ex").alias("source_file"),
        F.lit("service_name").alias("target_type"), F.lit(0).cast("long").alias("target_id"), F.concat(F.lit('{"topic":"'), topic, F.lit('","role":"'), role, F.lit('","confidence":"high"}')).alias("metadata"),
    )
    # clicks and errors are produced, views are consumed
    events_ = ev.filter("event_type in ('click', 'view', 'error')").select(
        (F.lit(EVENT_BASE) + F.col("event_id")).alias("id"), F.lit("repo").alias("source_type"), "source_id", F.when(F.col("event_type") == "view", "consumes_event").otherwise("produces_event").alias("relationship_type"), F.lit("lib/events.ex").alias("source_file"),
        F.lit("event").alias("target_type"), (F.col("k") + 1).alias("target_id"), F.lit(None).cast("string").alias("metadata"),
    )
    rows = direct.unionByName(open_).unionByName(topics).unionByName(events_)
    return _shaped(rows.withColumn("repo_id", F.col("source_id")), "edges")


def star_model(spark: SparkSession, sf_dir: str) -> Model:
    part, customer = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "customer")
    services = _table(spark, sf_dir, "supplier").count()
    file_id = F.col("p_partkey") + 1
    owner = F.col("p_partkey") % services + 1
    kinds = F.element_at(F.array(F.lit("ecto_schema"), F.lit("proto_message"), F.lit("graphql_type")), (F.col("p_partkey") % 3 + 1).cast("int"))
    sub = F.element_at(F.array(*[F.lit(t) for t in ("schema", "context", "query", "graphql_type")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    k = _subject(_table(spark, sf_dir, "events")).select("k").distinct()
    talk = _table(spark, sf_dir, "conversations")
    return Model(
        repos=repos(spark, sf_dir),
        files=_shaped(part.select((F.col("p_partkey") + 1).alias("id"), owner.alias("repo_id"), F.concat(F.lit("lib/"), F.lower("p_type"), F.lit("/"), "p_partkey", F.lit(".ex")).alias("path"), F.lit("elixir").alias("language")), "files"),
        modules=_shaped(
            part.select(
                (F.col("p_partkey") + 1).alias("id"), owner.alias("repo_id"), file_id.alias("file_id"), F.concat("p_brand", F.lit("."), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("name"), sub.alias("type"), F.concat("p_name", F.lit(" of "), "p_type").alias("summary"),
                F.when(sub == "schema", F.concat(F.lower("p_type"), F.lit("_parts"))).alias("table_name"),
            ),
            "modules",
        ),
        services=_shaped(customer.select((F.col("c_custkey") + 1).alias("id"), (F.col("c_custkey") % services + 1).alias("repo_id"), F.col("c_name").alias("name"), F.concat(F.lit("gRPC service for "), F.lower("c_mktsegment")).alias("description"), F.lit("grpc").alias("service_type")), "services"),
        events=_shaped(k.select((F.col("k") + 1).alias("id"), (F.col("k") % services + 1).alias("repo_id"), F.concat(F.lit("Event"), "k", F.lit("Created")).alias("name"), F.concat(F.lit("message Event"), "k", F.lit(" { string id }")).alias("schema_definition"), F.concat(F.lit("proto/event_"), "k", F.lit(".proto")).alias("source_file")), "events"),
        edges=edges(spark, sf_dir, services),
        learned_facts=_shaped(talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.col("role").alias("repo"), F.timestamp_add("DAY", F.col("conv_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at")), "learned_facts"),
        fields=_shaped(part.select((F.col("p_partkey") + 1).alias("id"), owner.alias("repo_id"), kinds.alias("parent_type"), F.col("p_brand").alias("parent_name"), F.split("p_name", " ")[0].alias("field_name"), F.lower("p_type").alias("field_type"), (F.col("p_size") % 2 == 1).alias("nullable"), F.concat(F.lit("lib/fields_"), F.col("p_partkey") % 7, F.lit(".ex")).alias("source_file")), "fields"),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indexed files: their source is the name, their text the description, their language the sub-type."""
    d = _table(spark, sf_dir, "documents")
    return d.select(F.lit("file").alias("entity_type"), F.col("lang").alias("sub_type"), F.col("doc_id").alias("entity_id"), F.col("source").alias("name"), F.col("text").alias("description"))


#: The same model in DuckDB's SQL, as common table expressions to put before a query.
STAR_SQL = f"""
star AS (SELECT count(*) AS services FROM supplier),
repos AS (SELECT s_suppkey + 1 AS id, s_name AS name, '/repos/' || s_name AS path, 'service of nation ' || s_nationkey AS description FROM supplier),
lines AS (
  SELECT *, ('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT, strftime(l_shipdate, '%Y-%m-%d'))), 1, 15))::BIGINT + 1 AS id,
    CASE l_returnflag WHEN 'A' THEN 'calls_grpc' WHEN 'N' THEN 'calls_http' ELSE 'routes_to' END AS kind, CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'low' END AS conf
  FROM lineitem),
evs AS MATERIALIZED (SELECT *, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) % {NAMES} + {NAMES} * (user_id // {GROUP}) AS k, user_id % services + 1 AS source_id FROM main.events, star),
edges AS MATERIALIZED (
  SELECT id, 'repo' AS source_type, l_suppkey + 1 AS source_id, 'repo' AS target_type, (l_suppkey * {FAN} + l_partkey % {FAN}) % services + 1 AS target_id, kind AS relationship_type, '{{"confidence":"' || conf || '"}}' AS metadata FROM lines, star WHERE coalesce(round(l_discount, 2) <= 0.05, false)
  UNION ALL SELECT id, 'repo', l_suppkey + 1, 'service_name', 0, kind, '{{"confidence":"' || conf || '","unresolved":"true","targetName":"part-' || l_partkey || '"}}' FROM lines WHERE NOT coalesce(round(l_discount, 2) <= 0.05, false)
  UNION ALL SELECT 2000000000000000000 + event_id, 'repo', source_id, 'service_name', 0, CASE event_type WHEN 'purchase' THEN 'produces_kafka' ELSE 'consumes_kafka' END,
    '{{"topic":"topic-' || k || '","role":"' || CASE event_type WHEN 'purchase' THEN 'producer' ELSE 'consumer' END || '","confidence":"high"}}' FROM evs WHERE event_type IN ('purchase', 'signup')
  UNION ALL SELECT 3000000000000000000 + event_id, 'repo', source_id, 'event', k + 1, CASE event_type WHEN 'view' THEN 'consumes_event' ELSE 'produces_event' END, NULL FROM evs WHERE event_type IN ('click', 'view', 'error')),
model_events AS (SELECT k + 1 AS id, k % services + 1 AS repo_id, 'Event' || k || 'Created' AS name, 'message Event' || k || ' {{ string id }}' AS schema_definition, 'proto/event_' || k || '.proto' AS source_file
  FROM (SELECT DISTINCT k FROM evs), star),
files AS (SELECT p_partkey + 1 AS id, p_partkey % services + 1 AS repo_id, 'lib/' || lower(p_type) || '/' || p_partkey || '.ex' AS path FROM part, star),
modules AS (
  SELECT p_partkey + 1 AS id, p_partkey % services + 1 AS repo_id, p_partkey + 1 AS file_id,
    p_brand || '.' || array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], '') AS name,
    (['schema', 'context', 'query', 'graphql_type'])[(p_partkey % 4 + 1)::INT] AS type, p_name || ' of ' || p_type AS summary, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) || '_parts' END AS table_name FROM part, star),
services AS (SELECT c_custkey + 1 AS id, c_custkey % star.services + 1 AS repo_id, c_name AS name, 'gRPC service for ' || lower(c_mktsegment) AS description, 'grpc' AS service_type FROM customer, star),
facts AS (SELECT conv_id * 1000 + turn AS id, text AS content, role AS repo, TIMESTAMP '2024-01-01' + to_days(conv_id::INT) AS created_at FROM conversations),
fields AS (
  SELECT p_partkey + 1 AS id, p_partkey % services + 1 AS repo_id, (['ecto_schema', 'proto_message', 'graphql_type'])[(p_partkey % 3 + 1)::INT] AS parent_type, p_brand AS parent_name,
    split_part(p_name, ' ', 1) AS field_name, lower(p_type) AS field_type, p_size % 2 = 1 AS nullable, 'lib/fields_' || (p_partkey % 7) || '.ex' AS source_file FROM part, star)"""
