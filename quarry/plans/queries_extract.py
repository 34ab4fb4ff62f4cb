"""Extraction queries: over page and document texts, and over sources that are written from the star schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import extract
from quarry.operators import fixed_values as V
from quarry.plans.registry import query
from quarry.shape import ITEMS, LIMIT, list_response


def _pages(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@\\s]+)', 1)) AS host, split_part(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@\\s]+)', 1)), '.', 1) AS service FROM pages")
def http_host_extract(spark, sf_dir):
    host = extract.url_host(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", host.alias("host"), F.split_part(host, F.lit("."), F.lit(1)).alias("service"))


_EXTERNAL = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in V.EXTERNAL_DOMAINS)


@query(f"""WITH hosts AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@\\s]+)', 1)) AS host FROM (
    SELECT page_id, url FROM pages UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) FROM pages))
SELECT page_id, host FROM hosts WHERE host <> '' AND NOT ({_EXTERNAL})""")
def external_domain_antijoin(spark, sf_dir):
    """The addresses of all pages, and all that they link to, without those of known public services."""
    pages = _pages(spark, sf_dir)
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("url"))
    hosts = pages.select("page_id", "url").unionByName(links).select("page_id", extract.url_host(F.col("url")).alias("host"))
    return hosts.filter(~extract.external_host(F.col("host")))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def html_href_extract(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


def _parts(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def proto_files(spark, sf_dir) -> DataFrame:
    """One source of messages and services per brand, written from its parts."""
    field = F.concat(F.lit("  "), F.when(F.col("p_size") % 3 == 0, "optional ").otherwise(""), F.when(F.col("p_size") % 2 == 0, "string").otherwise("int64"), F.lit(" f"), "p_partkey", F.lit(" = "), "p_size", F.lit(";\n  oneof x"), "p_partkey", F.lit(" { }"))
    body = _parts(spark, sf_dir).groupBy("p_brand", "p_type").agg(F.array_join(F.array_sort(F.collect_list(field)), "\n").alias("body"))
    message = F.concat(F.lit("message M_"), "p_type", F.lit(" {\n"), "body", F.lit("\n}\n"))
    rpc = F.concat(F.lit("  rpc Get_"), "p_type", F.lit("(M_"), "p_type", F.lit(") returns (M_"), "p_type", F.lit(") {}\n"))
    texts = body.groupBy("p_brand").agg(F.concat(F.lit('syntax = "proto3";\n'), F.array_join(F.array_sort(F.collect_list(message)), "\n"), F.lit("\nservice Parts {\n"), F.array_join(F.array_sort(F.collect_list(rpc)), ""), F.lit("}\nmessage Unclosed {\n  string a = 1;\n")).alias("content"))
    return texts.select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("repo_id"), F.concat(F.lit("proto/"), "p_brand", F.lit(".proto")).alias("path"), "content")


@query("SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS repo_id, 'M_' || p_type AS name, count(*)::INT AS fields FROM part GROUP BY ALL")
def proto_messages(spark, sf_dir):
    return extract.proto_messages(proto_files(spark, sf_dir)).select("repo_id", "name", F.size("fields").alias("fields"))


@query("SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS repo_id, 'M_' || p_type AS parent_name, 'f' || p_partkey AS field_name, CASE WHEN p_size % 2 = 0 THEN 'string' ELSE 'int64' END AS field_type, p_size % 3 = 0 AS nullable FROM part")
def proto_fields(spark, sf_dir):
    messages = extract.proto_messages(proto_files(spark, sf_dir))
    rows = messages.select("repo_id", F.col("name").alias("parent_name"), F.explode("fields").alias("f"))
    return rows.select("repo_id", "parent_name", F.col("f.name").alias("field_name"), F.col("f.type").alias("field_type"), F.col("f.optional").alias("nullable"))


@query("SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS repo_id, 'Parts' AS name, 'gRPC service with RPCs: ' || string_agg(DISTINCT 'Get_' || p_type || '(M_' || p_type || ') -> M_' || p_type, ', ' ORDER BY 'Get_' || p_type || '(M_' || p_type || ') -> M_' || p_type) AS description FROM part GROUP BY p_brand")
def proto_services(spark, sf_dir):
    return extract.service_rows(extract.proto_services(proto_files(spark, sf_dir))).select("repo_id", "name", "description")


def graphql_files(spark, sf_dir) -> DataFrame:
    """One schema per brand: a type, an input or an enum per kind of part."""
    kind = F.element_at(F.array(F.lit("type"), F.lit("input"), F.lit("enum")), (F.ascii("p_type") % 3 + 1).cast("int"))
    field = F.concat(F.lit("  f"), "p_partkey", F.when(F.col("p_size") % 2 == 0, "(first: Int)").otherwise(""), F.lit(": "), F.when(F.col("p_size") % 3 == 0, "[String!]!").otherwise("Int"), F.lit(" # c"))
    body = _parts(spark, sf_dir).withColumn("kind", kind).groupBy("p_brand", "p_type", "kind").agg(F.array_join(F.array_sort(F.collect_list(field)), "\n").alias("body"))
    text = F.concat("kind", F.lit(" T_"), "p_type", F.when(F.col("kind") == "type", " implements Node & Part").otherwise(""), F.lit(" {\n"), "body", F.lit("\n}\n"))
    texts = body.groupBy("p_brand").agg(F.concat(F.array_join(F.array_sort(F.collect_list(text)), "\n"), F.lit("\nunion Any = T_A | T_B\nscalar Day\n")).alias("content"))
    return texts.select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("repo_id"), F.concat(F.lit("schema/"), "p_brand", F.lit(".graphql")).alias("path"), "content")


@query("SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS repo_id, (['type', 'input', 'enum'])[(ascii(p_type) % 3 + 1)::INT] AS kind, 'T_' || p_type AS name FROM part UNION ALL SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT, unnest(['union', 'scalar']), unnest(['Any', 'Day']) FROM part")
def graphql_types(spark, sf_dir):
    return extract.graphql_types(graphql_files(spark, sf_dir)).select("repo_id", "kind", "name")


@query("SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS repo_id, 'T_' || p_type AS parent_name, 'f' || p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN '[String!]!' ELSE 'Int' END AS type, p_size % 3 <> 0 AS nullable FROM part WHERE ascii(p_type) % 3 <> 2")
def graphql_fields(spark, sf_dir):
    return extract.graphql_fields(extract.graphql_types(graphql_files(spark, sf_dir))).select("repo_id", "parent_name", "name", "type", "nullable")


def elixir_files(spark, sf_dir) -> DataFrame:
    """One source per customer: a module with a table, fields, calls and topics."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, seg = F.col("c_custkey"), F.initcap(F.lower("c_mktsegment"))
    text = F.concat(
        F.lit("defmodule Shop."), seg, F.lit(".C"), k, F.when(k % 3 == 0, "").when(k % 3 == 1, "Context").otherwise("Query"), F.lit(' do\n  @moduledoc "Customer '), k, F.lit('"\n  use Ecto.Schema\n'),
        F.when(k % 3 == 0, F.concat(F.lit('  schema "customers" do\n    field :name, :string\n    field(:balance, :decimal)\n    belongs_to :nation, Shop.Nation\n  end\n'))).otherwise(""),
        F.lit("  @required ~w(name)a\n  def changeset(c, params) do\n    c |> cast(params, [:name, :balance]) |> validate_required(@required)\n  end\n  def handle_event(%Shop.Event"), k % 10, F.lit("{} = e), do: e\n"),
        F.when(k % 4 == 0, F.concat(F.lit('  @topic "orders-'), k % 7, F.lit('"\n  def send, do: Outbox.emit(:x)\n'))).otherwise(""),
        F.when(k % 4 == 1, F.concat(F.lit('  use Kafkaesque.Consumer, topics_config: %{"orders-'), k % 7, F.lit('" => %{}}\n'))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit("  use RpcClient.Client, service: Acme.N"), F.col("c_nationkey"), F.lit(".Rpc.V1.Service, stub: Acme.N"), F.col("c_nationkey"), F.lit(".Rpc.V1.Service.Stub\n"))).otherwise(""),
        F.when(k % 5 == 1, F.concat(F.lit('  plug Tesla.Middleware.BaseUrl, "http://svc-'), F.col("c_nationkey"), F.lit(':4000"\n'))).otherwise(""),
        F.lit("end\n"),
    )
    return c.select((k % 100).alias("repo_id"), F.concat(F.lit("lib/c"), k, F.lit(".ex")).alias("path"), text.alias("content"))


@query("""SELECT c_custkey % 100 AS repo_id, 'Shop.' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '.C' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Context' ELSE 'Query' END AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'context' ELSE 'query' END AS type, 'Customer ' || c_custkey AS moduledoc, CASE WHEN c_custkey % 3 = 0 THEN 'name:string,balance:decimal' ELSE '' END AS fields,
  'changeset/2,handle_event/1' || CASE WHEN c_custkey % 4 = 0 THEN ',send/0' ELSE '' END AS functions, 'name' AS required, 'balance' AS optional FROM customer""")
def elixir_modules(spark, sf_dir):
    rows = extract.elixir_modules(elixir_files(spark, sf_dir))
    fields = F.array_join(F.transform("schema_fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",")
    return rows.select("repo_id", "name", "type", "moduledoc", fields.alias("fields"), F.array_join("functions", ",").alias("functions"), F.array_join("required_fields", ",").alias("required"), F.array_join("optional_fields", ",").alias("optional"))


@query("SELECT c_custkey % 100 AS repo_id, 'lib/c' || c_custkey || '.ex' AS path, 'Shop.Event' || (c_custkey % 10) AS event_name FROM customer UNION ALL SELECT c_custkey % 100, 'lib/c' || c_custkey || '.ex', 'orders-' || (c_custkey % 7) FROM customer WHERE c_custkey % 4 = 1")
def event_handlers(spark, sf_dir):
    files = elixir_files(spark, sf_dir)
    none = spark.createDataFrame([], f"repo_id long, path string, ord int, {extract.MESSAGE_ROW}")
    return extract.event_relationships(files, none).filter("type = 'consumes_event'").select("repo_id", "path", "event_name")


@query("SELECT c_custkey % 100 AS repo_id, 'lib/c' || c_custkey || '.ex' AS path, 'orders-' || (c_custkey % 7) AS topic, CASE c_custkey % 4 WHEN 0 THEN 'producer' ELSE 'consumer' END AS role FROM customer WHERE c_custkey % 4 IN (0, 1)")
def topic_regex_extract(spark, sf_dir):
    rows = extract.kafka_edges(elixir_files(spark, sf_dir))
    return rows.select("repo_id", "path", F.col("target").alias("topic"), F.element_at("metadata", "role").alias("role"))


@query("SELECT c_custkey % 100 AS repo_id, 'svc-' || c_nationkey AS service, count(*)::BIGINT AS calls FROM customer WHERE c_custkey % 5 = 1 GROUP BY ALL")
def http_clients(spark, sf_dir):
    return extract.http_edges(elixir_files(spark, sf_dir)).groupBy("repo_id", F.col("target").alias("service")).agg(F.count(F.lit(1)).alias("calls"))


@query("SELECT DISTINCT c_custkey % 100 AS repo_id, 'Acme.N' || c_nationkey || '.Rpc.V1.Service' AS target FROM customer WHERE c_custkey % 5 = 0")
def grpc_clients(spark, sf_dir):
    files = elixir_files(spark, sf_dir)
    return extract.grpc_edges(files, extract.elixir_modules(files), ("Acme",)).select("repo_id", "target")


@query("SELECT DISTINCT 'Acme.N' || c_nationkey || '.Rpc.V1.Service' AS name, 'N' || c_nationkey AS domain FROM customer UNION ALL SELECT 'Rpc.N' || n_nationkey || '.V1.RPCService', 'N' || n_nationkey FROM nation UNION ALL SELECT 'Acme.N' || n_nationkey || '.Client', 'N' || n_nationkey FROM nation")
def rpc_domains(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("n"))
    name = lambda a, b: n.select(F.concat(F.lit(a), "n", F.lit(b)).alias("name"))
    rows = name("Acme.N", ".Rpc.V1.Service").union(name("Rpc.N", ".V1.RPCService")).union(name("Acme.N", ".Client"))
    return rows.select("name", extract.rpc_domain(F.col("name"), ("Acme",)).alias("domain"))


@query(f"""WITH shown AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS total, len(to_json(struct_pack(doc_id := doc_id, source := source, lang := lang))) AS n FROM documents),
sizes AS (SELECT m, (SELECT sum(n) + m - 1 FROM shown WHERE k <= m) + len('{{"summary":"' || m || ' documents","data":[],"total":' || (SELECT max(total) FROM shown) || ',"truncated":' || CASE WHEN m < (SELECT max(total) FROM shown) THEN 'true' ELSE 'false' END || '}}') AS chars FROM (SELECT unnest([10, 5, 2, 1]) AS m))
SELECT (SELECT max(m) FROM sizes WHERE chars <= {LIMIT})::BIGINT AS shown, (SELECT max(total) FROM shown)::BIGINT AS total""")
def response_budget(spark, sf_dir):
    """How many of all documents' cards a tool's answer shows, and of how many: the answer itself says both."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = [r.asDict() for r in docs.select("doc_id", "source", "lang").orderBy("doc_id").limit(ITEMS).collect()]
    answer = json.loads(list_response(first, lambda shown: f"{len(shown)} documents", total=docs.count()))
    return spark.createDataFrame([(len(answer["data"]), answer["total"])], "shown long, total long")
