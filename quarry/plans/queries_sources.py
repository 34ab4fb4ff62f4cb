"""Extraction, resolution and write queries over sources that are written from suppliers and nations.

One repository per supplier holds an Elixir file, every third a gateway file too;
the constructs that the file has follow from the supplier's number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import extract, resolve
from quarry.plans import store
from quarry.plans.model_map import STAR_SQL, star_model
from quarry.plans.registry import query
from quarry.session import shared_dir


def code_files(spark, sf_dir) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    some = lambda rule, *parts: F.when(rule, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")
    text = F.concat(
        F.lit("defmodule Code.S"), k, F.lit(" do\n"),
        some(k % 2 == 0, "  object :thing_", k, " do\n  end\n  input_object :input_", n, " do\n  end\n  query do\n  end\n"),
        some(k % 3 != 2, "  schema \"t", k, "\" do\n    belongs_to :next, Code.S", k + 1, "\n    has_many :others, Code.S", k + 2, "\n  end\n"),
        some(k % 2 == 0, "  use RpcClient.MockableRpcClient, behaviour: Acme.N", n, ".Rpc.V1.Mock\n"),
        some(k % 3 == 0, "  use RpcClient.Client, service: Acme.N", n, ".Rpc.V1.Service, stub: Acme.N", n, ".Rpc.V1.Service.Stub\n"),
        some(k % 5 == 0, "  def call(c), do: Acme.N", n, ".Rpc.V1.Direct.Stub.get(c)\n"),
        some(k % 4 == 1, "  use Kafkaesque.OneOffConsumer, topics: [\"list-", k % 7, "\"]\n"),
        some(k % 4 == 3, "  use Kafkaesque.Consumer, schema: Shop.Event", k % 10, "\n  schema: Payload\n"),
        some(k % 4 == 0, "  def handle_decoded_message(%Shop.Event", k % 10, "{} = e), do: e\n"),
        F.lit("end\n"),
    )
    own = s.select(k.alias("repo_id"), F.concat(F.lit("lib/s"), k, F.lit(".ex")).alias("path"), text.alias("content"))
    gateway = F.concat(F.lit('describe({ name: "Svc'), k, F.lit('", url: "x",\n  schemaSource: { repo: "repo-'), n, F.lit('" } })\n'))
    return own.unionByName(s.filter(k % 3 == 0).select(k.alias("repo_id"), F.concat(F.lit("compose/services/s"), k, F.lit(".ts")).alias("path"), gateway.alias("content")))


@query("""SELECT s_suppkey AS repo_id, kind, CASE kind WHEN 'object' THEN 'thing_' || s_suppkey WHEN 'input_object' THEN 'input_' || s_nationkey ELSE 'query' END AS name,
  'absinthe_' || kind AS type, 'Absinthe ' || kind || ' defined in Code.S' || s_suppkey AS summary FROM supplier, (SELECT unnest(['object', 'input_object', 'query']) AS kind) WHERE s_suppkey % 2 = 0""")
def absinthe_types(spark, sf_dir):
    """Types that macros of Elixir modules define, as rows of the model's modules."""
    files = code_files(spark, sf_dir)
    rows = extract.module_rows(extract.elixir_modules(files), extract.graphql_types(files)).filter("type LIKE 'absinthe%'")
    return rows.select("repo_id", F.replace("type", F.lit("absinthe_"), F.lit("")).alias("kind"), "name", "type", "summary")


@query("""SELECT s_suppkey AS repo_id, 'Acme.N' || s_nationkey || '.Rpc.V1.' || CASE WHEN s_suppkey % 2 = 0 THEN 'Mock' WHEN s_suppkey % 3 = 0 THEN 'Service' ELSE 'Direct.Stub' END AS target,
  CASE WHEN s_suppkey % 2 = 0 THEN 'mockable' WHEN s_suppkey % 3 = 0 THEN 'client' ELSE 'direct' END AS pattern FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0""")
def grpc_priorities(spark, sf_dir):
    """Of a domain's clients a mockable one counts before a plain one, and that before a stub."""
    files = code_files(spark, sf_dir)
    rows = extract.grpc_edges(files, extract.elixir_modules(files), ("Acme",))
    return rows.select("repo_id", "target", F.element_at("metadata", "pattern").alias("pattern"))


@query("SELECT s_suppkey AS repo_id, 'Svc' || s_suppkey AS service, 'repo-' || s_nationkey AS target, 'medium' AS confidence FROM supplier WHERE s_suppkey % 3 = 0")
def gateway_services(spark, sf_dir):
    rows = extract.gateway_edges(code_files(spark, sf_dir))
    return rows.select("repo_id", F.element_at("metadata", "serviceName").alias("service"), "target", "confidence")


@query("""SELECT mechanism, count(*)::BIGINT AS edges FROM (
  SELECT 'grpc' AS mechanism FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0
  UNION ALL SELECT 'gateway' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'kafka' FROM supplier WHERE s_suppkey % 4 = 1) GROUP BY 1""")
def topology_union(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return extract.topology_edges(files, extract.elixir_modules(files), ("Acme",)).groupBy("mechanism").agg(F.count(F.lit(1)).alias("edges"))


def _known_events(spark) -> DataFrame:
    """Events 0 to 4 are defined, by repository 0."""
    return spark.range(5).select((F.col("id") + 1).alias("id"), F.lit(0).cast("long").alias("repo_id"), F.concat(F.lit("Shop.Event"), "id").alias("name"))


@query("""SELECT s_suppkey AS repo_id, 'Shop.Event' || (s_suppkey % 10) AS event, s_suppkey % 10 < 5 AS defined FROM supplier WHERE s_suppkey % 4 IN (0, 3)""")
def event_links_by_name(spark, sf_dir):
    """Consumers' edges to events by name; an event that nobody defines is made from its consumers."""
    files = code_files(spark, sf_dir)
    none = spark.createDataFrame([], f"repo_id long, path string, ord int, {extract.MESSAGE_ROW}")
    known = _known_events(spark)
    edges, made = resolve.event_links(extract.event_relationships(files, none), known)
    names = known.select("id", "name", F.lit(True).alias("defined")).unionByName(made.select("id", "name", F.lit(False).alias("defined")))
    return edges.join(names, edges["target_id"] == names["id"]).select(edges["repo_id"], F.col("name").alias("event"), "defined")


@query("""SELECT a.s_suppkey AS repo_id, 'Code.S' || a.s_suppkey AS source, k.kind, 'Code.S' || b.s_suppkey AS target
  FROM supplier a, (SELECT unnest(['belongs_to', 'has_many']) AS kind, unnest([1, 2]) AS step) k, supplier b WHERE a.s_suppkey % 3 <> 2 AND b.s_suppkey = a.s_suppkey + k.step""")
def association_edges(spark, sf_dir):
    """Schema associations as edges of modules, to modules of other repositories too; the last ones lead nowhere and give none."""
    files = code_files(spark, sf_dir)
    modules = extract.elixir_modules(files)
    stored = extract.module_rows(modules, extract.graphql_types(files)).filter("type NOT LIKE 'absinthe%'").select("id", "repo_id", "name")
    edges = resolve.association_links(modules, stored)
    source, target = stored.select(F.col("id").alias("source_id"), F.col("name").alias("source")), stored.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    return edges.join(source, "source_id").join(target, "target_id").select("repo_id", "source", F.col("relationship_type").alias("kind"), "target")


@query(f"WITH {STAR_SQL}\nSELECT 'fields' AS name, count(*)::BIGINT AS rows, sum(id)::HUGEINT::VARCHAR AS ids FROM fields UNION ALL SELECT 'modules', count(*), sum(id)::HUGEINT::VARCHAR FROM modules UNION ALL SELECT 'repos', count(*), sum(id)::HUGEINT::VARCHAR FROM repos")
def persist_full(spark, sf_dir):
    """A full write of all repositories, twice: what is read back is what was written once."""
    model = star_model(spark, sf_dir)
    kb = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    ids = [r["id"] for r in model.repos.select("id").collect()]
    tables = {"repos": model.repos, "modules": model.modules, "fields": model.fields}
    kb.persist(tables, ids)
    kb.persist(tables, ids)
    out = None
    for name in tables:
        part = kb.table(name).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("id").cast("decimal(38,0)")).cast("string").alias("ids")).select(F.lit(name).alias("name"), "rows", "ids")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {STAR_SQL}\nSELECT 'fields' AS name, count(*)::BIGINT AS rows FROM fields WHERE repo_id % 2 = 0 UNION ALL SELECT 'repos', count(*) FROM repos WHERE id % 2 = 0")
def clear_repositories(spark, sf_dir):
    """Every other repository is cleared from its tables: the rows of all others stay."""
    model = star_model(spark, sf_dir)
    kb = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    ids = [r["id"] for r in model.repos.select("id").collect()]
    kb.persist({"repos": model.repos, "fields": model.fields}, ids)
    for name in ("repos", "fields"):
        kb.clear(name, [i for i in ids if i % 2])
    count = lambda name: kb.table(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
    return count("fields").unionByName(count("repos"))
