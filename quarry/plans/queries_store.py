"""Queries over stored state: facts, hygiene, change sets, resolution and incremental writes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.text import like_anywhere
from quarry.operators import resolve
from quarry.plans import store
from quarry.plans.model_map import STAR_SQL, star_model
from quarry.plans.registry import query
from quarry.session import shared_dir
from quarry.sources import git

_S = f"WITH {STAR_SQL}\n"
_NOW = "2024-06-01 00:00:00"


@query(_S + "SELECT id, content, repo, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, row_number() OVER (ORDER BY created_at DESC, id DESC)::BIGINT AS place FROM facts WHERE repo = 'user'")
def facts_list(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = store.facts_listed(star_model(spark, sf_dir).learned_facts, "user")
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.col("created_at").desc(), F.col("id").desc())).cast("long")
    return rows.select("id", "content", "repo", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), place.alias("place"))


@query(_S + f"SELECT id, repo FROM facts WHERE created_at < TIMESTAMP '{_NOW}' - INTERVAL 90 DAY")
def facts_stale(spark, sf_dir):
    return store.stale_facts(star_model(spark, sf_dir).learned_facts, 90, F.lit(_NOW).cast("timestamp")).select("id", "repo")


@query(_S + "SELECT * FROM (VALUES ('repos', (SELECT count(*) FROM repos)), ('files', (SELECT count(*) FROM files)), ('modules', (SELECT count(*) FROM modules)), ('services', (SELECT count(*) FROM services)), ('events', (SELECT count(*) FROM model_events)), ('edges', (SELECT count(*) FROM edges)), ('learned_facts', (SELECT count(*) FROM facts))) t(name, count)")
def status_counts(spark, sf_dir):
    return store.status_counts(star_model(spark, sf_dir))


@query(_S + "SELECT s_suppkey + 1 AS id, s_name AS name FROM supplier WHERE s_acctbal < 3000")
def missing_repo_antijoin(spark, sf_dir):
    present = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal >= 3000").select(F.concat(F.lit("/repos/"), "s_name").alias("path"))
    return store.missing_repositories(star_model(spark, sf_dir).repos, present).select("id", "name")


@query(_S + "SELECT s_name AS name, CASE WHEN s_acctbal < 3000 THEN 'missing' WHEN s_acctbal < 6000 THEN 'stale' ELSE 'current' END AS state FROM supplier ORDER BY name LIMIT 20")
def staleness_sample(spark, sf_dir):
    repos = star_model(spark, sf_dir).repos.withColumn("last_indexed_commit", F.md5("name"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal >= 3000")
    snapshot = s.select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 6000, F.lit("other")).otherwise(F.md5("s_name")).alias("head"))
    return store.staleness(repos, snapshot)


@query(_S + "SELECT s_suppkey + 1 AS id, s_name AS name FROM supplier WHERE s_acctbal < 5000")
def skip_unchanged(spark, sf_dir):
    repos = star_model(spark, sf_dir).repos.withColumn("last_indexed_commit", F.md5("name"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    snapshot = s.select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 5000, F.md5("s_name")).otherwise(F.lit("new")).alias("tip"))
    return store.unchanged(repos, snapshot).select("id", "name")


@query("""SELECT o_custkey AS repo_id, o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'deleted' WHEN o_orderstatus = 'O' THEN 'added' ELSE 'modified' END AS status FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 1000""")
def change_set_diff(spark, sf_dir):
    """Two snapshots by content: one without new orders, one without finished ones."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("path"), "o_orderstatus", "o_totalprice")
    before = o.filter("o_orderstatus <> 'O'").select("repo_id", "path", F.lit("a").alias("hash"))
    after = o.filter("o_orderstatus <> 'F'").select("repo_id", "path", F.when(F.col("o_totalprice") > 1000, "b").otherwise("a").alias("hash"))
    return git.snapshot_changes(before, after)


@query("""SELECT o_custkey AS repo_id, 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'added' WHEN o_orderkey % 4 = 1 THEN 'modified' ELSE 'deleted' END AS status FROM orders
UNION ALL SELECT o_custkey, 'g' || o_orderkey, 'added' FROM orders WHERE o_orderkey % 4 = 3""")
def change_lines(spark, sf_dir):
    """Lines of a diff by names: added, modified, deleted and renamed files."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    letter = F.element_at(F.array(*[F.lit(x) for x in ("A", "M", "D", "R100")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    line = F.concat(letter, F.lit("\tf"), "o_orderkey", F.when(F.col("o_orderkey") % 4 == 3, F.concat(F.lit("\tg"), "o_orderkey")).otherwise(""))
    return git.parsed_changes(o.select(F.col("o_custkey").alias("repo_id"), line.alias("line")))


@query("SELECT o_custkey AS repo_id, CASE WHEN min(o_orderkey) % 7 <> 0 AND count(*) FILTER (o_orderstatus = 'P') BETWEEN 1 AND 200 AND count(*) FILTER (o_orderstatus = 'P') <= count(*) * 0.5 THEN 'surgical' ELSE 'full' END AS mode FROM orders GROUP BY 1")
def mode_choice(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("repo_id")).agg(F.count(F.lit(1)).alias("files"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("changed"), F.min("o_orderkey").alias("k"))
    return store.modes(o.select("repo_id", (F.col("k") % 7 == 0).alias("force"), F.lit("a").alias("last"), F.lit("b").alias("tip"), F.lit(True).alias("reachable"), "changed", "files"))


@query(_S + "SELECT target, min(r.id) AS id FROM (SELECT DISTINCT lpad((p_partkey % 200)::VARCHAR, 3, '0') AS target FROM part) t JOIN repos r ON r.name ILIKE '%' || target || '%' GROUP BY 1")
def resolve_like_target(spark, sf_dir):
    model = star_model(spark, sf_dir)
    targets = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lpad((F.col("p_partkey") % 200).cast("string"), 3, "0").alias("name")).distinct()
    return resolve.like_matches(targets, model.repos).select(F.col("name").alias("target"), "id")


_TARGETS = """
targets AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'Supplier#' || lpad((p_partkey % 150)::VARCHAR, 9, '0') WHEN 1 THEN '#' || lpad((p_partkey % 300)::VARCHAR, 9, '0') WHEN 2 THEN 'Rpc.Customer#' || lpad((p_partkey % 3000)::VARCHAR, 9, '0') ELSE 'none-' || p_partkey END AS target FROM part),
short AS (SELECT target, CASE WHEN contains(target, '.') THEN string_split(target, '.')[-1] END AS s FROM targets),
resolved AS (SELECT target, coalesce((SELECT min(id) FROM repos r WHERE r.name = target), (SELECT min(id) FROM repos r WHERE r.name ILIKE '%' || target || '%'),
  (SELECT arg_min(repo_id, id) FROM services v WHERE v.name = s), (SELECT arg_min(repo_id, id) FROM services v WHERE v.name ILIKE '%' || s || '%')) AS target_repo FROM short)"""


def _targets(spark, sf_dir):
    k = F.col("p_partkey")
    pad = lambda n: F.lpad((k % n).cast("string"), 9, "0")
    text = F.when(k % 4 == 0, F.concat(F.lit("Supplier#"), pad(150))).when(k % 4 == 1, F.concat(F.lit("#"), pad(300))).when(k % 4 == 2, F.concat(F.lit("Rpc.Customer#"), pad(3000))).otherwise(F.concat(F.lit("none-"), k))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k, text.alias("target"))


@query(_S.rstrip() + "," + _TARGETS + "\nSELECT target, target_repo FROM resolved")
def resolve_priority(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return resolve.topology_targets(_targets(spark, sf_dir), model.repos, model.services)


@query(_S.rstrip() + "," + _TARGETS + """
SELECT repo_id, relationship_type, count(*)::BIGINT AS edges, count(*) FILTER (target_repo IS NULL)::BIGINT AS unresolved FROM (
  SELECT DISTINCT p_partkey % 10 AS repo_id, CASE WHEN p_partkey % 2 = 0 THEN 'calls_grpc' ELSE 'calls_http' END AS relationship_type, coalesce('r' || r.target_repo, r.target) AS key, r.target_repo
  FROM part JOIN resolved r ON r.target = CASE p_partkey % 4 WHEN 0 THEN 'Supplier#' || lpad((p_partkey % 150)::VARCHAR, 9, '0') WHEN 1 THEN '#' || lpad((p_partkey % 300)::VARCHAR, 9, '0') WHEN 2 THEN 'Rpc.Customer#' || lpad((p_partkey % 3000)::VARCHAR, 9, '0') ELSE 'none-' || p_partkey END)
GROUP BY ALL""")
def dedup_topology(spark, sf_dir):
    model = star_model(spark, sf_dir)
    k = F.col("p_partkey")
    found = _targets(spark, sf_dir).select(
        (k % 10).alias("repo_id"), F.when(k % 2 == 0, "grpc").otherwise("http").alias("mechanism"), F.concat(F.lit("lib/"), k).alias("path"), "target", F.create_map(F.lit("k"), k.cast("string")).alias("metadata"), F.lit("high").alias("confidence"), F.lit(0).alias("kind"), F.lit(0).alias("nth")
    )
    rows = resolve.topology_links(found, model.repos, model.services)
    return rows.groupBy(F.col("source_id").alias("repo_id"), "relationship_type").agg(F.count(F.lit(1)).alias("edges"), F.sum((F.col("target_id") == 0).cast("long")).alias("unresolved"))


@query(_S + "SELECT e.id AS ecto, p.id AS proto FROM fields e JOIN fields p ON e.repo_id = p.repo_id AND e.field_name = p.field_name AND e.parent_type = 'ecto_schema' AND p.parent_type = 'proto_message'")
def field_maps_to(spark, sf_dir):
    return resolve.field_links(star_model(spark, sf_dir).fields).select(F.col("source_id").alias("ecto"), F.col("target_id").alias("proto"))


_CATALOG = """
catalog AS (SELECT 'event:event' || (id - 1) || '-created' AS catalog_id FROM model_events UNION ALL SELECT 'event:' || (id - 1) || '-created' FROM model_events UNION ALL SELECT 'event:nothing')"""


def _catalog(model):
    k = (F.col("id") - 1).cast("string")
    e = model.events
    rows = e.select(F.concat(F.lit("event:event"), k, F.lit("-created")).alias("catalog_id")).unionByName(e.select(F.concat(F.lit("event:"), k, F.lit("-created")).alias("catalog_id")))
    return rows.unionByName(model.spark.createDataFrame([("event:nothing",)], "catalog_id string"))


@query(_S.rstrip() + "," + _CATALOG + """
SELECT catalog_id, id AS event_id, 1 AS strategy FROM catalog JOIN model_events ON name = 'Event' || regexp_extract(catalog_id, '^event:event(\\d+)-created$', 1) || 'Created' AND catalog_id LIKE 'event:event%'
UNION ALL SELECT catalog_id, id, 2 FROM catalog JOIN model_events ON name LIKE '%' || regexp_extract(catalog_id, '^event:(\\d+)-created$', 1) || 'Created' WHERE regexp_matches(catalog_id, '^event:\\d')""")
def catalog_kebab_match(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return resolve.catalog_matches(_catalog(model), model.events)


@query("SELECT 'p' || p_partkey AS catalog_id, arg_max(r_name, r_regionkey) AS domain FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def catalog_domain_chain(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    domains = t("nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("services")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), "services")
    services = t("part").groupBy(F.concat(F.lit("NATION_"), F.col("p_partkey") % 25).alias("id")).agg(F.collect_list(F.concat(F.lit("p"), "p_partkey")).alias("events"))
    return resolve.event_domains(domains, services)


@query(_S + "SELECT f.id, m.id AS module_id, e.id AS event_id FROM fields f LEFT JOIN (SELECT repo_id, name, min(id) AS id FROM modules GROUP BY ALL) m ON m.repo_id = f.repo_id AND m.name = f.parent_name AND f.parent_type <> 'proto_message' LEFT JOIN (SELECT repo_id, name, min(id) AS id FROM model_events GROUP BY ALL) e ON e.repo_id = f.repo_id AND e.name = f.parent_name AND f.parent_type = 'proto_message'")
def field_parents(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return resolve.with_parents(model.fields, model.modules, model.events).select("id", "module_id", "event_id")


@query(_S + "SELECT repo_id, count(*)::BIGINT AS fields, count(*) FILTER (source_file <> 'lib/fields_3.ex')::BIGINT AS kept FROM fields GROUP BY 1")
def surgical_overwrite(spark, sf_dir):
    """Everything is stored, then one file is changed everywhere: the rows read back are as many, and only its own are new."""
    model = star_model(spark, sf_dir)
    kb = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    ids = [r["id"] for r in model.repos.select("id").collect()]
    kb.persist({"repos": model.repos, "fields": model.fields}, ids)
    changed = model.repos.select(F.col("id").alias("repo_id"), F.lit("lib/fields_3.ex").alias("path"))
    kb.persist_changed({"fields": model.fields.withColumn("field_type", F.lit("changed"))}, changed, ids)
    return kb.table("fields").groupBy("repo_id").agg(F.count(F.lit(1)).alias("fields"), F.sum((F.col("field_type") != "changed").cast("long")).alias("kept"))


@query(_S + "SELECT id, name FROM repos WHERE name ILIKE '%000000_1%'")
def like_wildcards(spark, sf_dir):
    """% and _ of a looked-up name act as wildcards."""
    repos = star_model(spark, sf_dir).repos
    return repos.filter(like_anywhere(F.col("name"), F.lit("000000_1"))).select("id", "name")
