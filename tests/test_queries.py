"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from quarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of every family; the driver compares them all.
SOME = (
    "graph_union impact_tiers impact_summary impact_mechanism_hist bfs_downstream bfs_upstream_mech shortest_path_len shortest_path_hops trace_summary deps_paths deps_upstream deps_mech_filter explain_truncated explain_summary field_consumers field_impact_summary tokenize_names fts_postings fts_or fts_prefix_or fts_relaxed_prefix "
    "search_text_hydrated entity_shared_fields entity_relationship_filter facts_list fts_raw absinthe_types grpc_priorities event_links_by_name association_edges persist_full clear_repositories mode_choice resolve_priority dedup_topology catalog_kebab_match surgical_overwrite proto_fields graphql_fields elixir_modules grpc_clients topic_regex_extract "
    "impact_of_one impact_in_sql trace_of_pair deps_of_one fts_phrase fts_bm25_topk fts_after_change fts_counts_after_change graph_after_change"
).split()

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[k]) for k in at) for row in result.fetchall()), key=repr)


def brute_reach(steps, seed):
    """Least depths from a seed, without it, by plain breadth-first search."""
    depth, level = {seed: 0}, [seed]
    while level:
        level = [y for x in level for y in steps.get(x, ()) if y not in depth and not depth.update({y: depth[x] + 1})]
    return {(seed, node, d) for node, d in depth.items() if d}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_unlimited_downstream_equals_brute_force(spark):
    sf, steps = "/root/testdata/sf0.01", {}
    for r in registry.QUERIES["graph_union"](spark, sf).filter("dst_id <> 0").select("src_id", "dst_id").distinct().collect():
        steps.setdefault(r.src_id, []).append(r.dst_id)
    got = {tuple(r) for r in registry.QUERIES["bfs_downstream"](spark, sf).select("seed", "node", "depth").collect()}
    seeds = [r.s_suppkey + 1 for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()]
    assert got == {row for s in seeds for row in brute_reach(steps, s)}
    assert max(d for _, _, d in got) > 2


@needs_data
def test_the_model_holds_all_rows(spark, duck):
    one = lambda sql: duck.execute(sql).fetchall()
    ((n,),) = one("SELECT count(*) FROM supplier")
    counts = {r["name"]: r["count"] for r in registry.QUERIES["status_counts"](spark, SF).collect()}
    (want,) = one("SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events), (SELECT count(*) FROM part)")
    assert (counts["edges"], counts["files"]) == want
    got = {r[0]: r[1] for r in registry.QUERIES["graph_union"](spark, SF).groupBy("cls").count().collect()}
    hops = lambda a, b: len({(p, c, k) for p, k in side(a) for c, k2 in side(b) if k == k2 and p != c})
    side = lambda kinds: {(user % n + 1, (k % 100, user // 8)) for user, kind, k in rows if kind in kinds}
    rows = one("SELECT user_id, event_type, json_extract_string(props, '$.k')::BIGINT FROM events")
    (calls,) = one("SELECT count(*) FILTER (round(l_discount, 2) <= 0.05), count(*) FILTER (round(l_discount, 2) > 0.05) FROM lineitem")
    assert got == {0: calls[0], 1: hops(("click", "error"), ("view",)), 2: hops(("purchase",), ("signup",)), 3: calls[1]}


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 90
    assert set(registry.QUERIES) <= set(entry_module.queries())


@needs_data
def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns[:3] == ["seed", "service", "node"] and rows.count() > 0


def test_without_the_training_data_operators(tmp_path):
    """The rest imports and registers its queries where those folders are not there."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "quarry"), tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""})
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 90
