import os
import random

import pytest

from pyspark.sql import functions as F

from quarry.operators import dependencies, graph, searches, trace
from quarry.schema import model_of
from tests.seed import edge, repo, topic, unresolved


@pytest.fixture(scope="module")
def tangle(spark):
    """Services with parallel calls and topics among them, one that nobody calls, one without edges, and ids of no service."""
    rnd = random.Random(4)
    calls = [edge(k, rnd.randint(1, 14), rnd.choice([*range(1, 14), 40, 41]), rnd.choice(["calls_grpc", "calls_http", "routes_to"])) for k in range(1, 31)]
    topics = [topic(100 + k, rnd.randint(1, 14), rnd.choice(["produces_kafka", "consumes_kafka"]), f"t{k % 3}") for k in range(8)]
    m = model_of(spark, repos=[repo(k, f"S{k}") for k in [*range(1, 15), 30]], edges=[*calls, *topics, edge(200, 41, 42, "calls_grpc")])
    return m, graph.graph_edges(m).cache()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("at_once", [1, 50, searches.AT_ONCE])
def test_hops_of_all_services_are_made_without_a_shuffle(spark, tangle, monkeypatch, at_once):
    monkeypatch.setattr(searches, "AT_ONCE", at_once)
    m, edges = tangle
    got = trace.trace_all_hops(m, edges)
    assert "Exchange" not in plan(got)
    assert rows(got) == rows(trace.trace_hops(m, edges, trace.all_pairs(m)))
    assert max(r.step for r in got.collect()) > 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_the_registered_hops_are_made_without_a_shuffle(spark):
    from quarry.plans import registry

    assert "Exchange" not in plan(registry.QUERIES["shortest_path_hops"](spark, "/root/testdata/sf0.001"))


def test_hops_of_more_walks_than_are_sent_and_of_repeated_ids(spark, tangle, monkeypatch):
    m, edges = tangle
    twice = model_of(spark, repos=[repo(1, "A"), repo(2, "B"), repo(2, "C")], edges=[edge(1, 1, 2, "calls_grpc")])
    own = graph.graph_edges(twice)
    assert rows(trace.trace_all_hops(twice, own)) == rows(trace.trace_hops(twice, own, trace.all_pairs(twice)))
    want = rows(trace.trace_all_hops(m, edges))
    monkeypatch.setattr(searches, "WALKS", 3)
    assert rows(trace.trace_all_hops(m, edges)) == want


def test_no_walks_at_all(spark):
    m = model_of(spark, repos=[repo(1, "A"), repo(2, "B")])
    assert trace.trace_all_hops(m, graph.graph_edges(m)).collect() == []


@pytest.mark.parametrize("text", [1, searches.TEXT])
def test_summaries_of_all_services_are_made_without_a_shuffle(spark, tangle, monkeypatch, text):
    monkeypatch.setattr(searches, "TEXT", text)
    m, edges = tangle
    got = trace.trace_all_summaries(m, edges)
    assert "Exchange" not in plan(got)
    pairs = trace.all_pairs(m)
    want = trace.trace_summaries(m, trace.trace_hops(m, edges, pairs), pairs)
    assert rows(got) == rows(want)
    assert {"S30"} == {r["to"] for r in got.filter("from_id = 1 and hop_count is null").collect()}
    monkeypatch.setattr(searches, "WALKS", 3)
    assert rows(trace.trace_all_summaries(m, edges)) == rows(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_the_registered_summaries_are_made_without_a_shuffle(spark):
    from quarry.plans import registry

    assert "Exchange" not in plan(registry.QUERIES["trace_summary"](spark, "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def callers(spark):
    """Services that call each other and names that several of them call, some in two ways and more than once."""
    rnd = random.Random(7)
    calls = [edge(k, rnd.randint(1, 12), rnd.randint(1, 13), rnd.choice(["calls_grpc", "calls_http"]), rnd.choice(["high", None])) for k in range(1, 26)]
    names = [unresolved(100 + k, rnd.choice([*range(1, 13), 77]), rnd.choice(["calls_grpc", "calls_http"]), f"N{k % 7}") for k in range(40)]
    topics = [topic(200 + k, rnd.randint(1, 12), rnd.choice(["produces_kafka", "consumes_kafka"]), f"t{k % 3}") for k in range(8)]
    return model_of(spark, repos=[repo(k, f"S{k}") for k in range(1, 13)], edges=[*calls, *names, *topics])


def listed(spark, m, **how):
    found = dependencies.dependencies(m, spark.createDataFrame([(k,) for k in range(1, 13)], "seed long"), **how)
    return rows(found.select("seed", "name", "type", "mechanism", "depth", F.array_join("path", " > ").alias("path")))


@pytest.mark.parametrize("limits", [{}, {"AT_ONCE": 1, "KEPT": 5, "ROWS": 3, "TEXT": 1}, {"WALKS": 3}])
def test_paths_of_all_dependencies_equal_those_of_the_search_by_joins(spark, callers, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(searches, name, value)
    got = dependencies.all_paths(callers, depth=3)
    assert limits.get("WALKS") or "Exchange" not in plan(got)
    assert {r.type for r in got.collect()} == {"repo", "unresolved"} and {r.depth for r in got.collect()} == {1, 2, 3}
    assert rows(got) == listed(spark, callers, depth=3)


@pytest.mark.parametrize("how", [{"depth": 1}, {"depth": "all", "mechanism": "http"}, {"direction": "downstream", "depth": 2}])
def test_paths_of_all_dependencies_of_other_questions(spark, callers, how):
    assert rows(dependencies.all_paths(callers, **how)) == listed(spark, callers, **how)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_the_registered_paths_of_dependencies_are_made_without_a_shuffle(spark):
    from quarry.plans import registry

    assert "Exchange" not in plan(registry.QUERIES["deps_paths"](spark, "/root/testdata/sf0.001"))
