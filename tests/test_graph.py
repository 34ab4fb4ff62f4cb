import random

import pytest

from quarry.operators import dependencies, explain, field_impact, graph, impact, trace
from quarry.schema import model_of
from tests.seed import edge, repo, topic, unresolved


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed long")


def repos(n):
    return [repo(i, chr(64 + i)) for i in range(1, n + 1)]


def test_direct_edges_keep_parallel_ones_and_loops(spark):
    m = model_of(spark, repos=repos(2), edges=[edge(1, 1, 2, "calls_grpc", "high"), edge(2, 1, 2, "calls_http"), edge(3, 1, 1, "calls_grpc"), edge(4, 1, 9, "maps_to")])
    got = {(r.src_id, r.dst_id, r.mechanism, r.confidence) for r in graph.graph_edges(m).collect()}
    assert got == {(1, 2, "grpc", "high"), (1, 2, "http", None), (1, 1, "grpc", None), (1, 9, "maps_to", None)}


def test_event_and_topic_hops_are_distinct_and_leave_oneself_out(spark):
    events = [{"id": 7, "repo_id": 1, "name": "Made"}, {"id": 8, "repo_id": 1, "name": "Made"}]
    e = lambda i, r, k, ev=7: edge(i, r, ev, k, target_type="event")
    m = model_of(
        spark, repos=repos(3), events=events,
        edges=[e(1, 1, "produces_event"), e(2, 2, "consumes_event"), e(3, 2, "consumes_event"), e(4, 1, "consumes_event"), e(5, 1, "produces_event", 8), e(6, 2, "consumes_event", 8),
               topic(10, 1, "produces_kafka", "t"), topic(11, 3, "consumes_kafka", "t"), topic(12, 3, "consumes_kafka", "t"), topic(13, 1, "consumes_kafka", "t"), edge(14, 2, 0, "produces_kafka", target_type="service_name")],
    )
    got = [(r.src_id, r.dst_id, r.mechanism, r.via, r.confidence) for r in graph.graph_edges(m).orderBy("cls", "e1").collect()]
    assert got == [(1, 2, "event", "Made", None), (1, 3, "kafka", "t", None)]


def test_unresolved_edges(spark):
    m = model_of(spark, repos=repos(1), edges=[unresolved(1, 1, "calls_http", "Who"), topic(2, 1, "produces_kafka", "t"), edge(3, 1, 0, "calls_grpc", target_type="service_name")])
    assert {(r.dst_id, r.mechanism, r.via) for r in graph.graph_edges(m).collect()} == {(0, "http", "Who"), (0, "grpc", None)}


@pytest.fixture(scope="module")
def chain(spark):
    """A to B to C to D to E, C back to A, X to C by HTTP; F alone."""
    m = model_of(spark, repos=[*repos(6), repo(24, "X")], edges=[edge(1, 1, 2, "calls_grpc", "high"), edge(2, 2, 3, "calls_http"), edge(3, 3, 4, "routes_to", "medium"), edge(4, 4, 5, "calls_grpc"), edge(5, 3, 1, "calls_grpc"), edge(6, 24, 3, "calls_http")])
    return m, graph.graph_edges(m).cache()


def test_traversal_depths_and_cycles(spark, chain):
    _, edges = chain
    down = {(r.node, r.depth) for r in graph.downstream(seeds(spark, 1), edges).collect()}
    assert down == {(2, 1), (3, 2), (4, 3), (5, 4)}
    up = {(r.seed, r.node, r.depth) for r in graph.upstream(seeds(spark, 4, 6), edges, 2).collect()}
    assert up == {(4, 3, 1), (4, 2, 2), (4, 24, 2)}


def test_mechanism_filter_stops_traversal(spark, chain):
    _, edges = chain
    assert {r.node for r in graph.upstream(seeds(spark, 5), edges, 3, "grpc").collect()} == {4}


def test_impact_collects_edges_into_the_subgraph(spark):
    m = model_of(spark, repos=repos(3), edges=[edge(1, 1, 3, "calls_grpc", "high"), edge(2, 2, 1, "calls_http", "low"), edge(3, 2, 3, "calls_grpc"), edge(4, 2, 2, "routes_to")])
    rows = {r.name: r for r in impact.impact_entries(m, graph.graph_edges(m), seeds(spark, 3)).collect()}
    assert rows["A"].mechanisms == ["grpc"] and rows["A"].tier == "direct"
    assert rows["B"].mechanisms == ["http", "grpc", "gateway"] and rows["B"].confidence == ["low", None, None]


def test_impact_sends_no_list_of_edges_to_seeds(spark, chain):
    m, edges = chain
    entries = impact.impact_entries(m, edges, seeds(spark, 4, 5))
    after = entries._jdf.queryExecution().executedPlan().toString().split("array_contains(", 1)
    assert len(after) == 2 and "Exchange" not in after[0]
    rows = {(r.seed, r.name): (r.mechanisms, r.confidence) for r in entries.collect()}
    # C calls D and A; A is three steps from D, but four from E
    assert rows[(4, "C")] == (["gateway", "grpc"], ["medium", None]) and rows[(5, "C")] == (["gateway"], ["medium"])


def test_inner_edges_are_counted_by_pair(spark, chain):
    _, edges = chain
    twice = edges.unionByName(edges.filter("src_id = 3"))
    found = graph.upstream(seeds(spark, 5), edges, 3)
    assert {(r.node, r.edges) for r in impact.inner_edges(twice, seeds(spark, 5), found).collect()} == {(4, 1), (3, 2), (2, 1), (24, 1)}


def test_impact_stats_and_histogram(spark, chain):
    m, edges = chain
    entries = impact.impact_entries(m, edges, seeds(spark, 5))
    s = impact.impact_stats(entries).first()
    assert (s.direct, s.indirect, s.transitive, s.score) == (1, 1, 2, 7)
    assert s.summary == "E: 1 direct, 1 indirect, 2 transitive (score: 7)"
    assert {(r.mechanism, r.entries) for r in impact.mechanism_histogram(entries, seeds(spark, 5), edges).collect()} == {("grpc", 1), ("gateway", 1), ("http", 2)}


def test_trace(spark, chain):
    m, edges = chain
    pairs = spark.createDataFrame([(1, 4), (1, 1), (1, 6), (24, 2)], "from_id long, to_id long")
    hops = trace.trace_hops(m, edges, pairs)
    got = {(r["from_id"], r["to_id"]): (r["hop_count"], r["path_summary"]) for r in trace.trace_summaries(m, hops, pairs).collect()}
    # A reaches D over the edge C to A walked backwards: two hops rather than three
    assert got[(1, 4)] == (2, "C -[grpc]-> A -[gateway]-> D")
    assert got[(1, 1)] == (0, "A (same service)")
    assert got[(1, 6)] == (None, None)
    assert got[(24, 2)][0] == 2


def test_summaries_along_searches_equal_those_of_hops(spark, chain):
    m, edges = chain
    ids = [1, 2, 3, 4, 5, 6, 24]
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if (a, b) != (2, 4)], "from_id long, to_id long")
    want = trace.trace_summaries(m, trace.trace_hops(m, edges, pairs), pairs)
    got = trace.searched_summaries(m, edges, pairs).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_levels_of_a_search_hold_numbers_only(spark, chain):
    _, edges = chain
    levels = graph.search_levels(spark.createDataFrame([(5,)], "from_id long"), graph.numbered_walks(edges))
    assert [[tuple(r) for r in level.orderBy("rank").collect()] for level in levels] == [[(5, 4, 5, 1)], [(5, 3, 4, 1)], [(5, 1, 3, 1), (5, 2, 3, 2), (5, 24, 3, 3)]]


def test_trace_has_no_limit(spark):
    n = 70
    m = model_of(spark, repos=[repo(i, f"r{i}") for i in range(1, n + 1)], edges=[edge(i, i, i + 1, "calls_grpc") for i in range(1, n)])
    pairs = spark.createDataFrame([(1, n)], "from_id long, to_id long")
    trees = graph.search_trees(pairs.select("from_id"), graph.graph_edges(m))
    assert {(r.node, r.step) for r in trees.collect()} == {(i, i - 1) for i in range(1, n + 1)}


def test_trace_shows_via_of_events_only(spark):
    m = model_of(spark, repos=repos(3), events=[{"id": 5, "repo_id": 1, "name": "Made"}], edges=[edge(1, 1, 5, "produces_event", target_type="event"), edge(2, 2, 5, "consumes_event", target_type="event"), edge(3, 2, 3, "calls_grpc")])
    pairs = spark.createDataFrame([(1, 3)], "from_id long, to_id long")
    hops = trace.trace_hops(m, graph.graph_edges(m), pairs)
    assert trace.trace_summaries(m, hops, pairs).first().path_summary == "A -[event: Made]-> B -[grpc]-> C"


@pytest.fixture(scope="module")
def shop(spark):
    """booking publishes BookingCreated to payments, payments PaymentProcessed to notifications."""
    ev = [{"id": 1, "repo_id": 1, "name": "BookingCreated"}, {"id": 2, "repo_id": 2, "name": "PaymentProcessed"}]
    e = lambda i, r, ev_, k: edge(i, r, ev_, k, target_type="event")
    names = ["booking", "payments", "notifications"]
    return model_of(
        spark, repos=[repo(i + 1, n) for i, n in enumerate(names)], events=ev,
        edges=[e(1, 1, 1, "produces_event"), e(2, 2, 1, "consumes_event"), e(3, 2, 2, "produces_event"), e(4, 3, 2, "consumes_event"), unresolved(5, 3, "calls_grpc", "Mailer", "high"), topic(6, 1, "produces_kafka", "t"), topic(7, 3, "consumes_kafka", "t")],
    )


def test_dependencies_by_depth(spark, shop):
    one = [(r.name, r.type, r.mechanism, r.depth) for r in dependencies.dependencies(shop, seeds(spark, 3)).orderBy("rank").collect()]
    assert one == [("payments", "repo", "event (PaymentProcessed)", 1), ("booking", "repo", "Kafka producer [high]", 1), ("Mailer", "unresolved", "gRPC -> [unresolved: Mailer]", 1)]
    down = [(r.name, r.depth, r.path) for r in dependencies.dependencies(shop, seeds(spark, 1), "downstream", "all").orderBy("depth", "rank").collect()]
    assert down == [("payments", 1, ["booking", "event(BookingCreated)", "payments"]), ("notifications", 1, ["booking", "Kafka(t)", "notifications"])]


def test_dependency_filters(spark, shop):
    assert [r.name for r in dependencies.dependencies(shop, seeds(spark, 3), mechanism="grpc").collect()] == ["Mailer"]
    assert [r.name for r in dependencies.dependencies(shop, seeds(spark, 3), depth=3, repo="booking").collect()] == ["booking"]
    assert dependencies.dependencies(shop, seeds(spark, 99)).count() == 0
    assert dependencies.dependencies(shop, seeds(spark, 3), mechanism="nothing").count() == 0
    with pytest.raises(ValueError, match="direction"):
        dependencies.links(shop, "sideways")


def test_explain(spark, shop):
    groups = explain.connection_groups(explain.connections(shop, graph.graph_edges(shop)))
    got = {r.name: r.summary for r in explain.connection_summaries(shop, groups).collect()}
    assert got["booking"] == "Talks to 2 services (1 via event, 1 via kafka). Called by 0 services."
    assert got["notifications"] == "Talks to 0 services. Called by 2 services."
    assert explain.event_lists(shop).filter("repo_id = 2").first().produces == ["PaymentProcessed"]


def test_connections_are_capped_with_a_marker(spark):
    m = model_of(spark, repos=[repo(i, f"r{i:02}") for i in range(1, 31)], edges=[edge(i, 1, i, "calls_grpc") for i in range(2, 27)] + [edge(100 + i, 1, i, "calls_http") for i in range(27, 30)])
    rows = {r.mechanism: r.names for r in explain.capped(explain.connection_groups(explain.connections(m, graph.graph_edges(m))).filter("side = 'talks_to'")).collect()}
    assert len(rows["grpc"]) == 18 and rows["grpc"][-1] == "...and 8 more" and len(rows["http"]) == 3


def test_module_groups_leave_untyped_modules_out(spark):
    m = model_of(spark, modules=[{"id": i, "repo_id": 1, "name": f"m{i}", "type": "module" if i < 8 else None} for i in range(1, 10)])
    r = explain.module_groups(m).first()
    assert (r.n, r.top) == (7, ["m1", "m2", "m3", "m4", "m5"])


def test_field_impact(spark):
    f = lambda i, r, kind, parent, null=False: {"id": i, "repo_id": r, "parent_type": kind, "parent_name": parent, "field_name": "x", "field_type": "string", "nullable": null}
    m = model_of(
        spark, repos=repos(4),
        fields=[f(1, 1, "ecto_schema", "S"), f(2, 1, "proto_message", "P"), f(3, 2, "ecto_schema", "T", True), f(4, 4, "graphql_type", "G")],
        edges=[topic(1, 1, "produces_kafka", "t"), topic(2, 2, "consumes_kafka", "t"), topic(3, 3, "consumes_kafka", "t")],
    )
    names = spark.createDataFrame([("x",), ("none",)], "field string")
    g = graph.graph_edges(m)
    found = field_impact.occurrences(m, names)
    cons = {r.repo: (r.confidence, r.via_topic, r.via_event, r.parent_name, r.nullable) for r in field_impact.consumers(m, g, found).collect()}
    assert cons == {"B": ("confirmed", "t", "P", "T", True), "C": ("inferred", "t", "P", None, None)}
    assert {(r.repo, r.parent_name) for r in field_impact.origins(m, g, found).collect()} == {("A", "S"), ("D", "G")}
    assert field_impact.boundary_topics(g, field_impact.boundaries(found)).first().topics == ["t"]
    got = {r.field: r.summary for r in field_impact.field_impact_summaries(m, g, names).collect()}
    assert got == {"x": "x: 2 origins, 1 boundaries, 2 consumers across 4 repos", "none": "none: no occurrences found"}


def test_traversals_of_an_empty_graph(spark):
    m = model_of(spark)
    g = graph.graph_edges(m)
    assert graph.downstream(seeds(spark, 1), g).count() == 0
    assert impact.impact_entries(m, g, seeds(spark, 1)).count() == 0
    assert graph.shortest_paths(spark.createDataFrame([(1, 2)], "from_id long, to_id long"), g).count() == 0


def test_many_seeds_are_searched_in_bits(spark, monkeypatch):
    """Many seeds, more than a block has bits, ids without order and cycles: what a search of each seed finds."""
    rnd = random.Random(5)
    ids = [rnd.randrange(1, 1 << 60) for _ in range(60)]
    pairs = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(90)} | {(ids[0], ids[0])}
    want = set()
    for seed in ids[:50]:
        level, seen, depth = {seed}, {seed}, 0
        while level:
            depth += 1
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(seed, n, depth) for n in level}
    rows = [(a, b, "grpc", None, None, "calls_grpc", 0, k, 0) for k, (a, b) in enumerate(sorted(pairs))]
    edges = spark.createDataFrame(rows, "src_id long, dst_id long, mechanism string, confidence string, via string, relationship_type string, cls int, e1 long, e2 long")
    monkeypatch.setattr(graph, "FEW", 3)
    monkeypatch.setattr(graph, "BLOCK", 16)
    monkeypatch.setattr(graph, "reached_by", None)
    got = [tuple(r) for r in graph.downstream(seeds(spark, *ids[:50], ids[0]), edges).collect()]
    assert len(got) == len(want) and set(got) == want and max(d for _, _, d in want) > 3


def test_depths_of_dependencies_search_pairs_without_paths(spark, shop):
    want = {(r.seed, r.name, r.depth) for r in dependencies.dependencies(shop, seeds(spark, 1, 2, 3), depth=3).filter("type = 'repo'").collect()}
    names = {r.id: r.name for r in shop.repos.collect()}
    found = dependencies.depths(shop, seeds(spark, 1, 2, 3, 99), depth=3)
    assert found.columns == ["seed", "node", "depth"]
    assert {(r.seed, names[r.node], r.depth) for r in found.collect()} == want and want


def test_dependencies_keep_no_checkpoints(spark, chain):
    m, _ = chain
    found = dependencies.dependencies(m, seeds(spark, 1), depth=3)
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.name, r.depth) for r in found.orderBy("depth", "rank").collect()] == [("B", 1), ("C", 2), ("D", 3)]
