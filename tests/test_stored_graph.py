"""The stored graph: changes equal a rebuild, questions read their buckets; searches from both ends."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dependencies, graph
from quarry.plans.stored_graph import TABLES, GraphStore
from quarry.schema import model_of
from tests.seed import edge, repo, topic, unresolved


def random_model(spark, rnd, n=14, gone=()):
    repos = [repo(i, f"s{i}") for i in range(1, n + 1) if i not in gone]
    ids, edges, k = [r["id"] for r in repos], [], 100
    events = [{"id": e, "repo_id": 1 + e % n, "name": f"E{e % 7}", "source_file": "p"} for e in range(1, 10) if rnd.random() < 0.8]
    for src in ids:
        for _ in range(rnd.randint(0, 4)):
            k += 1
            kind = rnd.choice(["calls_grpc", "calls_http", "event", "topic", "open"])
            if kind == "event":
                edges.append(edge(k, src, rnd.randint(1, 9), rnd.choice(["produces_event", "consumes_event"]), target_type="event"))
            elif kind == "topic":
                edges.append(topic(k, src, rnd.choice(["produces_kafka", "consumes_kafka"]), f"t{rnd.randint(1, 4)}", rnd.choice(["high", "low"])))
            elif kind == "open":
                edges.append(unresolved(k, src, "calls_grpc", f"u{rnd.randint(1, 3)}"))
            else:
                edges.append(edge(k, src, rnd.choice(ids), kind, "high"))
    return {"repos": repos, "events": events, "edges": edges}


def content(store):
    return {kind: sorted(str(tuple(r)) for r in store.read(kind).collect()) for kind in TABLES}


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_a_rebuild(spark, tmp_path, seed):
    rnd = random.Random(seed)
    old = random_model(spark, rnd)
    changed = rnd.sample(range(1, 15), 3)
    fresh = random_model(spark, rnd, gone=changed[:1])  # one of them goes
    owner = {"repos": "id", "events": "repo_id", "edges": "repo_id"}
    new = {t: [r for r in old[t] if r[owner[t]] not in changed] + [dict(r, id=r["id"] + 1000) if t == "edges" else r for r in fresh[t] if r[owner[t]] in changed] for t in old}
    new["edges"] = [e for e in new["edges"] if not (e["target_type"] == "repo" and e["target_id"] in changed[:1])]
    before, after = model_of(spark, **old), model_of(spark, **new)
    # edges of others that led to the repository that went belong to the change
    ids = sorted({*changed, *(e["repo_id"] for e in old["edges"] if e["target_type"] == "repo" and e["target_id"] in changed[:1])})
    stored = GraphStore.of(spark, str(tmp_path / "g"), None).written(before)
    later = stored.updated(before, after, ids)
    assert content(later) == content(GraphStore.of(spark, str(tmp_path / "h"), None).written(after))
    assert content(stored) == content(GraphStore.of(spark, str(tmp_path / "h"), None).written(before))
    kept = [b for b in stored.state["tables"]["out"] if stored.state["tables"]["out"][b] == later.state["tables"]["out"].get(b)]
    assert kept or len(ids) > 6


def test_questions_equal_those_of_the_whole_graph(spark, tmp_path):
    m = model_of(spark, **random_model(spark, random.Random(5)))
    stored = GraphStore.of(spark, str(tmp_path / "g"), None).written(m)
    seeds, edges = spark.createDataFrame([(3,), (5,)], "seed long"), graph.graph_edges(m)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(stored.edges()) == rows(edges)
    for mechanism in (None, "grpc", "event"):
        assert rows(stored.upstream(seeds, 3, mechanism)) == rows(graph.upstream(seeds, edges, 3, mechanism))
    assert rows(stored.downstream(seeds)) == rows(graph.downstream(seeds, edges))
    for direction in ("upstream", "downstream"):
        for mechanism in (None, "http", "kafka", "event"):
            near = lambda f: stored.near(direction, f, "node")  # noqa: B023, E731
            ask = lambda **how: sorted(map(str, dependencies.dependencies(m, seeds, direction, 3, mechanism, **how).collect()))  # noqa: B023, E731
            assert ask(near=near) == ask()


def test_a_level_reads_its_buckets(spark, tmp_path, monkeypatch):
    edges = [edge(k, k, k + 1, "calls_grpc", "high") for k in range(1, 40)]
    m = model_of(spark, repos=[repo(i, f"s{i}") for i in range(1, 41)], edges=edges)
    stored, read = GraphStore.of(spark, str(tmp_path / "g"), None).written(m), []
    monkeypatch.setattr(GraphStore, "_paths", lambda self, kind, buckets, old=GraphStore._paths: read.append((kind, buckets)) or old(self, kind, buckets))
    assert stored.upstream(spark.createDataFrame([(10,)], "seed long"), 3).count() == 3
    assert read == [("in", [10]), ("in", [9]), ("in", [8])]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "from_id long, to_id long")


@pytest.mark.parametrize("seed", range(2))
def test_paths_from_both_ends_are_those_from_one(spark, seed):
    rnd = random.Random(seed)
    n = 26
    rows = [(rnd.randint(1, n), rnd.randint(0, n), rnd.choice(["grpc", "event"]), k) for k in range(34)]
    edges = spark.createDataFrame([(a, b, m, None, f"v{k}", "r", k % 3, k, 0) for a, b, m, k in rows], "src_id long, dst_id long, mechanism string, confidence string, via string, relationship_type string, cls int, e1 long, e2 long").cache()
    asked = pairs(spark, [(rnd.randint(1, n), rnd.randint(1, n)) for _ in range(25)] + [(2, 2), (1, 999)])
    walks = graph.walks_of(edges, edges).cache()
    got = sorted(map(str, graph.two_ended_paths(asked, lambda frontier: walks).collect()))
    assert got == sorted(map(str, graph.shortest_paths(asked, edges).collect())) and got


def test_searches_end_where_they_meet(spark):
    chain = spark.createDataFrame([(k, k + 1, "grpc", None, None, "r", 0, k, 0) for k in range(1, 60)], "src_id long, dst_id long, mechanism string, confidence string, via string, relationship_type string, cls int, e1 long, e2 long").cache()
    walks = graph.walks_of(chain, chain).cache()
    seen = graph.meeting_levels(pairs(spark, [(30, 34)]), lambda frontier: walks)
    assert seen.groupBy("side").agg(F.max("level").alias("m")).agg(F.sum("m")).first()[0] == 4
    assert seen.agg(F.min("node"), F.max("node")).first() == (28, 36)
    assert graph.two_ended_paths(pairs(spark, [(30, 34)]), lambda frontier: walks).count() == 4
    assert graph.two_ended_paths(pairs(spark, [(5, 5)]), lambda frontier: walks).count() == 0


def test_a_graph_has_the_tables_that_were_asked_for(spark, tmp_path):
    """Tables that no question has asked for are neither written nor brought up to date, and never read as empty."""
    before = model_of(spark, **random_model(spark, random.Random(3)))
    after = before.with_tables(edges=before.edges.filter("repo_id <> 3"))
    empty = GraphStore.of(spark, str(tmp_path / "g"), None)
    whole = GraphStore.of(spark, str(tmp_path / "h"), None).written(before)
    some = empty.completed(before, ("out",))
    later = some.updated(before, after, [3])
    assert set(some.state["tables"]) == set(later.state["tables"]) == {"out"} and [f.name for f in (tmp_path / "g").iterdir() if f.name in TABLES] == ["out"]
    rows = lambda store, kind: sorted(str(tuple(r)) for r in store.read(kind).collect())
    assert rows(later, "out") == rows(whole.updated(before, after, [3]), "out") != rows(some, "out")
    with pytest.raises(ValueError, match="without upstream"):
        later.read("upstream")
    full = some.completed(before, tuple(TABLES))
    assert content(full) == content(whole) and full.state["tables"]["out"] == some.state["tables"]["out"]
    assert content(full.updated(before, after, [3])) == content(whole.updated(before, after, [3]))
