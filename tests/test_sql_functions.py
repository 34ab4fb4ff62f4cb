import pytest

from quarry.operators import graph, impact
from quarry.plans import sql_functions
from quarry.schema import model_of
from tests.test_stored_graph import random_model


@pytest.mark.parametrize("depth", [1, 3])
def test_functions_equal_the_operators(spark, depth):
    import random

    m = model_of(spark, **random_model(spark, random.Random(9)))
    edges = graph.graph_edges(m).cache()
    sql_functions.register(spark, m, edges)
    for name, i in (("s3", 3), ("s5", 5), ("nobody", 99)):
        seeds = m.repos.filter(f"id = {i}").selectExpr("id AS seed")
        want = sorted((r["node"], r["name"], r["depth"], r["tier"]) for r in impact.impact_nodes(m, edges, seeds, None, depth).collect())
        assert sorted(tuple(r) for r in spark.sql(f"SELECT * FROM impact_of('{name}', {depth})").collect()) == want
        down = sorted((r["node"], r["depth"]) for r in graph.downstream(seeds, edges, depth).collect())
        assert sorted(tuple(r) for r in spark.sql(f"SELECT node, depth FROM reached_from('{name}', {depth})").collect()) == down
    grpc = sorted(r["node"] for r in graph.upstream(m.repos.selectExpr("id AS seed").filter("seed = 3"), edges, depth, "grpc").collect())
    assert sorted(r.node for r in spark.sql(f"SELECT node FROM impact_of('s3', {depth}, 'grpc')").collect()) == grpc
    assert spark.sql("SELECT * FROM neighbours_of('s3')").columns == ["side", "mechanism", "name"]
    joins = lambda n: spark.sql(f"SELECT * FROM impact_of('s3', {n})")._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(10) >= joins(depth) + 10 - depth  # levels beyond the asked one are folded away
