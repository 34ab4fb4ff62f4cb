"""Graph questions in SQL: table functions over the stored graph.

    register(spark, model, edges)
    spark.sql("SELECT * FROM impact_of('payments-service', 3)")

Each function is plain SQL that Spark expands into the query: a level of the
search is one join with the distinct steps and one aggregation to the least depth,
``LEVELS`` of them, of which those beyond the asked depth are folded away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.schema import Model

LEVELS = 10
REPOSITORIES, EDGES = "quarry_repositories", "quarry_edges"


def _walk(here: str, there: str, name: str, depth: str, kind: str) -> str:
    """(node, depth) of what is reached from the service of a name, itself at 0.

    A level refers to the one before it once, so the text grows with the levels and not with their square.
    """
    steps = f"(SELECT DISTINCT {here} AS here, {there} AS there FROM {EDGES} WHERE dst_id <> 0 AND ({kind} IS NULL OR mechanism = {kind}))"
    rows = f"(SELECT id AS node, 0 AS depth FROM {REPOSITORIES} WHERE name = {name})"
    for level in range(1, LEVELS + 1):
        met = f"SELECT inline(IF(there IS NULL, array(struct(node, depth)), array(struct(node, depth), struct(there AS node, {level} AS depth)))) FROM {rows} w{level} LEFT JOIN {steps} s{level} ON s{level}.here = w{level}.node AND w{level}.depth = {level - 1} AND {depth} >= {level}"
        rows = f"(SELECT node, min(depth) AS depth FROM ({met}) GROUP BY node)"
    return rows


def statements() -> list[str]:
    """The definitions of the functions: impact_of, reached_from and neighbours_of."""
    tier = "CASE w.depth WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect' ELSE 'transitive' END"
    of = lambda function, here, there, extra: f"""CREATE OR REPLACE TEMPORARY FUNCTION {function}(service STRING, max_depth INT DEFAULT 3, kind STRING DEFAULT NULL)
RETURNS TABLE (node BIGINT, name STRING, depth INT, tier STRING)
RETURN SELECT w.node, coalesce(r.name, concat('unknown-', w.node)) AS name, w.depth, {extra} AS tier
FROM {_walk(here, there, f'{function}.service', f'{function}.max_depth', f'{function}.kind')} w LEFT JOIN {REPOSITORIES} r ON r.id = w.node WHERE w.depth > 0"""  # noqa: E731
    return [
        of("impact_of", "dst_id", "src_id", tier),
        of("reached_from", "src_id", "dst_id", tier),
        f"""CREATE OR REPLACE TEMPORARY FUNCTION neighbours_of(service STRING)
RETURNS TABLE (side STRING, mechanism STRING, name STRING)
RETURN SELECT DISTINCT x.side, x.mechanism, o.name FROM (
  SELECT 'talks_to' AS side, mechanism, src_id AS own, dst_id AS other FROM {EDGES} UNION ALL SELECT 'called_by', mechanism, dst_id, src_id FROM {EDGES}) x
JOIN {REPOSITORIES} s ON s.id = x.own AND s.name = neighbours_of.service JOIN {REPOSITORIES} o ON o.id = x.other AND o.name <> s.name""",
    ]


def register(spark: SparkSession, model: Model, edges: DataFrame) -> None:
    """Defines the functions of the session over a model and its edges, stored ones or made ones."""
    model.repos.createOrReplaceTempView(REPOSITORIES)
    edges.createOrReplaceTempView(EDGES)
    for text in statements():
        spark.sql(text)
