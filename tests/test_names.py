"""Containment by rare runs of characters equals the test of all pairs, and no plan compares all pairs."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import like_anywhere, like_suffix
from quarry.operators import resolve
from quarry.operators.names import ending, matched

NAMES = ["app-shop", "App-Shop", "", "a", "payments_service", "PaymentsService", "50%off", "x_y", "été-Svc", "İstanbul", "日本語サービス", "a\\b", "app", "shop-app-shop"]
NEEDLES = ["app", "shop", "APP-SHOP", "", "%", "_", "____", "p%s", "a_p", "y", "xy", "x_y", "50%", "é", "ÉTÉ", "本語", "zzz", "zz", "q", "a\\\\b", "%a%", "ist", "İ", "_pp-s", "service"]


@pytest.mark.parametrize("test", [like_anywhere, like_suffix])
def test_equals_all_pairs(spark, test):
    rnd = random.Random(4)
    names = spark.createDataFrame([*enumerate([*NAMES, None, "app"]), *((100 + k, "".join(rnd.choice("ab-X") for _ in range(rnd.randint(0, 8)))) for k in range(60))], "id long, name string")
    needles = spark.createDataFrame([(n,) for n in [*NEEDLES, None, "app", *("".join(rnd.choice("aBx-%_") for _ in range(rnd.randint(0, 5))) for _ in range(40))]], "needle string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    every = needles.distinct().crossJoin(names).filter(test(F.col("name"), F.col("needle"))).select("needle", "id")
    assert rows(matched(needles, names, test)) == rows(every) and every.count() > 100
    assert matched(needles.filter("false"), names).count() == matched(needles, names.filter("false")).count() == 0


def test_no_plan_compares_all_pairs(spark):
    names = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    events = names.select("id", "name", F.col("name").alias("source_file"))
    targets = spark.createDataFrame([(n,) for n in NEEDLES], "target string")
    catalog = spark.createDataFrame([("event:app-shop",), ("event:payload",)], "catalog_id string")
    for df in (resolve.like_matches(targets.withColumnRenamed("target", "name"), names), resolve.catalog_matches(catalog, events), resolve.topology_targets(targets, names, names.withColumn("repo_id", F.col("id")))):
        with redirect_stdout(shown := io.StringIO()):
            df.explain()
        assert "NestedLoop" not in shown.getvalue() and "Cartesian" not in shown.getvalue()


def test_ends_equal_all_pairs(spark):
    rnd = random.Random(4)
    names = spark.createDataFrame([*enumerate([*NAMES, None, "app"]), *((100 + k, "".join(rnd.choice("ab-X") for _ in range(rnd.randint(0, 8)))) for k in range(60))], "id long, name string")
    needles = spark.createDataFrame([(n,) for n in [*NEEDLES, None, "app", "App", *("".join(rnd.choice("aBx-%_") for _ in range(rnd.randint(0, 5))) for _ in range(40))]], "needle string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    every = needles.distinct().crossJoin(names).filter(like_suffix(F.col("name"), F.col("needle"))).select("needle", "id")
    assert rows(ending(needles, names)) == rows(every) and every.count() > 100
    assert ending(needles.filter("false"), names).count() == ending(needles, names.filter("false")).count() == 0


def test_ends_that_share_their_runs_cost_their_matches(spark):
    """Every number's digits are in very many names; only a match by the whole end keeps the pairs that are tested few."""
    from pyspark.sql import Row

    n = 3000
    events = spark.createDataFrame([Row(id=k, name=f"Event{k}Created", source_file="x") for k in range(n)])
    catalog = spark.createDataFrame([(f"event:{k}-created",) for k in range(n)], "catalog_id string")
    found = resolve.catalog_matches(catalog, events)
    want = sum(1 for k in range(n) for i in range(len(str(k))) if str(k)[i] != "0" or i == len(str(k)) - 1)
    assert found.count() == want
    with redirect_stdout(shown := io.StringIO()):
        ending(catalog.select(F.regexp_replace("catalog_id", "event:", "").alias("needle")), events).explain()
    tested = [line for line in shown.getvalue().splitlines() if "Join" in line and "end#" in line]
    assert tested and not any("ilike" in line.lower() for line in tested)
