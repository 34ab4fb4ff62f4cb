import pytest
from pyspark.sql import functions as F

from quarry.operators import entities, search
from quarry.plans.store import search_index
from quarry.schema import model_of
from tests.seed import golden


@pytest.fixture(scope="module")
def kb(spark):
    m = golden(spark)
    return m, search_index(m).cache()


def names(kb, q, **how):
    return [r["name"] for r in search.search_text(*kb, q, **how).orderBy("score", "entity_type", "entity_id").collect()]


def test_single_word_ranks_bookings_first(kb):
    assert any("ooking" in n for n in names(kb, "booking")[:3])


def test_two_words(kb):
    assert "BookingContext.Commands.CreateBooking" in names(kb, "booking creation")
    top = search.search_text(*kb, "booking cancellation").orderBy("score").first()
    assert "ooking" in (top.name + top.snippet) and "ancellation" in (top.name + top.snippet)


def test_operators_do_not_operate(kb):
    assert "BookingContext.Cancellation" in names(kb, "booking NOT cancellation")


@pytest.mark.parametrize("q", ["***", "zznonexistent", "book*", "", "   "])
def test_no_results(kb, q):
    # a single word is never relaxed, so a star leaves only a word that nothing has
    assert names(kb, q) == []


def test_type_filters(kb):
    rows = search.search_text(*kb, "payment", wanted="schema").collect()
    assert [(r.entity_type, r.sub_type, r.name) for r in rows] == [("module", "schema", "Payments.Schema.Transaction")]
    assert {r.sub_type for r in search.search_text(*kb, "payment", wanted="SCHEMA").collect()} == {"schema"}
    assert {r.entity_type for r in search.search_text(*kb, "gateway transaction", wanted="module").collect()} == {"module"}


def test_relaxation(kb):
    assert set(names(kb, "gateway zzz")) == {"PaymentGateway", "PaymentProcessor"} or "PaymentGateway" in names(kb, "gateway zzz")
    assert "payments-service" in names(kb, "paymen zzz")


def test_repository_filter_and_event_fields(kb):
    assert set(names(kb, "booking-service", wanted="field", repo="booking-service")) == {"booking_id", "guest_name"}
    assert {"BookingCreated", "booking_id", "guest_name"} <= set(names(kb, "BookingCreated"))


def test_next_actions(kb):
    rows = {r.entity_type: r.next_action for r in search.search_text(*kb, "payments service", limit=50).collect()}
    assert rows["repo"] == "kb_explain" and rows["field"] == "kb_field_impact" and rows["learned_fact"] == "kb_search"


def test_scores_follow_bm25(spark):
    texts = spark.createDataFrame([("a", "a", i, t, None) for i, t in enumerate(["x y", "x x z", "z", "w", "w w q"])], "entity_type string, sub_type string, entity_id long, name string, description string")
    docs = search.fts_docs(texts)
    got = {r.entity_id: r.score for r in search.ranked(search.Index.over(docs), "x").collect()}
    import math

    idf, avg = math.log((5 - 2 + 0.5) / (2 + 0.5)), 10 / 5
    want = {0: -idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)), 1: -idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_phrase(kb):
    index = search.Index.over(kb[1])
    assert {r.entity_id for r in search.phrase(index, "hotel booking").collect()} == {1}
    assert search.phrase(index, "booking hotel").count() == 0 and search.phrase(index, "").count() == 0


def test_fact_texts_of_both_paths(spark):
    m = golden(spark)
    rebuilt = {r.entity_id: r.description for r in search.index_texts(m).filter("entity_type = 'learned_fact'").collect()}
    added = {r.entity_id: r.description for r in search.index_texts(m, "content").filter("entity_type = 'learned_fact'").collect()}
    assert rebuilt == {1: "payments-service", 2: None} and added[2] == "Deploys happen on Tuesday"


def test_available_types(kb):
    got = {(r.entity_type, r.sub_type): r["count"] for r in search.available_types(kb[1]).collect()}
    assert got[("module", "module")] == 2 and got[("field", "ecto_schema")] == 3 and got[("service", "grpc")] == 1


def test_exact_entities_and_relationships(kb):
    m, docs = kb
    rows = entities.find_entities(m, docs, "payments-service").collect()
    assert [(r.entity_type, r.name) for r in rows] == [("repo", "payments-service")]
    assert [(x.direction, x.type, x.other_name) for x in rows[0].relationships] == [("outgoing", "consumes_event", "BookingCreated"), ("outgoing", "calls_grpc", "booking-service")]
    assert entities.find_entities(m, docs, "payments-service", relationship="routes_to").count() == 0
    assert entities.find_entities(m, docs, "  ").count() == 0


def test_entity_falls_back_to_search(kb):
    m, docs = kb
    assert {r.name for r in entities.find_entities(m, docs, "hotel").collect()} == {"booking-service"}


def test_type_rules_of_exact_lookup(kb):
    m, _ = kb
    q = m.spark.createDataFrame([("Payments.Schema.Transaction",)], "query string")
    assert entities.exact_entities(m, q, "schema").count() == 1
    assert entities.exact_entities(m, q, "context").count() == 0
    assert entities.exact_entities(m, q, "unheard_of").count() == 1


def test_shared_fields(spark):
    f = lambda i, r: {"id": i, "repo_id": r, "parent_type": "ecto_schema", "parent_name": "P", "field_name": "x", "field_type": "s", "nullable": True}
    m = model_of(spark, repos=[{"id": 1, "name": "a"}, {"id": 2, "name": "b"}], fields=[f(1, 1), f(2, 2)])
    rows = entities.exact_entities(m, spark.createDataFrame([("x",)], "query string")).collect()
    assert {r.description for r in rows} == {"[shared across 2 repos] ecto_schema P.x: s (nullable)"}


def test_long_facts_are_cut(spark):
    m = model_of(spark, learned_facts=[{"id": 1, "content": "a" * 120}])
    r = entities.entity_cards(m).first()
    assert r.name == "a" * 100 + "..." and r.repo == "user-knowledge"


def test_reading_order(spark):
    df = spark.createDataFrame([("b", "Zeta"), ("b", "alpha"), ("A", "x")], "repo string, name string").withColumn("entity_type", F.lit("m")).withColumn("entity_id", F.lit(1))
    assert [r.name for r in entities.in_reading_order(df).collect()] == ["x", "alpha", "Zeta"]
