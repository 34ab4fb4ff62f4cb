import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import edges as E
from quarry.functions import text as T
from quarry.operators.search import words_of

PAIRS = [
    ("BookingCreated", "booking created"),
    ("XMLHttpRequest", "xml http request"),
    ("snake_case.and/path\\x", "snake case and path x"),
    ("  many   blanks ", "many blanks"),
    ("version2Beta", "version2 beta"),
    ("***", ""),
    ("", ""),
    (None, ""),
    ("café X", "caf x"),
    ("a-b+c", "a b c"),
    ("HTTPServer2XX", "http server2 xx"),
]


def test_tokenized(spark):
    df = spark.createDataFrame(PAIRS, "s string, want string").withColumn("got", T.tokenized(F.col("s")))
    assert [(r.s, r.got) for r in df.collect()] == PAIRS


def test_words_of_agrees_with_the_column(spark):
    for text, want in PAIRS:
        if text is not None:
            assert " ".join(t for g in words_of(text) for t in g) == want


def test_operators_are_plain_words():
    assert words_of('booking AND NOT "x*"') == (("booking",), ("and",), ("not",), ("x",))


@pytest.mark.parametrize(("slug", "camel", "snake"), [("payment-failed", "PaymentFailed", "payment_failed"), ("a", "A", "a"), ("x-yZ", "XYZ", "x_yZ")])
def test_kebab(spark, slug, camel, snake):
    row = spark.createDataFrame([(slug,)], "s string").select(T.camel_of_kebab(F.col("s")).alias("c"), T.snake_of_kebab(F.col("s")).alias("k")).first()
    assert (row.c, row.k) == (camel, snake)


def test_like_ignores_case_and_has_wildcards(spark):
    df = spark.createDataFrame([("App-Resources", "resour"), ("app_x", "p_x"), ("apppx", "p_x"), ("abc", "d"), (None, "a")], "s string, p string")
    assert [r.ok for r in df.select(T.like_anywhere(F.col("s"), F.col("p")).alias("ok")).collect()] == [True, True, True, False, None]


def test_number_of_key_is_stable_and_positive(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), ("ab", "")], "x string, y string").select(T.number_of_key(F.col("x"), F.col("y")).alias("n"))
    got = [r.n for r in df.collect()]
    assert len(set(got)) == 3 and min(got) > 0


def test_metadata_field(spark):
    df = spark.createDataFrame([('{"confidence":"high"}',), ("{bad",), (None,), ("{}",), ('{"confidence":""}',)], "m string")
    assert [r.c for r in df.select(E.metadata_field(F.col("m"), "confidence").alias("c")).collect()] == ["high", None, None, None, None]


def test_described_precedence(spark):
    rows = [("calls_grpc", "high", None, None), ("calls_grpc", None, None, None), ("consumes_event", None, "E", None), ("calls_http", "low", "E", "T"), ("belongs_to", None, None, None)]
    df = spark.createDataFrame(rows, "r string, c string, e string, u string").select(E.described(F.col("r"), F.col("c"), F.col("e"), F.col("u")).alias("t"), E.mechanism(F.col("r")).alias("m"))
    assert [(r.t, r.m) for r in df.collect()] == [("gRPC [high]", "grpc"), ("gRPC", "grpc"), ("event (E)", "event"), ("HTTP -> [unresolved: T]", "http"), ("belongs_to", "belongs_to")]


def test_admitted():
    assert E.admitted(None, ("a", "b")) == ["a", "b"]
    assert E.admitted("grpc", ("calls_grpc", "calls_http")) == ["calls_grpc"]
    assert E.admitted("nothing", ("calls_grpc",)) == []


def test_tokens_are_the_words_of_tokenized(spark):
    rnd = random.Random(4)
    rows = [(k, "".join(rnd.choice("aAbBz019Z._ -\néİ\U0001f600") for _ in range(rnd.randint(0, 30)))) for k in range(3000)] + [(-1, None)]
    got = spark.createDataFrame(rows, "k long, s string").select("s", T.tokens(F.col("s")).alias("t"), T.tokenized(F.col("s")).alias("want")).collect()
    assert all(r.t == r.want.split(" ") if r.want else r.t == [] for r in got)
    assert "regexp_replace" not in spark.range(1).select(T.tokens(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
