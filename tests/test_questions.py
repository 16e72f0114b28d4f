import unicodedata

import pytest
from pyspark.sql import functions as F

from quirestone.operators.qualify import clarifications, language, processed, qualified, received, rejection, request_errors, retrieval_requests, with_defaults


def one(spark, text):
    return qualified(spark.createDataFrame([(text,)], "t string"), text="t").first()


def test_parameters(spark):
    r = one(spark, "What are the retention rules? document: handbook, department: legal, version: v2")
    assert (r.question, r.document, r.department, r.version) == ("What are the retention rules?", "handbook", "legal", "v2")
    assert r.confidence == 1.0 and not r.needs_clarification


def test_missing(spark):
    r = one(spark, "document: handbook")
    assert r.missing == ["question"] and r.confidence == 0.55 and r.needs_clarification


def test_ambiguous_and_conflicting(spark):
    r = one(spark, "Which policy applies? document: handbook or procedures")
    assert r.ambiguous == ["document"] and r.conflicting == [] and r.confidence == 0.8
    r = one(spark, "Which policy? DOCUMENT = handbook; document: procedures, version: 1")
    assert r.conflicting == ["document"] and r.document == "handbook" and r.confidence == 0.75 and r.version == "1"
    rows = clarifications(qualified(spark.createDataFrame([(1, "document: a or b, document: c")], "k int, t string"), text="t"), "k").orderBy("ord").collect()
    assert [(x.kind, x.parameter) for x in rows] == [("missing", "question"), ("ambiguous", "document"), ("conflicting", "document")]


def test_null_question(spark):
    assert one(spark, None).missing == ["question"]


def test_normal_form(spark):
    df = spark.createDataFrame([("  What\r\n\tpolicy applies?   document: handbook  ",), ("Café policy",), ("one two three four",), (None,)], "t string")
    rows = processed(df, text="t").collect()
    assert rows[0].normalized == "What policy applies? document: handbook" and rows[1].normalized == unicodedata.normalize("NFC", "Café policy") and rows[3].normalized is None
    assert (rows[2].char_count, rows[2].word_count, rows[2].estimated_tokens) == (18, 4, 5) and rows[2].cache_key == "query:" + rows[2].query_hash


@pytest.mark.parametrize(("text", "want"), [("Café policy", ("en", 0.6)), ("नमस्ते नीति", ("hi", None)), ("123 !", ("en", 0.0)), ("привет ab", ("ru", 0.75)), ("日本語のテキスト", ("zh", 0.38)), ("abcdefg世", ("zh", 0.12))])
def test_language(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(language(F.col("t")).alias("x")).first().x
    assert r.language == want[0] and (want[1] is None or r.confidence == want[1])


@pytest.mark.parametrize(("text", "want"), [("ok\n\t", None), ("a\0b", "control_character"), ("x" * 10_001, "too_long"), ("x" * 10_000, None), (" 　", "empty"), (None, "empty")])
def test_rejection(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(rejection(F.col("t"))).first()[0] == want


def test_requests(spark):
    q = qualified(spark.createDataFrame([(1, "Why? document: proposal")], "k int, t string"), text="t")
    r = retrieval_requests(q, "k").first()
    assert r.filters == {"document": "proposal"} and (r.top_k, r.candidate_budget, r.score_threshold) == (5, 20, 0.0)
    with pytest.raises(ValueError):
        retrieval_requests(q, "k", top_k=30)


def test_limits_defaults_and_their_errors(spark):
    df = spark.createDataFrame([(1, "a", None, {"top_k": "30"}), (2, "b", "v2", {"top_k": "0", "score_threshold": "1.5"}), (3, "c", None, {"max_latency_ms": "-1", "top_k": "x"}), (4, "d", None, None)], "k int, question string, version string, o map<string,string>")
    df = df.withColumns({"document": F.lit(None).cast("string"), "department": F.lit(None).cast("string")})
    requests = retrieval_requests(df, "k", overrides="o")
    assert [(r.k, r.top_k, r.candidate_budget, r.max_context_tokens) for r in requests.orderBy("k").collect()] == [(1, 30, 30, 4000), (2, 0, 20, 4000), (3, 5, 20, 4000), (4, 5, 20, 4000)]
    assert sorted(map(tuple, request_errors(requests, "k").collect())) == [(2, "score_threshold"), (2, "top_k"), (3, "max_latency_ms")]
    got = {r.k: (r.version, r.department, r.given) for r in with_defaults(df, {"version": "v1", "department": "sales"}).collect()}
    assert got[1] == ("v1", "sales", []) and got[2] == ("v2", "sales", ["version"])


def test_received(spark):
    rows = received(spark.createDataFrame([(" what? ",), (" ",), (None,)], "q string"), text="q").collect()
    assert [(r.q, r.rejection) for r in rows] == [("what?", None), ("", "empty"), (None, "empty")] and len({r.query_id for r in rows}) == 3 and all(r.received_at for r in rows)
