import pytest
from pyspark.sql import functions as F

from quirestone.operators.collections import Collection, contract, ensure, points_of, run_statistics, upsert
from quirestone.operators.planning import answers, assembled, assembly_errors, context_errors, generation_strategy, proposal_prompts, reference_findings, review_findings, section_queries


def test_section_queries(spark):
    plan = [("p", 1, "cover", "Cover", "general", [], False, False, False), ("p", 2, "solution", "Solution", "general", ["Use eight sensors", " "], True, True, True), ("p", 3, "scope", "Scope", None, None, False, False, True)]
    df = spark.createDataFrame(plan, "k string, ord int, section_id string, title string, kind string, requirements array<string>, authoring boolean, technical boolean, blueprint boolean")
    got = [(r.query_ord, r.section_id, r.query) for r in section_queries(df, key="k").orderBy("query_ord").collect()]
    assert got == [(1, "solution", "Solution | authoring | general"), (2, "solution", "Solution | technical | general | Use eight sensors"), (3, "solution", "Solution | blueprint | general"), (4, "scope", "Scope | blueprint")]


def test_strategy(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 2, 1), (1, 0, 0), (0, 0, 1), (0, 0, 0)], "a int, t int, b int")
    assert [r[0] for r in df.select(generation_strategy(F.col("a"), F.col("t"), F.col("b"))).collect()] == ["combined", "technical", "reference_based", "reference_based", "user_input_only"]


CONTENT = "k string, part string, ord int, text string, reference_ids array<string>"


def test_assembly_and_review(spark):
    plan = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("ok", "a", 1), ("ok", "b", 2)], "k string, part string, ord int")
    contents = spark.createDataFrame([("p", "b", 1, "x", ["r", "z"]), ("p", "a", 2, " ", None), ("p", "d", 3, "y", []), ("ok", "b", 2, "2", []), ("ok", "a", 1, "1", ["r"])], CONTENT)
    assert sorted(map(tuple, assembly_errors(plan, contents, key="k", part="part").collect())) == [("p", "c", "missing_content"), ("p", "d", "unplanned_content")]
    done = assembled(plan.withColumnRenamed("ord", "place"), contents, key="k", part="part", order="place")
    assert [(r.k, r.part, r.text) for r in done.orderBy("place").collect()] == [("ok", "a", "1"), ("ok", "b", "2")]
    refs = spark.createDataFrame([("p", "r"), ("ok", "r")], "k string, reference_id string")
    found = sorted((r.k, r.part, r.finding, r.detail) for r in review_findings(plan, contents, refs, key="k", part="part").collect())
    assert found == [
        ("p", "a", "empty_content", None), ("p", "a", "out_of_order", "2"), ("p", "b", "out_of_order", "1"), ("p", "b", "unknown_reference", "z"), ("p", "c", "missing_content", None), ("p", "d", "unplanned_content", None),
    ]


def test_answers(spark):
    r = spark.createDataFrame([("q", "t", ["c1", "c9"]), ("n", "t", None)], "q string, text string, cited array<string>")
    c = spark.createDataFrame([("q", "c1", "doc", ["A", "B"]), ("q", "c2", "doc", None)], "q string, citation_id string, document_id string, header_path array<string>")
    got = {x.q: x for x in answers(r, c, query="q").collect()}
    assert [tuple(x) for x in got["q"].citations] == [("c1", "doc", "B")] and got["q"].unsupported == ["c9"] and got["n"].unsupported == []


def test_collections(spark, tmp_path):
    made, folder = Collection("points", 2, "mock"), str(tmp_path / "points")
    assert contract(spark, folder) is None
    ensure(spark, folder, made)
    ensure(spark, folder, made)
    assert points_of(spark, folder) is None and contract(spark, folder)["dimensions"] == 2
    points = lambda *r: spark.createDataFrame(list(r), "point_id string, vector array<double>")
    put = lambda p: upsert(spark, folder, p)
    one = points(("a", [1.0, 2.0]))
    assert put(one) == {"inserted": 1, "updated": 0} and put(one) == {"inserted": 0, "updated": 1}
    assert put(points(("a", [3.0, 4.0]), ("b", [5.0, 6.0]))) == {"inserted": 1, "updated": 1}
    many = [(f"p{i}", [float(i), 0.0]) for i in range(200)]
    assert put(points(*many)) == {"inserted": 200, "updated": 0} and put(points(("p7", [0.0, 1.0]))) == {"inserted": 0, "updated": 1}
    assert sorted(map(tuple, points_of(spark, folder).collect())) == sorted([("a", [3.0, 4.0]), ("b", [5.0, 6.0]), *many[:7], ("p7", [0.0, 1.0]), *many[8:]])
    for bad in (points(("a", [1.0, 2.0]), ("a", [1.0, 2.0])), points(("c", [1.0]))):
        with pytest.raises(ValueError):
            put(bad)
    with pytest.raises(ValueError):
        ensure(spark, folder, Collection("points", 3, "mock"))
    ensure(spark, folder, Collection("points", 3, "mock"), recreate=True)
    assert points_of(spark, folder) is None or points_of(spark, folder).count() == 0
    with pytest.raises(ValueError):
        points_of(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        Collection("x", 0, "mock")


def test_run_statistics(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id string")
    points = spark.createDataFrame([("h",), ("h",), ("i",)], "content_hash string")
    errors = spark.createDataFrame([("/x",)], "doc_id string")
    r = run_statistics(ids("a", "b", "c", "d"), ids("a", "b"), points, errors).first()
    assert (r.discovered, r.indexed, r.skipped, r.failed, r.chunks, r.embedded_texts) == (4, 2, 1, 1, 3, 2)


def test_prompts_of_proposals(spark):
    import json

    projects = spark.createDataFrame([("p", "ACME", "Offer", {"b": "2", "a": "1"}, ["do it"], None), ("q", "B", "T", None, [], [])], "k string, client string, title string, data map<string,string>, requirements array<string>, constraints array<string>")
    plan = spark.createDataFrame([("p", 2, "end", "The end"), ("p", 1, "start", "The \"start\""), ("q", 1, "only", "Only")], "k string, ord int, section_id string, title string")
    refs = [("p", "start", "technical", f"t{i}", "doc", f"text {i}", s) for i, s in enumerate([0.1, 0.9, None, 0.9, float("nan")])] + [("p", "end", "authoring", "a", None, "style", 0.5), ("p", "lost", "technical", "x", "d", "no section", 1.0), ("p", "start", "other", "x", "d", "no type", 1.0)]
    refs = spark.createDataFrame(refs, "k string, section_id string, reference_type string, reference_id string, source_document string, content string, score double")
    got = {r.k: r for r in proposal_prompts(projects, plan, refs, key="k").collect()}
    p = got["p"].user_prompt
    assert [p.index(x) for x in ("Client: ACME", 'Project Data: {"a":"1","b":"2"}', "- do it", "Constraints:\n- None supplied", "[TECHNICAL_REFERENCES]", "text 1", "text 3", "text 0", "[AUTHORING_REFERENCES]", "style", "[BLUEPRINT_REFERENCES]\nLower priority than user ground truth.\nNone retrieved", "1. section_id: start", "2. section_id: end", "[OUTPUT_CONTRACT]")] == sorted(p.index(x) for x in ("Client: ACME", 'Project Data: {"a":"1","b":"2"}', "- do it", "Constraints:\n- None supplied", "[TECHNICAL_REFERENCES]", "text 1", "text 3", "text 0", "[AUTHORING_REFERENCES]", "style", "[BLUEPRINT_REFERENCES]\nLower priority than user ground truth.\nNone retrieved", "1. section_id: start", "2. section_id: end", "[OUTPUT_CONTRACT]"))
    assert "text 2" not in p and "no section" not in p and "no type" not in p and (got["p"].sections, got["p"].references, got["p"].strategy) == (2, 4, "combined")
    schema = json.loads(got["p"].schema)
    assert schema["properties"]["proposal_id"]["const"] == "p" and schema["properties"]["sections"]["minItems"] == 2 and schema["properties"]["sections"]["items"]["properties"]["section_id"]["enum"] == ["start", "end"]
    assert json.dumps(schema, sort_keys=True, separators=(",", ":")) == got["p"].schema
    assert got["q"].references == 0 and "- None supplied" in got["q"].user_prompt and got["q"].strategy == "user_input_only"


def test_context_groups(spark):
    queries = spark.createDataFrame([("p", "s", "technical")], "k string, section_id string, reference_type string")
    refs = spark.createDataFrame([("p", "s", "technical", "a"), ("p", "s", "blueprint", "b"), ("p", "t", "technical", "c")], "k string, section_id string, reference_type string, reference_id string")
    assert sorted(tuple(r) for r in context_errors(queries, refs, key="k").collect() if r.error == "no_queries") == [("p", "t", "no_queries", None)]
    assert [r.reference_id for r in context_errors(queries, refs, key="k").filter("error = 'incompatible_reference'").collect()] == ["b"]


def test_findings_on_references(spark):
    rows = [("p", "s", "r1", "technical", "c", "d", "t", 0.5, {"a": 1.0}), ("p", "s", "r1", "technical", "c", "d", "t", 0.5, {"a": 1.0}), ("p", "s", "r2", " ", None, "d", "t", -1.0, {" ": 1.0, "x": float("inf")}), ("p", "s", None, "technical", "c", "d", "", None, None)]
    df = spark.createDataFrame(rows, "k string, part string, reference_id string, reference_type string, chunk_id string, source_document string, content string, score double, m map<string,double>")
    got = sorted((r.finding, r.detail) for r in reference_findings(df, key="k", part="part", metadata="m").collect())
    assert got == [("invalid_metadata", "key"), ("invalid_metadata", "x")] + [("invalid_reference", x) for x in ("chunk_id", "content", "reference_id", "reference_type", "score", "score")]
