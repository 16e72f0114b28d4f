import json

import pytest

from quirestone.operators.candidates import contradictory
from quirestone.operators.generate import StubModel, generated
from quirestone.operators.qualify import rule_errors, with_profile
from quirestone.sources.docx import authorized
from quirestone.sources.proposals import as_json, parse_json

PROMPT = "k string, system_prompt string, context_block string, user_prompt string"


class Picky:
    name = "picky"

    def generate(self, system, prompt):
        if "hard" in prompt:
            raise TimeoutError("too hard")
        return "easy answer"


def test_models_are_tried_in_order(spark):
    df = spark.createDataFrame([("a", "s", "ctx", "easy"), ("b", None, "", "hard question")], PROMPT)
    got = {r.k: r for r in generated(df, key="k", models=[Picky, StubModel]).collect()}
    assert (got["a"].text, got["a"].model, got["a"].attempts, got["a"].prompt_tokens, got["a"].completion_tokens) == ("easy answer", "picky", 1, 3, 2)
    assert (got["b"].text, got["b"].model, got["b"].attempts, got["b"].error) == ("[stub] hard question", "stub", 2, None)
    alone = {r.k: r for r in generated(df, key="k", models=[Picky]).collect()}
    assert alone["b"].text is None and alone["b"].error == "TimeoutError: too hard" and alone["a"].text == "easy answer"
    assert generated(df.limit(0), key="k", models=[StubModel]).count() == 0


def test_profiles_and_rules(spark):
    df = spark.createDataFrame([(1, "Compare A and B", "v2"), (2, "what is it?", "2"), (3, None, None)], "k int, q string, version string")
    profiles = {"compare": r"\bcompare\b", "question": r"^(what|who)"}
    assert [r.profile for r in with_profile(df, text="q", profiles=profiles, default="rag").orderBy("k").collect()] == ["compare", "question", "rag"]
    assert [tuple(r) for r in rule_errors(df, key="k", rules={"version": r"v\d+"}).collect()] == [(2, "version")]


def test_contradictory_payloads(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "a", None), (4, None, "b")], "i int, doc string, payload string")
    assert sorted(r.i for r in contradictory(df, {"doc": "payload"}).collect()) == [2, 4]


def test_authorization(spark):
    files = spark.createDataFrame([("file:///data/lib/a.docx",), ("/data/lib/b.docx",)], "path string")
    assert authorized(files, "/data/lib", role="REFERENCE_KNOWLEDGE").count() == 2
    for bad, role in ((files, "PUBLISHING_TEMPLATE"), (files.unionByName(spark.createDataFrame([("/data/library2/x",)], "path string")), "REFERENCE_KNOWLEDGE"), (spark.createDataFrame([("/data/lib/../x",)], "path string"), "REFERENCE_KNOWLEDGE")):
        with pytest.raises(PermissionError):
            authorized(bad, "/data/lib", role=role)


def test_json_documents(spark):
    from tests.test_transport import block, entry, frame

    df = frame(
        spark,
        block(2, "table", "sections[3].blocks[1]", "late", headers=["a", None], rows=[["1", None], None]), block(1, "paragraph", "sections[3].blocks[0]", "late", text='say "é"', reference_ids=["r", None]),
        block(3, "requirement_matrix", "sections[0].blocks[0]", "early", entries=[entry("1", "x")]),
    )
    written = json.loads(as_json(df).first().json)
    assert json.dumps(written, sort_keys=True) == json.dumps(written)
    blocks, bad = parse_json(as_json(df), key="proposal_id", json="json")
    rows = {r.block_id: r for r in blocks.collect()}
    assert {i: r.path for i, r in rows.items()} == {3: "sections[0].blocks[0]", 1: "sections[1].blocks[0]", 2: "sections[1].blocks[1]"}
    assert rows[1].text == 'say "é"' and rows[1].reference_ids == ["r", None] and rows[2].rows == [["1", None], None] and rows[3].entries[0].evidence_reference_ids == ["x"]
    assert bad.count() == 0
    broken = spark.createDataFrame([("a", None), ("b", " "), ("c", "{"), ("d", "{}"), ("e", '{"proposal_id": "other", "sections": [{"section_id": "s", "blocks": [{"type": "paragraph", "text": "t"}]}]}')], "k string, j string")
    blocks, bad = parse_json(broken, key="k", json="j")
    assert sorted(map(tuple, bad.collect())) == [("a", "missing_payload"), ("b", "missing_payload"), ("c", "invalid_json"), ("d", "missing_sections")]
    assert [(r.proposal_id, r.text) for r in blocks.collect()] == [("e", "t")]
