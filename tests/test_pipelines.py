import pytest
from pyspark.sql import functions as F

from quirestone.plans import pipelines
from quirestone.sources.docx import compose_docx
from tests.test_documents import ELEMENT, SECTION, element, frames, uid

HEADED = [("heading", "heading_1", "Power"), ("paragraph", "body", "The supply is 24 volts."), ("heading", "heading_3", "Cables"), ("table_row", "table_header", "type | length"), ("table_row", "table_cell", "NYM | 30 m"), ("paragraph", "body", "All cables are shielded.")]


class Counted:
    dimensions = 4

    def embed(self, texts):
        if any("poison" in t for t in texts):
            raise TimeoutError("no answer")
        return [[float(len(t)), 1.0, 0.0, 0.0] for t in texts]


class ByLength:
    def rerank(self, question, texts):
        return [float(len(t)) for t in texts]


class Silent:
    name = "silent"

    def generate(self, system, prompt):
        return " "


class Echo:
    name = "echo"

    def generate(self, system, prompt):
        return prompt


def test_files_to_points(spark, tmp_path):
    (tmp_path / "one.docx").write_bytes(compose_docx(HEADED))
    (tmp_path / "broken.docx").write_bytes(b"no package")
    (tmp_path / "page.PDF").write_bytes(b"x")
    (tmp_path / "other.txt").write_text("x")

    def extractor(content):
        span = {"page_number": 1, "kind": "text", "x0": 0.0, "x1": 9.0, "size": 10.0, "bold": False}
        return [span | {"y0": 50.0, "y1": 60.0, "text": "Body of the page."}, span | {"y0": 10.0, "y1": 20.0, "text": "CHAPTER ONE", "size": 20.0}]

    run = pipelines.index_files(spark, str(tmp_path), role="REFERENCE_KNOWLEDGE", extractor=extractor)
    points = run.points.orderBy("document_id", "chunk_index").collect()
    assert [(p.document_title, p.section_path, p.element_type, p.source_document, p.page_number) for p in points] == [
        ("Power", ["Power"], "paragraph", "one", None), ("Power", ["Power", "Cables"], "table", "one", None), ("Power", ["Power", "Cables"], "paragraph", "one", None), ("CHAPTER ONE", ["CHAPTER ONE"], "paragraph", "page", None),
    ]
    assert "NYM | 30 m" in points[1].original_text and len({p.point_id for p in points}) == 4
    assert [(e.doc_id.rsplit("/", 1)[1], e.stage) for e in run.errors.collect()] == [("broken.docx", "parsing")]
    assert run.statistics.first().asDict() == {"discovered": 3, "indexed": 2, "chunks": 4, "embedded_texts": 4, "failed": 1, "skipped": 0}
    assert pipelines.index_files(spark, str(tmp_path), role="REFERENCE_KNOWLEDGE").errors.filter("detail = 'no extractor'").count() == 1
    again = pipelines.index_files(spark, str(tmp_path), role="REFERENCE_KNOWLEDGE", extractor=extractor, indexed=run.points.select("document_fingerprint"))
    assert again.points.count() == 0 and again.statistics.first().skipped == 2
    with pytest.raises(PermissionError):
        pipelines.index_files(spark, str(tmp_path), role="PUBLISHING_TEMPLATE")
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        pipelines.index_files(spark, str(tmp_path / "none"), role="REFERENCE_KNOWLEDGE")


CHANGES = {
    "cell": lambda e: e | {"rows": [(0, [("h", "header", 0)]), (1, [("2", "data", 0)])]} if e["element_type"] == "table" else e,
    "item": lambda e: e | {"items": [("y", 0)]} if e["element_type"] == "list" else e,
    "caption": lambda e: e | {"caption": "another"} if e["element_type"] == "image" else e,
    "order": lambda e: e | {"order_index": e["order_index"] + 10},
}


@pytest.mark.parametrize("what", ["cell", "item", "caption", "order", "heading", "nothing"])
def test_what_changes_a_document(spark, what):
    rows = [
        element(0, content="one", doc="a"), element(1, kind="table", rows=[(0, [("h", "header", 0)]), (1, [("1", "data", 0)])], doc="a"), element(2, kind="list", list_type="bullet", items=[("x", 0)], doc="a"),
        element(3, kind="image", caption="c", alt_text="t", doc="a"), element(4, content="other", doc="b"),
    ]
    heads = [("a", uid(90), None, "Head", 1, 0)]
    e, s = spark.createDataFrame(rows, ELEMENT), spark.createDataFrame(heads, SECTION)
    before = pipelines.fingerprints(e, s)
    changed = [CHANGES.get(what, lambda x: x)(r) if r["doc_id"] == "a" else r for r in rows]
    if what == "heading":
        s = spark.createDataFrame([("a", uid(90), None, "Other", 1, 0)], SECTION)
    after = pipelines.fingerprints(spark.createDataFrame(changed, ELEMENT), s)
    assert sorted(r.doc_id for r in after.join(before, "document_fingerprint", "left_anti").collect()) == ([] if what == "nothing" else ["a"])


def test_a_bad_document_does_not_stop_the_others(spark):
    e, s = frames(spark, [element(0, content="fine", doc="a"), element(1, content="poison", doc="b"), element(5, at=-5, content="bad place", doc="c"), element(2, content=None, doc="d")])
    run = pipelines.index_run(e, s, provider=Counted)
    assert {(r.doc_id, r.stage): r.detail for r in run.errors.collect()} == {("b", "embedding"): "TimeoutError: no answer", ("c", "validation"): "INVALID_ORDER_INDEX"} | ({} if run.points.filter("document_id = 'd'").count() else {("d", "chunking"): "no chunks"})
    assert "a" in {r.document_id for r in run.points.collect()} and run.points.filter("document_id in ('b', 'c')").count() == 0
    assert run.statistics.first().failed == run.errors.count()


POINT = "point_id string, chunk_id string, document_id string, section_path array<string>, chunk_index int, original_text string, content_hash string, embedding_text string, source_document string, version string, vector array<double>"


def points(spark, *texts):
    rows = [(f"p{i}", f"k{i}", f"d{i}", ["A"], 0, t, t, t, source, version, [1.0, i * 0.1]) for i, (t, source, version) in enumerate(texts)]
    return spark.createDataFrame(rows, POINT)


class Flat:
    dimensions = 2

    def embed(self, texts):
        return [[1.0, 0.0] for _ in texts]


def test_filters_reranking_history_and_models(spark):
    found = points(spark, ("short", "a", "1"), ("a bit longer", "a", "2"), ("the longest text of all", "b", "1"), ("mid size", "b", "2"))
    asked = spark.createDataFrame(
        [(1, "volts?", [("user", "hi"), (None, " there ")]), (2, "volts? document: b, version: 1", None), (3, "volts? department: x", []), (4, " ", None)], "query_id long, question string, history array<struct<role:string,content:string>>"
    )
    rows = {r.query_id: r for r in pipelines.ask(asked, found, provider=Flat, reranker=ByLength, models=[Silent, Echo], top_k=2).collect()}
    assert [rows[1].context_block.index(t) >= 0 for t in ("[c1] d2", "[c2] d1")] == [True, True] and "short" not in rows[1].context_block
    assert rows[1].history_block == "User: hi\nUser: there" and rows[1].history_tokens == 4 and rows[1].text.startswith("User: hi") and (rows[1].model, rows[1].attempts) == ("echo", 2)
    assert rows[1].context_tokens == 8 and rows[1].prompt_tokens == rows[1].system_tokens + 4 + 8 + 2
    assert "[c1] d2" in rows[2].context_block and "c2" not in rows[2].context_block
    assert rows[3].context_block == "" and rows[3].text == "Question: volts? department: x"
    assert rows[4].rejection == "empty" and rows[4].text is None
    assert pipelines.ask(asked.limit(0), found, provider=Flat).count() == 0 and pipelines.ask(asked, found.limit(0), provider=Flat).count() == 4


def test_many_points_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pipelines, "FEW_POINTS", 1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    got = pipelines.search(q, points(spark, ("a", "x", None), ("b", "x", None), ("c", "y", None)), k=2)
    assert [(r.point_id, r["rank"], r.original_text) for r in got.orderBy("rank").collect()] == [("p0", 1, "a"), ("p1", 2, "b")]
    got = pipelines.search(q.withColumn("source_document", F.lit("y")), points(spark, ("a", "x", None), ("c", "y", None)), k=2, match=["source_document"])
    assert [r.point_id for r in got.collect()] == ["p1"]
