import uuid
from datetime import datetime

from pyspark.sql import functions as F

from quirestone.operators.transport import (
    block_errors, component_ids, document_errors, grouped_references, has_markdown, hierarchy_errors, markdown_tables, once, plan_conformance, render_operations, section_sequences, spread_slots, undeclared_references,
)
from quirestone.plans.pipelines import publish
from quirestone.sources.docx import compose_docx, composed_documents, discover, package_inventory, package_parts, parse_docx, read_docx

BLOCK = (
    "block_id long, proposal_id string, section_id string, path string, ord int, type string, text string, items array<string>, headers array<string>, rows array<array<string>>, visual_id string, description string, label string, "
    "entries array<struct<requirement_id:string,requirement:string,response:string,evidence_reference_ids:array<string>>>, reference_ids array<string>, generated_at timestamp, ingested_at timestamp, error string"
)
T = datetime(2024, 1, 1)
DECLARED = "proposal_id string, reference_id string, title string, source string, locator string, declared_at timestamp, deleted_at timestamp"


def block(n, kind, path="sections[0].blocks[0]", section="cover", **more):
    known = dict.fromkeys(x.split()[0] for x in "text items headers rows visual_id description label entries reference_ids error".split())
    return known | {"block_id": n, "proposal_id": "p", "section_id": section, "path": path, "ord": n, "type": kind, "generated_at": T, "ingested_at": T} | more


def entry(n, *refs, requirement="r", response="a"):
    return {"requirement_id": n, "requirement": requirement, "response": response, "evidence_reference_ids": list(refs)}


def frame(spark, *blocks):
    return spark.createDataFrame(list(blocks), BLOCK)


def test_block_rules(spark):
    df = frame(
        spark,
        block(1, "paragraph", text="ok", reference_ids=["a", None]), block(2, "paragraph", text=" "), block(3, "callout"), block(4, "bullet_list", items=[]), block(5, "bullet_list", items=["a", " "]),
        block(6, "table", headers=["a", "b"], rows=[["1", "2"], ["1"]]), block(7, "table", headers=None, rows=[]), block(8, "visual_placeholder"), block(9, "requirement_matrix", entries=[]),
        block(10, "requirement_matrix", entries=[entry("1"), entry("1", response=" ")]), block(11, "poem"), block(12, None), block(13, "requirement_matrix", entries=[entry("1", "x"), entry("2")]),
        block(14, "table", headers=["a", " "], rows=[["1", "2"]]), block(15, "callout", label="l", text="t"), block(16, "visual_placeholder", visual_id="v", description="d"),
    )
    got = sorted((r.block_id, r.error) for r in block_errors(df).collect())
    assert got == [
        (1, "BLANK_REFERENCE"), (2, "MISSING_TEXT"), (3, "MISSING_LABEL"), (3, "MISSING_TEXT"), (4, "EMPTY_LIST"), (5, "BLANK_LIST_ITEM"), (6, "RAGGED_TABLE"), (7, "MISSING_TABLE_HEADERS"), (7, "MISSING_TABLE_ROWS"), (8, "MISSING_DESCRIPTION"), (8, "MISSING_VISUAL_ID"), (9, "EMPTY_MATRIX"),
        (10, "BLANK_MATRIX_FIELD"), (10, "DUPLICATE_REQUIREMENT"), (11, "UNKNOWN_BLOCK_TYPE"), (12, "UNKNOWN_BLOCK_TYPE"), (14, "BLANK_TABLE_HEADER"),
    ]


def test_references_and_publishing(spark):
    later = datetime(2024, 2, 1)
    df = frame(
        spark,
        block(1, "paragraph", text="x", reference_ids=["a", "b", " "]), block(1, "paragraph", text="y", reference_ids=["a"], ingested_at=later), block(2, "requirement_matrix", entries=[entry("1", "a", "z")]),
        block(3, "paragraph", text="fine", proposal_id="q", reference_ids=["c"]),
    )
    declared = spark.createDataFrame([(p, r, "title", "source", None, T, None) for p, r in (("p", "a"), ("q", "c"), ("q", "z"))], DECLARED)
    assert [r.text for r in once(df).filter("block_id = 1").collect()] == ["y"]
    assert sorted(map(tuple, undeclared_references(df, declared).collect())) == [("p", "b"), ("p", "z")]
    errors, lines = publish(df, declared)
    assert sorted(map(tuple, errors.collect())) == [("p", "UNKNOWN_REFERENCE", "z")]
    assert [(r.proposal_id, r.kind, r.text) for r in lines.orderBy("op_ord").collect()] == [("q", "paragraph", "q"), ("q", "heading", "Cover"), ("q", "paragraph", "fine")]


def test_document_rules(spark):
    later = datetime(2024, 2, 1)
    df = frame(
        spark,
        block(1, "visual_placeholder", "sections[0].blocks[0]", "a", visual_id="v", description="d"), block(2, "visual_placeholder", "sections[1].blocks[0]", "b", visual_id="v", description="d"),
        block(3, "paragraph", "sections[2].blocks[0]", "a", text="x", reference_ids=["gone", "lost"]), block(4, "paragraph", "sections[1].children[0].blocks[0]", " ", text="x"),
        block(5, "visual_placeholder", "sections[0].blocks[0]", "a", proposal_id="q", visual_id="v", description="d"),
    )
    declared = spark.createDataFrame(
        [("p", "r", "t", "s", None, T, None), ("p", "r", "t", "s", None, T, None), ("p", "two", "t", "s", None, T, None), ("p", "two", "t", "s", None, later, None), ("p", "again", "t", "s", None, T, later), ("p", "again", "t", "s", None, later, None),
         ("p", "bare", " ", None, None, T, None), ("p", None, "t", "s", None, T, None), ("p", "gone", "t", "s", None, T, later)], DECLARED,
    )
    got = sorted((r.error, r.subject) for r in document_errors(df, declared).filter("proposal_id = 'p'").collect() if r.subject is not None)
    assert got == sorted([("DUPLICATE_VISUAL_ID", "v"), ("UNKNOWN_REFERENCE", "lost"), ("BLANK_REFERENCE_TITLE", "bare"), ("BLANK_REFERENCE_SOURCE", "bare"), ("DUPLICATE_REFERENCE", "two"), ("DUPLICATE_SECTION", "a"), ("BLANK_SECTION_ID", " "), ("BLANK_HEADING", " ")])
    assert [tuple(r) for r in document_errors(df, declared).filter("subject is null").collect()] == [("p", "BLANK_REFERENCE_ID", None)]
    assert document_errors(df.limit(0), declared.limit(0)).count() == 0


def test_hierarchy(spark):
    rows = [("p", "a", None, "A", 1), ("p", "b", "a", "B", 1), ("p", "c", "b", " ", 3), ("p", "d", None, "D", 0), ("p", "x", "y", "X", 2), ("p", "y", "x", "Y", 3), ("q", "a", None, "A", 1)]
    got = hierarchy_errors(spark.createDataFrame(rows, "k string, section_id string, parent_id string, heading string, level int"), key="k").collect()
    assert sorted((r.error, r.subject) for r in got) == [("BLANK_HEADING", "c"), ("CIRCULAR_HIERARCHY", "x"), ("CIRCULAR_HIERARCHY", "y"), ("INVALID_HEADING_LEVEL", "d"), ("INVALID_HIERARCHY", "b"), ("INVALID_HIERARCHY", "x")]


def test_nested_sections_in_order(spark):
    df = frame(
        spark,
        block(1, "paragraph", "sections[1].children[10].blocks[0]", "late", text="4"), block(2, "paragraph", "sections[1].blocks[0]", "top", text="2"), block(3, "paragraph", "sections[1].children[2].blocks[0]", "inner", text="3"), block(4, "paragraph", "sections[0].blocks[0]", "cover", text="1"),
    )
    assert section_sequences(df).first().sections == ["cover", "top", "inner", "late"]
    titles = spark.createDataFrame([("p", "Our offer")], "proposal_id string, title string")
    references = spark.createDataFrame([("p", "r2", "Two", "s", None), ("p", "r1", "One", "", "page 3")], "proposal_id string, reference_id string, title string, source string, locator string")
    lines = render_operations(df, titles=titles, references=references, listed_in="late", breaks=("top",)).orderBy("op_ord").collect()
    assert [(r.style, r.text) for r in lines] == [
        ("proposal_title", "Our offer"), ("heading_1", "Cover"), ("body", "1"), ("page_break", ""), ("heading_1", "Top"), ("body", "2"), ("heading_2", "Inner"), ("body", "3"), ("heading_2", "Late"), ("body", "4"),
        ("body", "r1 \u2014 One \u2014 page 3"), ("body", "r2 \u2014 Two \u2014 s"),
    ]


def test_plan(spark):
    seq = lambda *r: spark.createDataFrame(list(r), "k string, sections array<string>")
    plan = seq(("same", ["a", "b"]), ("less", ["a", "b"]), ("order", ["a", "b"]), ("none", ["a"]))
    has = seq(("same", ["a", "b"]), ("less", ["b", "x"]), ("order", ["b", "a"]), ("twice", ["a", "a"]))
    got = {r.k: (r.missing, r.unexpected, r.repeated, r.in_order, r.conforms) for r in plan_conformance(plan, has, "k").collect()}
    assert got == {"same": ([], [], [], True, True), "less": (["a"], ["x"], [], True, False), "order": ([], [], [], False, False), "none": (["a"], [], [], True, False), "twice": ([], ["a"], ["a"], True, False)}
    blocks = frame(spark, block(1, "paragraph", "sections[10].blocks[0]", "late"), block(2, "paragraph", "sections[2].blocks[1]", "early"))
    assert section_sequences(blocks).first().sections == ["early", "late"]


def test_reference_groups(spark):
    rows = [("p", 2, "s", "technical", "t2", T), ("p", 1, "s", "technical", "t1", T), ("p", 3, "s", "technical", "t1", T), ("p", 1, "s", "authoring", "a", T)]
    g = grouped_references(spark.createDataFrame(rows, "proposal_id string, query_ord int, section_id string, reference_type string, reference_id string, retrieved_at timestamp"))
    assert sorted((r.reference_type, r.place, r.reference_id) for r in g.collect()) == [("authoring", 1, "a"), ("technical", 1, "t1"), ("technical", 2, "t2")]


def test_component_ids(spark):
    r = component_ids(frame(spark, block(4, "table"))).first()
    assert r.composition_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "composition:p")) and r.component_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "component:p:cover:table:4"))


def test_render_to_word_and_back(spark, tmp_path):
    df = frame(
        spark,
        block(1, "paragraph", text="A & B"), block(2, "table", headers=["h", "k"], rows=[["1", None]]), block(3, "bullet_list", "sections[1].blocks[0]", "key_points", items=["x", "y"]),
        block(4, "callout", "sections[1].blocks[1]", "key_points", label="Note", text="t"), block(5, "requirement_matrix", "sections[1].blocks[2]", "key_points", entries=[entry("1")]), block(6, "visual_placeholder", "sections[1].blocks[3]", "key_points", visual_id="v", description="d"),
    )
    lines = render_operations(df)
    assert [(r.kind, r.text) for r in lines.orderBy("op_ord").collect()] == [
        ("heading", "Cover"), ("paragraph", "A & B"), ("table_row", "h | k"), ("table_row", "1 | "), ("heading", "Key Points"), ("list_item", "x"), ("list_item", "y"), ("paragraph", "Note"), ("paragraph", "t"), ("table_row", "1 | r | a | "), ("paragraph", "d"),
    ]
    content = composed_documents(lines).first().content
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "One.DOCX").write_bytes(content)
    (tmp_path / "broken.docx").write_bytes(b"no package")
    (tmp_path / "other.txt").write_text("x")
    files = discover(spark, str(tmp_path))
    assert files.count() == 2
    blocks = read_docx(files).collect()
    assert [b.path.rsplit("/", 1)[1] for b in blocks if b.error] == ["broken.docx"]
    good = sorted((b for b in blocks if not b.error), key=lambda b: b.pos)
    assert [(b.kind, b.style, b.text) for b in good if b.kind == "paragraph"][:3] == [("paragraph", "heading 1", "Cover"), ("paragraph", "body", "A & B"), ("paragraph", "heading 1", "Key Points")]
    assert [[c.content for c in r.cells] for r in good[2].rows] == [["h", "k"], ["1", ""]] and good[2].rows[0].cells[0].cell_type == "header"
    parts = package_parts(files.filter("path like '%One%'"))
    counts = package_inventory(parts).first()
    assert counts.parts == 4 and counts.tables == 2 and counts.table_rows == 3 and counts.styles == 6


def test_equal_lines_give_equal_bytes():
    lines = [("heading", "", "T"), ("table_row", "table_header", "a | b"), ("table_row", "table_header", "c"), ("paragraph", "x", "é<")]
    assert compose_docx(lines) == compose_docx(lines)
    assert [b["kind"] for b in parse_docx(compose_docx(lines))] == ["paragraph", "table", "table", "paragraph"]


def test_markdown(spark):
    text = "x\n| a | b |\n|---|:---:|\n| 1 | 2 |\nend\na | b\nc | d\n\nq | r\n--- | ---"
    df = spark.createDataFrame([(1, text), (2, None), (3, "no | table")], "doc_id long, text string")
    assert sorted(map(tuple, markdown_tables(df).collect())) == [(1, 1, 3, 2), (1, 8, 2, 2)]
    flags = spark.createDataFrame([("a\n ## b",), ("- x",), ("a - b",), (None,)], "t string").select(has_markdown(F.col("t"))).collect()
    assert [r[0] for r in flags] == [True, True, False, False]


def test_slots(spark):
    df = spark.createDataFrame([(1,), (2,), (5,)], "n int").select(spread_slots(F.col("n"), F.lit(12)).alias("s"))
    assert [r.s for r in df.collect()] == [[0], [0, 11], [round(i * 11 / 4) for i in range(5)]]
