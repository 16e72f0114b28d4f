import random

import pytest
from pyspark.sql import functions as F

from quirestone.operators.structure import classify_sections, heading_level, is_bold, is_container_heading, layout_heading_level, looks_upper, outline, reading_order, section_tree, text_blocks, titles
from quirestone.sources.layout import page_blocks, unreadable

ELEMENT = "doc_id string, containing_section_id string, element_type string, content string"
SECTION = "doc_id string, section_id string, parent_section_id string, heading string, section_level int, sibling_ord int"


@pytest.mark.parametrize(("style", "level"), [("Heading 1", 1), (" heading 6 ", 6), ("heading +2", 2), ("Heading 7", None), ("Heading 0", None), ("Title", None), ("", None), (None, None)])
def test_heading_level(spark, style, level):
    assert spark.createDataFrame([(style,)], "s string").select(heading_level(F.col("s"))).first()[0] == level


def test_container_headings(spark):
    yes = ["Table of Contents", "Appendix 1", "Annexures", "Section D", "Chapter 1", "Part", "Form 5A", "  CONTENTS "]
    no = ["Introduction", "Conclusion", "", None, "Partner"]
    df = spark.createDataFrame([(h,) for h in yes + no], "h string")
    assert [r[0] for r in df.select(is_container_heading(F.col("h"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_layout(spark):
    rows = [("SECTION A: SUMMARY", 16.0, False, 1), ("section b", 10.0, False, 1), ("Large", 14.5, False, 1), ("Bold words", 11.5, True, 2), ("plain words", 11.5, False, None), ("X" * 161, 30.0, True, None)]
    df = spark.createDataFrame(rows, "t string, s double, b boolean, want int")
    got = df.select("want", layout_heading_level(F.col("t"), F.col("s"), F.lit(10.0), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert spark.sql("select 'ABCDe' as t, 'Arial-BoldMT' as f").select(looks_upper(F.col("t")), is_bold(F.col("f"))).first()[:] == (True, True)


def test_page_blocks(spark):
    spans = [
        ("d", 1, "text", 0.0, 100.0, 50.0, 110.0, " body \n\n text ", 10.0, False),
        ("d", 1, "text", 0.0, 10.0, 50.0, 20.0, "TITLE", 16.0, True),
        ("d", 1, "text", 60.0, 200.0, 70.0, 210.0, "in the table", 10.0, False),
        ("d", 1, "table", 50.0, 190.0, 90.0, 220.0, "A | B", None, None),
        ("d", 2, "text", 0.0, 5.0, 9.0, 9.0, "  ", 10.0, False),
    ]
    df = spark.createDataFrame(spans, "doc_id string, page_number int, kind string, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean")
    assert [(r.text, r.level) for r in page_blocks(df).orderBy("pos").collect()] == [("TITLE", 1), ("body\ntext", None), ("A | B", None)]
    files = spark.createDataFrame([("d",), ("scan",)], "path string")
    assert [r.path for r in unreadable(df, files).collect()] == ["scan"]


def test_outline_against_a_stack(spark):
    rng = random.Random(1)
    rows = [(f"d{d}", p, rng.choice([None, None, None, 1, 2, 3, 4, 5, 6]), f"t{p}") for d in range(40) for p in range(rng.randrange(40))]
    want = {}
    for d, p, level, t in rows:
        stack = want.setdefault((d, "stack"), [])
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, p, t))
        n = want.get((d, "n"), 0)
        want[(d, p)] = (stack[-1][1] if stack else None, stack[-2][1] if len(stack) > 1 else None, [s[2] for s in stack], None if level else n)
        want[(d, "n")] = n + (not level)
    got = outline(spark.createDataFrame(rows, "doc_id string, pos int, level int, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.section_pos, r.parent_pos, r.section_path, r.order_index) == want[(r.doc_id, r.pos)]


def test_text_blocks_and_titles(spark):
    df = spark.createDataFrame([(1, "intro\r\n\r\n## A  \nx\n#no heading\n####### seven"), (2, "plain"), (3, None), (4, "")], "doc_id long, text string")
    blocks = text_blocks(df)
    assert [(r.pos, r.level, r.text) for r in blocks.filter("doc_id = 1").orderBy("pos").collect()] == [(0, None, "intro"), (2, 2, "A"), (3, None, "x"), (4, None, "#no heading"), (5, None, "####### seven")]
    assert {r.doc_id: r.title for r in titles(blocks).collect()} == {1: "A", 2: "Untitled Document"}


def test_tree(spark):
    s = [("d", "a", None, "A", 1, 0), ("d", "b", "a", " ", 2, 1), ("d", "c", "b", "C", 3, 0), ("d", "e", None, "E", 1, 1), ("d", "f", "a", "F", 2, 0), ("d", "g", "nowhere", "G", 2, 5), ("x", "a", None, "other", 1, 0)]
    got = {(r.doc_id, r.section_id): (r.section_path, r.section_order) for r in reading_order(section_tree(spark.createDataFrame(s, SECTION))).collect()}
    assert got == {("d", "a"): (["A"], 1), ("d", "f"): (["A", "F"], 2), ("d", "b"): (["A"], 3), ("d", "c"): (["A", "C"], 4), ("d", "e"): (["E"], 5), ("d", "g"): (["G"], 6), ("x", "a"): (["other"], 1)}


def test_a_chain_of_twelve_and_circles(spark):
    chain = [("d", f"s{i}", f"s{i - 1}" if i else None, f"H{i}", i + 1, 0) for i in range(12)]
    circle = [("d", "x", "z", "X", 1, 3), ("d", "y", "x", "Y", 2, 0), ("d", "z", "y", "Z", 3, 0), ("d", "below", "x", "B", 2, 1), ("d", "self", "self", "S", 1, 4)]
    long_circle = [("e", f"s{i}", f"s{(i + 1) % 9}", f"H{i}", 1, i) for i in range(9)] + [("e", "under", "s0", "U", 2, 0)]
    got = {(r.doc_id, r.section_id): (r.section_path, r.cyclic) for r in section_tree(spark.createDataFrame(chain + circle + long_circle, SECTION)).collect()}
    assert all(got["d", f"s{i}"] == ([f"H{j}" for j in range(i + 1)], False) for i in range(12))
    assert all(got["d", x] == ([h], True) for x, h in (("x", "X"), ("y", "Y"), ("z", "Z"), ("below", "B"), ("self", "S")))
    assert all(got["e", f"s{i}"] == ([f"H{i}"], True) for i in range(9)) and got["e", "under"] == (["U"], True)


def test_section_types(spark):
    names = ["", "Table of Contents", "Form 3", "Signature page", "Certificate", "To be completed", "Annex B", "Parent", "Figures", "Text", "Child"]
    kinds = ["COVER_PAGE", "TABLE_OF_CONTENTS", "TEMPLATE_FORM", "SIGNATURE_PAGE", "CERTIFICATE", "PLACEHOLDER_SECTION", "CONTAINER_SECTION", "CONTAINER_SECTION", "TEMPLATE_FORM", "CONTENT_SECTION", "CONTENT_SECTION"]
    s = spark.createDataFrame([("d", str(i), "7" if n == "Child" else None, n, 1, i) for i, n in enumerate(names)], SECTION)
    e = spark.createDataFrame([("d", "8", "table", None), ("d", "9", "table", None), ("d", "9", "paragraph", "x")], ELEMENT)
    got = {int(r.section_id): r.section_type for r in classify_sections(s, e).collect()}
    assert [got[i] for i in range(len(names))] == kinds
