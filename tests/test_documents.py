import random
import uuid

from pyspark.sql import functions as F

from quirestone.operators.chunk import char_spans, chunk_elements, chunks
from quirestone.operators.elements import rendered
from quirestone.operators.enrich import chunk_id, embedding_text, enriched, payload
from quirestone.operators.validate import document_findings, element_findings, section_findings, statistics, verdicts

CELL = "struct<content:string,cell_type:string,column_index:int>"
ELEMENT = (
    "doc_id string, element_id string, section_id string, containing_section_id string, order_index int, element_type string, content string, "
    f"rows array<struct<row_index:int,cells:array<{CELL}>>>, caption string, alt_text string, list_type string, items array<struct<content:string,level:int>>, source_file string, source_document string, extra int"
)
SECTION = "doc_id string, section_id string, parent_section_id string, heading string, section_level int, sibling_ord int"


def uid(n):
    return str(uuid.UUID(int=n))


def element(n, kind="paragraph", at=None, section="s", doc="d", **more):
    base = dict.fromkeys(x.split()[0] for x in ("content caption alt_text list_type rows items source_document extra").split())
    known = {"doc_id": doc, "element_id": uid(n), "section_id": section, "containing_section_id": section, "order_index": n if at is None else at, "element_type": kind, "source_file": "f"}
    return base | known | more


def table(*rows):
    return [{"row_index": i, "cells": [{"content": c, "cell_type": "data", "column_index": j} for j, c in enumerate(r)]} for i, r in enumerate(rows)]


def frames(spark, elements, sections=()):
    return spark.createDataFrame(elements, ELEMENT), spark.createDataFrame(list(sections), SECTION)


def texts(spark, elements, sections, **more):
    got = chunks(chunk_elements(*frames(spark, elements, sections)), **more).orderBy("doc_id", "chunk_index").collect()
    return [(r.order_start, r.order_end, r.text) for r in got], got


def test_one_section(spark):
    got, rows = texts(spark, [element(0, content="First paragraph"), element(1, content="Second paragraph")], [("d", "s", None, "Introduction", 1, 0)], chunk_size=50, overlap_ratio=0.0)
    assert got == [(0, 1, "Introduction\n\nFirst paragraph\n\nSecond paragraph")]
    assert rows[0].section_path == ["Introduction"] and rows[0].is_first_chunk and rows[0].is_last_chunk and rows[0].token_count == 5


def test_tables_are_whole(spark):
    e = [element(0, content="Before the table"), element(1, "table", rows=table("AB", "CD")), element(2, content="After the table")]
    got, rows = texts(spark, e, [("d", "s", None, "T", 1, 0)], chunk_size=100)
    assert [(a, b) for a, b, _ in got] == [(0, 0), (1, 1), (2, 2)] and got[1][2] == "T\n\nA | B\nC | D" and [r.element_type for r in rows] == ["paragraph", "table", "paragraph"]


def test_overlap(spark):
    e = [element(i, content=t) for i, t in enumerate(["Alpha Beta", "Gamma Delta", "Epsilon Zeta"])]
    got, _ = texts(spark, e, [("d", "s", None, "Overlap", 1, 0)], chunk_size=5, overlap_ratio=0.2)
    assert got == [(0, 1, "Overlap\n\nAlpha Beta\n\nGamma Delta"), (1, 2, "Overlap\n\nGamma Delta\n\nEpsilon Zeta")]


def packed(items, heading, size, budget):
    """(first, last) of each chunk; items are (tokens, is_table)."""
    out, block, tokens, fresh = [], [], heading, False
    for i, (n, is_table) in enumerate(items):
        if is_table:
            if block and fresh:
                out.append((block[0], block[-1]))
            out.append((i, i))
            block, tokens, fresh = [], heading, False
            continue
        if block and tokens + n > size:
            out.append((block[0], block[-1]))
            tail = []
            while len(tail) < len(block) and sum(items[j][0] for j in tail) < budget:
                tail.insert(0, block[-1 - len(tail)])
            block, tokens = tail, heading + sum(items[j][0] for j in tail)
        block.append(i)
        tokens += n
        fresh = True
    if block and fresh:
        out.append((block[0], block[-1]))
    return out


def test_packing_against_a_restatement(spark):
    rng = random.Random(4)
    elements, want = [], {}
    for s in range(60):
        items = [(rng.choice([0, 1, 5, 20, 60]), rng.random() < 0.1) for _ in range(rng.randrange(1, 25))]
        doc = f"d{s:02}"
        for i, (n, is_table) in enumerate(items):
            more = {"rows": table(["w"] * n)} if is_table and n else {"rows": []} if is_table else {"content": " ".join(["w"] * n)}
            elements.append(element(s * 100 + i, "table" if is_table else "paragraph", at=i, section=None, doc=doc, **more))
        want[doc] = packed(items, 0, 50, 10)
    got = {}
    for r in chunks(chunk_elements(*frames(spark, elements)), chunk_size=50, overlap_ratio=0.2).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.order_start, r.order_end))
    assert got == want


def test_delivered_twice_empty_and_spans(spark):
    e = [element(0, content="ab"), element(0, content="ab"), element(1, content=None), element(2, content="cd")]
    rows = chunk_elements(*frames(spark, e, [("d", "s", None, "H", 1, 0)]))
    assert [(r.char_start, r.char_end) for r in char_spans(rows).orderBy("char_start").collect()] == [(3, 5), (7, 7), (9, 11)]
    assert chunks(rows).first().text == "H\n\nab\n\ncd"
    assert chunks(chunk_elements(*frames(spark, []))).count() == 0


def test_rendered(spark):
    items = [{"content": " a ", "level": 0}, {"content": None, "level": 1}]
    e = [
        element(0, content=" kept "), element(1, "image", caption=" c ", alt_text="x"), element(2, "image", caption=" ", alt_text=" x"), element(3, "image"),
        element(4, "list", list_type="ordered", items=items), element(5, "list", list_type="checklist", items=items), element(6, "list", items=None), element(7, "table", rows=table([" A ", None])),
    ]
    got = [r[0] for r in frames(spark, e)[0].orderBy("order_index").select(rendered()).collect()]
    assert got == [" kept ", "c", "x", "[Image]", "1. a\n2. ", "- [ ] a\n- [ ] ", "", "A | "]


def test_enrichment(spark):
    import hashlib

    e = [element(0, content="Body  text"), element(1, "table", rows=table("AB"))]
    c = chunks(chunk_elements(*frames(spark, e, [("d", "p", None, "Parent Area", 1, 0), ("d", "s", "p", "Component Inventory", 2, 0)])))
    points = payload(enriched(c, spark.createDataFrame([("d", "Arbitrary Technical Document")], "doc_id string, title string"))).orderBy("chunk_index").collect()
    assert points[1].embedding_text == "Document: Arbitrary Technical Document\nSection Path: Parent Area > Component Inventory\nElement Type: table\n\nA | B"
    assert points[0].original_text == "Parent Area\nComponent Inventory\n\nBody  text"
    norm = "Parent Area Component Inventory Body text"
    assert points[0].chunk_id == hashlib.sha256(f"ds0{norm}".encode()).hexdigest() and points[0].content_hash == hashlib.sha256(norm.encode()).hexdigest()
    null = spark.sql("select cast(null as string) as s").select(chunk_id(F.lit("d"), F.col("s"), F.lit(1), F.lit("x")), embedding_text(F.col("s"), F.array().cast("array<string>"), F.lit("paragraph"), F.lit("x"))).first()
    assert null[0] == hashlib.sha256(b"d1x").hexdigest() and null[1] == "Element Type: paragraph\n\nx"


def in_order(findings):
    return sorted(findings, key=lambda x: tuple(v or "" for v in x))


def codes(df):
    return in_order((r.code, r.subject_id, r.detail) for r in df.collect())


def test_document_rules(spark):
    docs = spark.createDataFrame([("1", "t", "s", "en"), ("2", " ", "", "en"), ("3", None, None, None), ("4", "t", "s", "")], "doc_id string, title string, source string, lang string")
    assert [(c, s) for c, s, _ in codes(document_findings(docs))] == [("MISSING_DOCUMENT_TITLE", "2"), ("MISSING_DOCUMENT_TITLE", "3"), ("MISSING_LANGUAGE", "4"), ("MISSING_METADATA", "3"), ("MISSING_SOURCE", "2")]


def test_element_rules(spark):
    s = uid(1000)
    good = {"section": s, "content": "x"}
    e = [
        element(1, **good),
        element(2, **good) | {"element_id": "no-uuid"},
        element(3, **good, at=-1),
        element(4, **good) | {"source_file": " "},
        element(5, **good) | {"section_id": None},
        element(6, **good) | {"section_id": uid(1001)},
        element(7, **good) | {"containing_section_id": None},
        element(8, section=None, content=" "),
        element(9, "table", section=s, rows=[]),
        element(10, "table", section=s, rows=table("AB", "C", "DE")),
        element(11, "image", section=s),
        element(12, "list", section=s, items=[]),
        element(13, **good),
        element(13, **good, at=14),
        element(15, **good, at=1),
        element(1000, **good, at=16),
        element(17, content="x", section=None) | {"section_id": uid(2000)},
    ]
    frame, sections = frames(spark, e, [("d", s, None, "S", 1, 0)])
    assert codes(element_findings(frame, sections)) == in_order(
        [
            ("INVALID_ELEMENT_ID", "no-uuid", None), ("INVALID_ORDER_INDEX", uid(3), None), ("MISSING_SOURCE_FILE", uid(4), None), ("MISSING_SECTION_ID", uid(5), None), ("ORPHAN_SECTION_REFERENCE", uid(5), None),
            ("MISMATCHED_SECTION_ID", uid(6), uid(1001)), ("ORPHAN_SECTION_REFERENCE", uid(6), uid(1001)), ("UNEXPECTED_SECTION_ID", uid(7), s), ("EMPTY_PARAGRAPH", uid(8), None), ("EMPTY_TABLE", uid(9), None),
            ("TABLE_INCONSISTENT_COLUMNS", uid(10), "1"), ("MISSING_ALT_TEXT", uid(11), None), ("EMPTY_LIST", uid(12), None), ("DUPLICATE_ELEMENT_UUID", uid(13), None), ("DUPLICATE_ORDER_INDEX", None, "1"),
            ("CONFLICTING_UUID", s, None), ("UNEXPECTED_SECTION_ID", uid(17), uid(2000)), ("ORPHAN_SECTION_REFERENCE", uid(17), uid(2000)),
        ]
    )
    declared = frame.withColumn("declared_doc_id", F.when(F.col("element_id") == uid(1), "other").otherwise(F.col("doc_id")))
    assert [c for c in codes(element_findings(declared, sections)) if c[0] == "MISMATCHED_DOCUMENT_ID"] == [("MISMATCHED_DOCUMENT_ID", uid(1), None)]


def test_section_rules(spark):
    s = [
        ("d", uid(1), None, "Cover", 1, 0), ("d", uid(2), None, " ", 2, 1), ("d", uid(3), uid(2), "Deep", 5, 0), ("d", uid(4), uid(3), "Same", 5, 0), ("d", uid(5), None, "Annex A", 1, 2),
        ("d", uid(6), None, "Empty", 1, 3), ("d", uid(7), None, "Full", 7, 4), ("d", "bad", None, "Bad", 1, 5), ("d", uid(8), uid(7), "Three", 9, 0),
    ]
    e, sections = frames(spark, [element(50, section=uid(7), content="x"), element(51, section=uid(4), content="x"), element(52, section=uid(8), content="x")], s)
    assert sorted((c, x) for c, x, _ in codes(section_findings(sections, e))) == sorted(
        [("INVALID_SECTION_ID", "bad"), ("EMPTY_SECTION_HEADING", uid(2)), ("INVALID_SECTION_LEVEL", uid(7)), ("INVALID_SECTION_LEVEL", uid(8)), ("BROKEN_SECTION_HIERARCHY", uid(4)),
         ("TOP_LEVEL_SECTION_NOT_LEVEL_1", uid(2)), ("TOP_LEVEL_SECTION_NOT_LEVEL_1", uid(7)), ("SECTION_LEVEL_GAP", uid(3)), ("EMPTY_SECTION", uid(6))]
    )
    v = {r.doc_id: (r.errors, r.warnings, r.is_valid) for r in verdicts(section_findings(sections, e), spark.createDataFrame([("d",), ("clean",)], "doc_id string")).collect()}
    assert v == {"d": (5, 4, False), "clean": (0, 0, True)}
    assert statistics(e, sections).first().asDict() == {"doc_id": "d", "elements": 3, "element_ids": 3, "order_indices": 3, "paragraphs": 3, "tables": 0, "images": 0, "lists": 0, "sections": 9, "deepest_level": 9}


def test_sections_stay_together_whatever_join_is_chosen(spark, tmp_path):
    """Tables of several files, of which the smaller turns out small enough to be sent to all tasks."""
    rng = random.Random(7)
    e = [element(d * 1000 + s * 100 + i, section=f"s{d}-{s}", doc=f"d{d}", content=" ".join(["w"] * rng.randrange(1, 40))) for d in range(30) for s in range(4) for i in range(12)]
    sections = [(f"d{d}", f"s{d}-{s}", None, "H", 1, s) for d in range(30) for s in range(4)]
    rng.shuffle(e)
    frame, tree = frames(spark, e, sections)
    frame.repartition(7).write.parquet(str(tmp_path / "e"))
    tree.repartition(3).write.parquet(str(tmp_path / "s"))
    got = chunks(chunk_elements(spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "s"))), chunk_size=50)
    seen = {}
    for r in got.orderBy("doc_id", "chunk_index").collect():
        seen.setdefault((r.doc_id, r.section_id), []).append((r.order_start % 100, r.order_end % 100))
    by = {}
    for x in sorted(e, key=lambda x: x["element_id"]):
        by.setdefault((x["doc_id"], x["section_id"]), []).append((len(x["content"].split()), False))
    assert seen == {k: packed(v, 1, 50, 5) for k, v in by.items()}
