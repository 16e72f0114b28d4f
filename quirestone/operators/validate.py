"""Structural validation: all rules on a row in one pass, and rules on ids by one grouping of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirestone.functions.text import is_blank, trim_ws
from quirestone.operators.structure import is_container_heading
from quirestone.session import written

_UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
ERROR, WARNING = "error", "warning"


_FINDING = "array<struct<code:string,severity:string,subject_id:string,detail:string>>"


def _one(code: str, severity: str, subject: Column | None, detail: Column | None = None) -> Column:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text(subject).alias("subject_id"), text(detail).alias("detail"))


def _findings(df: DataFrame, rules: list[tuple], more: Column | None = None) -> DataFrame:
    """All rules on each row in one pass; ``rules`` are of where, code, severity, subject and detail, ``more`` an array of findings."""
    found = F.filter(F.array(*[F.when(where, _one(*what)) for where, *what in rules]), lambda f: f.isNotNull())
    if more is not None:
        found = F.concat(found, F.coalesce(more, F.array().cast(_FINDING)))
    return df.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(found).alias("f")).select("doc_id", "f.*")


def document_findings(documents: DataFrame) -> DataFrame:
    """Rules on ``doc_id``, ``title``, ``source`` and ``lang``."""
    none = F.col("title").isNull() & F.col("source").isNull() & F.col("lang").isNull()
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    id_ = F.col("doc_id")
    return _findings(
        documents,
        [
            (is_blank(F.col("title")), "MISSING_DOCUMENT_TITLE", ERROR, id_),
            (none, "MISSING_METADATA", ERROR, id_),
            (~none & empty("source"), "MISSING_SOURCE", WARNING, id_),
            (~none & empty("lang"), "MISSING_LANGUAGE", WARNING, id_),
        ],
    )


def _is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(_UUID), F.lit(False))


def id_facts(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """What is known of each id and each place of a document, written as a table.

    ``doc_id``, ``kind`` (``id`` or ``place``), ``key``, and how many ``elements`` with a UUID and ``sections`` have it, how many
    elements it ``holds``, how many sections stand ``below`` it, and its section's ``level``. One pass over either table, and
    one shuffle, combined before.
    """
    mark = lambda kind, key, **n: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), *[n.get(c, F.lit(0)).cast("int").alias(c) for c in ("elements", "sections", "holds", "below", "level")])
    one, good = F.lit(1), _is_uuid(F.col("element_id"))
    of_elements = F.array(
        F.when(good, mark("id", F.col("element_id"), elements=one)),
        F.when(good & (F.col("order_index") >= 0), mark("place", F.col("order_index"), elements=one)),
        F.when(F.col("containing_section_id").isNotNull(), mark("id", F.col("containing_section_id"), holds=one)),
    )
    of_sections = F.array(
        mark("id", F.col("section_id"), sections=one, level=F.col("section_level")),
        F.when(F.col("parent_section_id").isNotNull(), mark("id", F.col("parent_section_id"), below=one)),
    )
    each = lambda df, marks: df.select("doc_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select("doc_id", "m.*")
    all_ = each(elements, of_elements).unionByName(each(sections, of_sections)).dropna(subset=["key"])
    sums = [F.sum(c).alias(c) for c in ("elements", "sections", "holds", "below")]
    return written(all_.groupBy("doc_id", "kind", "key").agg(*sums, F.max("level").alias("level")), "facts")


def element_findings(elements: DataFrame, sections: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Rules on elements and on where they say they stand.

    An element stands in ``containing_section_id`` (null: in the root) and names ``section_id``. Rows
    whose id is no UUID get that finding only. ``declared_doc_id``, if there is one, is the document that
    an element names; ``doc_id`` the one that holds it. ``facts`` are those of ``id_facts``.
    """
    facts = id_facts(elements, sections) if facts is None else facts
    id_, names, inside = F.col("element_id"), F.col("section_id"), F.col("containing_section_id").isNotNull()
    good = _is_uuid(id_)
    paragraph, table, image, list_ = (F.col("element_type") == t for t in ("paragraph", "table", "image", "list"))
    rules = [
        (F.col("order_index").isNull() | (F.col("order_index") < 0), "INVALID_ORDER_INDEX", ERROR, id_),
        (is_blank(F.col("source_file")), "MISSING_SOURCE_FILE", WARNING, id_),
        (inside & names.isNull(), "MISSING_SECTION_ID", ERROR, id_),
        (inside & (names != F.col("containing_section_id")), "MISMATCHED_SECTION_ID", ERROR, id_, names),
        (~inside & names.isNotNull(), "UNEXPECTED_SECTION_ID", ERROR, id_, names),
        (paragraph & is_blank(F.col("content")), "EMPTY_PARAGRAPH", WARNING, id_),
        (table & (F.coalesce(F.size("rows"), F.lit(0)) <= 0), "EMPTY_TABLE", ERROR, id_),
        (image & is_blank(F.col("alt_text")), "MISSING_ALT_TEXT", WARNING, id_),
        (list_ & (F.coalesce(F.size("items"), F.lit(0)) <= 0), "EMPTY_LIST", ERROR, id_),
        (inside & ~names.eqNullSafe(F.col("containing_section_id")), "ORPHAN_SECTION_REFERENCE", ERROR, id_, names),
    ]
    if "declared_doc_id" in elements.columns:
        rules.append((~F.col("declared_doc_id").eqNullSafe(F.col("doc_id")), "MISMATCHED_DOCUMENT_ID", ERROR, id_))
    width = F.size(F.col("rows")[0]["cells"])
    uneven = F.transform("rows", lambda row, i: F.when((i > 0) & (F.size(row["cells"]) != width), _one("TABLE_INCONSISTENT_COLUMNS", WARNING, id_, i)))
    of_rows = _findings(elements, [(good & where, *what) for where, *what in rules] + [(~good, "INVALID_ELEMENT_ID", ERROR, id_)], F.when(good & table, F.filter(uneven, lambda f: f.isNotNull())))
    key, of_ids = F.col("key"), F.col("kind") == "id"
    of_facts = _findings(
        facts,
        [
            (of_ids & (F.col("elements") > 1), "DUPLICATE_ELEMENT_UUID", ERROR, key),
            (~of_ids & (F.col("elements") > 1), "DUPLICATE_ORDER_INDEX", ERROR, None, key),
            (of_ids & (F.col("elements") > 0) & (F.col("sections") > 0), "CONFLICTING_UUID", ERROR, key),
        ],
    )
    known = facts.filter("kind = 'id' and sections > 0").select("doc_id", F.col("key").alias("section_id"))
    rooted = elements.filter(~inside & names.isNotNull() & good).join(known, ["doc_id", "section_id"], "left_anti")
    return of_rows.unionByName(of_facts).unionByName(_findings(rooted, [(F.lit(True), "ORPHAN_SECTION_REFERENCE", ERROR, id_, names)]))


def section_findings(sections: DataFrame, elements: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Rules on sections and their order below each other; ``facts`` are those of ``id_facts``."""
    facts = id_facts(elements, sections) if facts is None else facts
    ids = facts.filter("kind = 'id'")
    own = ids.select("doc_id", F.col("key").alias("section_id"), F.col("holds").alias("__holds"), F.col("below").alias("__below"))
    above = ids.filter("sections > 0").select("doc_id", F.col("key").alias("parent_section_id"), F.col("level").alias("__above"))
    first = F.min(F.when(F.col("parent_section_id").isNull(), F.col("sibling_ord"))).over(Window.partitionBy("doc_id"))
    rows = sections.join(own, ["doc_id", "section_id"], "left").join(above, ["doc_id", "parent_section_id"], "left").withColumn("__first", first)
    id_, level, over = F.col("section_id"), F.col("section_level"), F.col("__above")
    good, child = _is_uuid(id_), F.col("parent_section_id").isNotNull()
    h = F.coalesce(F.lower(trim_ws(F.col("heading"))), F.lit(""))
    cover = ~child & (F.col("sibling_ord") == F.col("__first")) & ((h == "") | h.contains("title") | h.contains("cover"))
    empty = (F.coalesce("__holds", F.lit(0)) == 0) & (F.coalesce("__below", F.lit(0)) == 0)
    rules = [
        (is_blank(F.col("heading")), "EMPTY_SECTION_HEADING", ERROR, id_),
        ((level < 1) | (level > 6), "INVALID_SECTION_LEVEL", ERROR, id_, level),
        (child & (level <= over), "BROKEN_SECTION_HIERARCHY", ERROR, id_, level),
        (~child & (level != 1), "TOP_LEVEL_SECTION_NOT_LEVEL_1", WARNING, id_, level),
        (child & (level > over + 2), "SECTION_LEVEL_GAP", WARNING, id_, level),
        (empty & ~F.coalesce(cover, F.lit(False)) & ~is_container_heading(F.col("heading")), "EMPTY_SECTION", WARNING, id_),
    ]
    return _findings(rows, [(good & where, *what) for where, *what in rules] + [(~good, "INVALID_SECTION_ID", ERROR, id_)])


def library_findings(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Rules on elements and on sections, which share the pass over ids."""
    facts = id_facts(elements, sections)
    return element_findings(elements, sections, facts).unionByName(section_findings(sections, elements, facts))


def verdicts(findings: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``doc_id``, ``errors``, ``warnings``, ``is_valid`` and ``verdict`` (PASS, WARNINGS or FAIL) of every document, with findings or not."""
    counted = findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings"))
    joined = doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(counted, "doc_id", "left")
    errors, warnings = F.coalesce("errors", F.lit(0)), F.coalesce("warnings", F.lit(0))
    verdict = F.when(errors > 0, "FAIL").when(warnings > 0, "WARNINGS").otherwise("PASS")
    return joined.select("doc_id", errors.alias("errors"), warnings.alias("warnings"), (errors == 0).alias("is_valid"), verdict.alias("verdict"))


def statistics(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Counts of every document: elements by type, distinct ids and places, sections."""
    types = ("paragraph", "table", "image", "list")
    of_elements = elements.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("elements"),
        F.count_distinct("element_id").alias("element_ids"),
        F.count_distinct("order_index").alias("order_indices"),
        *[F.count_if(F.col("element_type") == t).alias(f"{t}s") for t in types],
    )
    of_sections = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.max("section_level").alias("deepest_level"))
    return of_elements.join(of_sections, "doc_id", "full").na.fill(0)
