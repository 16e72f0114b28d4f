"""Blocks of generated documents: validation, references, order, rendering."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirestone.functions.text import is_blank, uuid5
from quirestone.operators.structure import section_tree

KINDS = ("paragraph", "callout", "requirement_matrix", "bullet_list", "table", "visual_placeholder")


def once(blocks: DataFrame) -> DataFrame:
    """Blocks that were delivered twice, once each, as they came last."""
    newest = blocks.groupBy("block_id").agg(F.max("ingested_at").alias("ingested_at"))
    return blocks.join(newest, ["block_id", "ingested_at"]).dropDuplicates(["block_id"])


def cited_references(blocks: DataFrame) -> DataFrame:
    """``proposal_id``, ``block_id``, ``reference_id`` as it is written, for every citation."""
    direct = blocks.select("proposal_id", "block_id", F.explode("reference_ids").alias("reference_id"))
    of_entries = blocks.select("proposal_id", "block_id", F.explode("entries").alias("e")).select("proposal_id", "block_id", F.explode("e.evidence_reference_ids").alias("reference_id"))
    return direct.unionByName(of_entries)


def block_errors(blocks: DataFrame) -> DataFrame:
    """``block_id`` and ``error`` for each rule that a block breaks."""
    is_ = lambda *kinds: F.col("type").isin(*kinds)
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    any_blank = lambda c: F.coalesce(F.exists(c, is_blank), F.lit(False))
    entry = lambda f: F.coalesce(F.exists("entries", lambda e: is_blank(e[f])), F.lit(False))
    ids = F.transform("entries", lambda e: e["requirement_id"])
    width = F.coalesce(F.size("headers"), F.lit(0))
    rules: list[tuple[str, Column]] = [
        ("UNKNOWN_BLOCK_TYPE", ~F.coalesce(is_(*KINDS), F.lit(False))),
        ("MISSING_TEXT", is_("paragraph", "callout") & is_blank(F.col("text"))),
        ("MISSING_LABEL", is_("callout") & is_blank(F.col("label"))),
        ("EMPTY_LIST", is_("bullet_list") & none("items")),
        ("BLANK_LIST_ITEM", is_("bullet_list") & any_blank("items")),
        ("MISSING_TABLE_HEADERS", is_("table") & none("headers")),
        ("BLANK_TABLE_HEADER", is_("table") & any_blank("headers")),
        ("MISSING_TABLE_ROWS", is_("table") & none("rows")),
        ("RAGGED_TABLE", is_("table") & F.coalesce(F.exists("rows", lambda r: F.coalesce(F.size(r), F.lit(0)) != width), F.lit(False))),
        ("MISSING_VISUAL_ID", is_("visual_placeholder") & is_blank(F.col("visual_id"))),
        ("MISSING_DESCRIPTION", is_("visual_placeholder") & is_blank(F.col("description"))),
        ("EMPTY_MATRIX", is_("requirement_matrix") & none("entries")),
        ("BLANK_MATRIX_FIELD", is_("requirement_matrix") & (entry("requirement_id") | entry("requirement") | entry("response"))),
        ("DUPLICATE_REQUIREMENT", is_("requirement_matrix") & F.coalesce(F.size(F.array_distinct(ids)) < F.size(ids), F.lit(False))),
        ("BLANK_REFERENCE", any_blank("reference_ids")),
    ]
    codes = F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]), lambda c: c.isNotNull())
    return blocks.select("block_id", F.explode(codes).alias("error"))


def section_key(path: Column) -> Column:
    """The place of a block's section as an array of numbers, one a level: it sorts sections depth first."""
    return F.transform(F.regexp_extract_all(F.substring_index(path, ".blocks[", 1), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def transport_sections(blocks: DataFrame) -> DataFrame:
    """The sections that blocks stand in: ``proposal_id``, ``place``, ``section_id``, ``parent_id`` and ``level``, its depth from 1."""
    place = section_key(F.col("path"))
    own = blocks.select("proposal_id", place.alias("place"), "section_id").distinct()
    above = own.select("proposal_id", F.col("place").alias("__up"), F.col("section_id").alias("parent_id"))
    return own.withColumn("__up", F.slice("place", F.lit(1), F.size("place") - 1)).join(above, ["proposal_id", "__up"], "left").select("proposal_id", "place", "section_id", "parent_id", F.size("place").alias("level"))


def hierarchy_errors(sections: DataFrame, *, key: str) -> DataFrame:
    """What is wrong with sections (``section_id``, ``parent_id``, ``heading``, ``level``) below each other: ``key``, ``error``, ``subject``.

    ``BLANK_SECTION_ID``, ``BLANK_HEADING``, ``INVALID_HEADING_LEVEL`` (below 1), ``INVALID_HIERARCHY`` (not deeper than its parent),
    ``DUPLICATE_SECTION`` (once an id), ``CIRCULAR_HIERARCHY`` (a section below itself).
    """
    parents = sections.groupBy(key, F.col("section_id").alias("parent_id")).agg(F.max("level").alias("__above"))
    rows = sections.join(parents, [key, "parent_id"], "left")
    rules = {
        "BLANK_SECTION_ID": is_blank(F.col("section_id")),
        "BLANK_HEADING": is_blank(F.col("heading")),
        "INVALID_HEADING_LEVEL": F.col("level") < 1,
        "INVALID_HIERARCHY": F.col("level") <= F.col("__above"),
    }
    codes = F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]), lambda c: c.isNotNull())
    broken = rows.select(key, F.explode(codes).alias("error"), F.col("section_id").alias("subject"))
    twice = sections.filter(~is_blank(F.col("section_id"))).groupBy(key, "section_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("DUPLICATE_SECTION").alias("error"), F.col("section_id").alias("subject"))
    tree = section_tree(sections.select(F.col(key).alias("doc_id"), "section_id", F.col("parent_id").alias("parent_section_id"), "heading", F.col("level").alias("section_level"), F.lit(0).alias("sibling_ord")).dropDuplicates(["doc_id", "section_id"]))
    round_ = tree.filter("cyclic").select(F.col("doc_id").alias(key), F.lit("CIRCULAR_HIERARCHY").alias("error"), F.col("section_id").alias("subject"))
    return broken.unionByName(twice).unionByName(round_)


def reference_errors(declared: DataFrame) -> DataFrame:
    """What is wrong with the references that a document declares: ``proposal_id``, ``error``, ``subject``.

    ``BLANK_REFERENCE_ID``, ``BLANK_REFERENCE_TITLE``, ``BLANK_REFERENCE_SOURCE``, and ``DUPLICATE_REFERENCE`` if an id is declared at
    several times and not deleted (a row that was delivered twice is one). Deleted references don't count.
    """
    rows = declared.filter("deleted_at is null").select("proposal_id", "reference_id", "title", "source", "declared_at").distinct()
    rules = {"BLANK_REFERENCE_ID": "reference_id", "BLANK_REFERENCE_TITLE": "title", "BLANK_REFERENCE_SOURCE": "source"}
    codes = F.filter(F.array(*[F.when(is_blank(F.col(c)), F.lit(code)) for code, c in rules.items()]), lambda c: c.isNotNull())
    broken = rows.select("proposal_id", F.explode(codes).alias("error"), F.col("reference_id").alias("subject")).distinct()
    twice = rows.filter(~is_blank(F.col("reference_id"))).groupBy("proposal_id", "reference_id").agg(F.count_distinct("declared_at").alias("n")).filter("n > 1")
    return broken.unionByName(twice.select("proposal_id", F.lit("DUPLICATE_REFERENCE").alias("error"), F.col("reference_id").alias("subject")))


def document_errors(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Rules on a whole document: ``proposal_id``, ``error``, ``subject``.

    A ``DUPLICATE_VISUAL_ID``, cited references that aren't declared (``UNKNOWN_REFERENCE``), and the errors of its declared
    references and of its sections (``reference_errors``, ``hierarchy_errors``; a section's heading is its id). Blocks come once each.
    """
    visuals = blocks.filter((F.col("type") == "visual_placeholder") & ~is_blank(F.col("visual_id"))).groupBy("proposal_id", "visual_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    of_visuals = visuals.select("proposal_id", F.lit("DUPLICATE_VISUAL_ID").alias("error"), F.col("visual_id").alias("subject"))
    unknown = undeclared_references(blocks, declared).select("proposal_id", F.lit("UNKNOWN_REFERENCE").alias("error"), F.col("reference_id").alias("subject"))
    sections = transport_sections(blocks).withColumn("heading", F.col("section_id"))
    return reduce(DataFrame.unionByName, [of_visuals, unknown, reference_errors(declared), hierarchy_errors(sections, key="proposal_id")])


def undeclared_references(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Distinct ``proposal_id`` and ``reference_id`` that blocks cite and that were never declared, as written."""
    return cited_references(blocks).filter(~is_blank(F.col("reference_id"))).select("proposal_id", "reference_id").distinct().join(declared.select("proposal_id", "reference_id").distinct(), ["proposal_id", "reference_id"], "left_anti")


def plan_conformance(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """How the sections of a document (array ``sections``, in order) differ from the plan's.

    ``missing``, ``unexpected`` and ``repeated`` (arrays, sorted), ``in_order`` (the sections of both come in the
    same order) and ``conforms``.
    """
    both = expected.select(key, F.col("sections").alias("plan")).join(actual.select(key, F.col("sections").alias("has")), key, "full")
    none = F.array().cast("array<string>")
    both = both.withColumns({"plan": F.coalesce("plan", none), "has": F.coalesce("has", none)})
    repeated = F.array_distinct(F.filter("has", lambda s: F.size(F.filter(F.col("has"), lambda x: x == s)) > 1))
    shared = lambda a, b: F.filter(F.array_distinct(a), lambda s: F.array_contains(b, s))
    out = both.select(
        key,
        F.array_sort(F.array_except("plan", "has")).alias("missing"),
        F.array_sort(F.array_except("has", "plan")).alias("unexpected"),
        F.array_sort(repeated).alias("repeated"),
        (shared(F.col("plan"), F.col("has")) == shared(F.col("has"), F.col("plan"))).alias("in_order"),
    )
    return out.withColumn("conforms", (F.size("missing") + F.size("unexpected") + F.size("repeated") == 0) & F.col("in_order"))


def section_sequences(blocks: DataFrame) -> DataFrame:
    """``proposal_id`` and ``sections``: the sections of a document, those below others too, depth first; one that comes again is there again."""
    rows = transport_sections(blocks)
    return rows.groupBy("proposal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "section_id"))), lambda x: x["section_id"]).alias("sections"))


def grouped_references(references: DataFrame) -> DataFrame:
    """References of each section by type, each once, in the order in which they were first retrieved.

    ``proposal_id``, ``section_id``, ``reference_type``, ``place`` (from 1) and ``reference_id``; rows, as
    a group may be of any size.
    """
    first = references.groupBy("proposal_id", "section_id", "reference_type", "reference_id").agg(F.min(F.struct("query_ord", "retrieved_at")).alias("at"))
    order = Window.partitionBy("proposal_id", "section_id", "reference_type").orderBy("at", "reference_id")
    return first.select("proposal_id", "section_id", "reference_type", F.row_number().over(order).alias("place"), "reference_id")


def component_ids(blocks: DataFrame) -> DataFrame:
    """Name-based UUIDs of the parts of a document: of the composition, the section and the block."""
    ns = uuid.NAMESPACE_URL
    return blocks.select(
        "block_id",
        uuid5(ns, F.concat(F.lit("composition:"), F.col("proposal_id"))).alias("composition_id"),
        uuid5(ns, F.concat_ws(":", F.lit("component"), "proposal_id", "section_id", F.lit("heading"))).alias("section_component_id"),
        uuid5(ns, F.concat_ws(":", F.lit("component"), "proposal_id", "section_id", "type", F.col("ord").cast("string"))).alias("component_id"),
    )


def render_operations(blocks: DataFrame, *, titles: DataFrame | None = None, references: DataFrame | None = None, cover: str = "cover", listed_in: str = "references", breaks: Sequence[str] = ()) -> DataFrame:
    """Lines of a document in order: ``proposal_id``, ``op_ord``, ``kind``, ``style``, ``text``.

    Each section begins with its heading, of the style of its depth, those below others after the blocks of these; tables give a
    line a row, lists a line an item, matrices a line an entry. Sections named in ``breaks`` begin on a new page. ``titles``
    (``proposal_id``, ``title``) are printed above the section ``cover``, ``references`` (``proposal_id``, ``reference_id``, ``title``, ``source``,
    ``locator``) after the blocks of the section ``listed_in``.
    """
    cells = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    line = lambda kind, style, text: F.struct(F.lit(kind).alias("kind"), (style if isinstance(style, Column) else F.lit(style)).alias("style"), text.alias("text"))
    one = lambda kind, style, text: F.array(line(kind, style, text))
    many = lambda kind, style, texts: F.transform(texts, lambda t: line(kind, style, t))
    evidence = lambda e: F.array_join(e["evidence_reference_ids"], ", ")
    lines = (
        F.when(F.col("type") == "paragraph", one("paragraph", "body", F.col("text")))
        .when(F.col("type") == "callout", F.array(line("paragraph", "callout", F.col("label")), line("paragraph", "callout", F.col("text"))))
        .when(F.col("type") == "bullet_list", many("list_item", "bullet", F.col("items")))
        .when(F.col("type") == "table", F.concat(one("table_row", "table_header", cells(F.col("headers"))), many("table_row", "table_cell", F.transform("rows", cells))))
        .when(F.col("type") == "requirement_matrix", many("table_row", "requirement_matrix", F.transform("entries", lambda e: F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in (e["requirement_id"], e["requirement"], e["response"], evidence(e))]))))
        .when(F.col("type") == "visual_placeholder", one("paragraph", "body", F.col("description")))
    )
    at = section_key(F.col("path")).alias("section_at")
    placed = blocks.select("proposal_id", at, "section_id", F.col("ord").alias("block_at"), "block_id", lines.alias("lines"))
    rows = placed.select("proposal_id", "section_at", "section_id", F.lit(1).alias("part"), "block_at", "block_id", F.posexplode("lines").alias("line_at", "line"))
    own = blocks.select("proposal_id", at, "section_id").distinct()
    opening = F.concat(
        F.when(F.col("section_id").isin(*breaks), one("page_break", "page_break", F.lit(""))).otherwise(F.array().cast(_LINES)) if breaks else F.array().cast(_LINES),
        one("heading", F.concat(F.lit("heading_"), F.size("section_at").cast("string")), F.initcap(F.translate("section_id", "_", " "))),
    )
    if titles is not None:
        own = own.join(titles.select("proposal_id", "title"), "proposal_id", "left")
        opening = F.concat(F.when((F.col("section_id") == cover) & F.col("title").isNotNull(), one("paragraph", "proposal_title", F.col("title"))).otherwise(F.array().cast(_LINES)), opening)
    placeless = lambda part: (F.lit(part).alias("part"), F.lit(0).alias("block_at"), F.lit(0).cast("long").alias("block_id"))
    all_ = [rows, own.select("proposal_id", "section_at", "section_id", *placeless(0), F.posexplode(opening).alias("line_at", "line"))]
    if references is not None:
        full = lambda c: F.nullif(F.col(c), F.lit(""))
        text = F.concat_ws(" \u2014 ", *map(full, ("reference_id", "title", "source", "locator")))
        place = F.row_number().over(Window.partitionBy("proposal_id").orderBy("reference_id", "text"))
        printed = references.select("proposal_id", "reference_id", text.alias("text")).withColumn("line_at", place)
        ends = own.filter(F.col("section_id") == listed_in).select("proposal_id", "section_at", "section_id")
        all_.append(ends.join(printed, "proposal_id").select("proposal_id", "section_at", "section_id", *placeless(2), "line_at", line("paragraph", "body", F.col("text")).alias("line")))
    order = Window.partitionBy("proposal_id").orderBy("section_at", "section_id", "part", "block_at", "block_id", "line_at")
    return reduce(DataFrame.unionByName, all_).select("proposal_id", F.row_number().over(order).alias("op_ord"), "line.kind", "line.style", F.coalesce("line.text", F.lit("")).alias("text"))


_LINES = "array<struct<kind:string,style:string,text:string>>"


def markdown_tables(documents: DataFrame) -> DataFrame:
    """Markdown tables in texts: ``doc_id``, ``first_line``, ``lines``, ``columns``.

    A table is a line with two or more cells, below it a line of dashes, and all lines with cells that follow.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    lines = lines.withColumn("columns", F.when(F.col("line").contains("|") & (F.size(cells) >= 2), F.size(cells)))
    lines = lines.withColumn("rule", F.col("columns").isNotNull() & F.forall(cells, lambda c: c.rlike(r"^:?-{3,}:?$")))
    order = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("head", F.col("columns").isNotNull() & ~F.col("rule") & F.coalesce(F.lead("rule").over(order), F.lit(False)))
    # a run of table lines ends at any other line; a head begins a new table inside it
    island = F.sum((F.col("columns").isNull() | F.col("head")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = lines.withColumn("island", island).filter("columns is not null").groupBy("doc_id", "island").agg(
        F.min("pos").alias("first_line"), F.count(F.lit(1)).alias("lines"), F.min_by("columns", "pos").alias("columns"), F.min_by("head", "pos").alias("is_table")
    )
    return runs.filter("is_table").drop("island", "is_table")


def spread_slots(count: Column, slots: Column) -> Column:
    """Places of ``count`` items in ``slots`` slots, evenly, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(count == 1, F.lit(0)).otherwise(F.bround(i * (slots - 1) / (count - 1)).cast("int")))


def has_markdown(text: Column) -> Column:
    """Whether a line begins like a Markdown heading or list."""
    return F.coalesce(text.rlike(r"(?m)^\s{0,3}(?:#{1,6}|[-*])\s+"), F.lit(False))
