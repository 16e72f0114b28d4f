"""Document structure: headings, section paths and reading order."""

from __future__ import annotations

from uuid import NAMESPACE_URL

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirestone.functions.text import is_blank, trim_ws, uuid5
from quirestone.session import written

LEVELS = range(1, 7)


def heading_level(style: Column) -> Column:
    """1 to 6 for a paragraph style named "Heading N", else null."""
    return F.nullif(F.regexp_extract(F.lower(trim_ws(style)), r"^heading\s+\+?0*([1-6])$", 1), F.lit("")).cast("int")


def looks_upper(text: Column) -> Column:
    """At most 160 characters, and at least four of five letters are capitals."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (F.length(text) <= 160) & (letters > 0) & (F.regexp_count(text, F.lit(r"\p{Lu}")) >= letters * 0.8)


def layout_heading_level(text: Column, size: Column, body_size: Column, bold: Column) -> Column:
    """Heading level of a text block from its font: 1, 2 or null."""
    named = F.lower(trim_ws(text)).rlike(r"^(section|chapter|appendix|form)\b")
    return (
        F.when(F.length(text) > 160, None)
        .when(named | looks_upper(text), 1)
        .when(size >= body_size * 1.45, 1)
        .when(bold & (size >= body_size * 1.15), 2)
        .cast("int")
    )


def is_bold(font: Column) -> Column:
    """Whether the name of a font says that it is bold."""
    return F.lower(font).rlike("bold|black|demi")


def body_sizes(spans: DataFrame) -> DataFrame:
    """Median of the positive font sizes of each page: ``doc_id``, ``page_number``, ``body_size``."""
    return spans.filter("size > 0").groupBy("doc_id", "page_number").agg(F.median("size").alias("body_size"))


def text_blocks(documents: DataFrame) -> DataFrame:
    """Lines of text documents: ``doc_id``, ``pos``, ``level`` (of a heading, else null), ``text``.

    A heading is a line with one to six number signs and white space before its text. Blank lines are dropped.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line")).filter(~is_blank(F.col("line")))
    marks = F.regexp_extract("line", r"^(#{1,6})[ \t]+\S", 1)
    return lines.select(
        "doc_id",
        "pos",
        F.when(marks != "", F.length(marks)).alias("level"),
        F.when(marks != "", trim_ws(F.regexp_replace("line", r"^#{1,6}", ""))).otherwise(F.col("line")).alias("text"),
    )


def outline(blocks: DataFrame) -> DataFrame:
    """Give every block the section it stands in.

    Adds ``section_pos`` (position of the innermost open heading, null before the first),
    ``parent_pos``, ``section_path`` and ``order_index``, the number of blocks before it in the
    document that aren't headings (null for headings). A heading of level k is open until one of level k or less
    follows; so the last heading of each level counts if it is newer than those of all lower levels.
    """
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in LEVELS:
        blocks = blocks.withColumn(f"__h{k}", F.last(F.when(F.col("level") == k, F.struct("pos", "text")), ignorenulls=True).over(order))
    newest, open_ = F.lit(-1), []
    for k in LEVELS:
        at = F.coalesce(F.col(f"__h{k}.pos"), F.lit(-1))
        open_.append(F.when(at > newest, F.col(f"__h{k}")))
        newest = F.greatest(newest, at)
    blocks = blocks.withColumn("__open", F.filter(F.array(*open_), lambda h: h.isNotNull()))
    return blocks.select(
        "doc_id",
        "pos",
        "level",
        "text",
        F.try_element_at("__open", F.lit(-1))["pos"].alias("section_pos"),
        F.try_element_at("__open", F.lit(-2))["pos"].alias("parent_pos"),
        F.transform("__open", lambda h: h["text"]).alias("section_path"),
        F.when(F.col("level").isNull(), F.sum(F.when(F.col("level").isNull(), 1).otherwise(0)).over(order) - 1).alias("order_index"),
    )


def titles(blocks: DataFrame) -> DataFrame:
    """``doc_id`` and ``title``: the text of the first heading, or "Untitled Document"."""
    first = F.min_by(F.when(F.col("level").isNotNull(), F.col("text")), F.when(F.col("level").isNotNull(), F.col("pos")))
    return blocks.groupBy("doc_id").agg(F.coalesce(first, F.lit("Untitled Document")).alias("title"))


def section_tree(sections: DataFrame) -> DataFrame:
    """Path and depth-first order key of every section, however deep.

    Input: ``doc_id``, ``section_id``, ``parent_section_id``, ``heading``, ``section_level``,
    ``sibling_ord``. Adds ``section_path`` (headings from the top, blank ones left out), ``order_key``
    (sibling numbers from the top) and ``cyclic``. A parent that doesn't exist counts as none. A section whose
    ancestors come round in a circle is ``cyclic`` and stands at the top, with its own heading only.

    As many joins as there are usual levels; where ancestors are left, each further join doubles the
    number of levels that are known.
    """
    own = F.when(is_blank(F.col("heading")), F.array().cast("array<string>")).otherwise(F.array(F.col("heading")))
    nodes = sections.select("*", own.alias("section_path"), F.array("sibling_ord").alias("order_key"), F.array("section_id").alias("__ids"), F.lit(False).alias("cyclic"), F.col("parent_section_id").alias("__up"))

    def higher(nodes: DataFrame, above: DataFrame) -> DataFrame:
        joined = nodes.join(above, ["doc_id", "__up"], "left").withColumn("__round", F.coalesce(F.arrays_overlap("__ids", "__more"), F.lit(False)))
        longer = lambda new, old: F.when(F.col("__round") | F.col(new).isNull(), F.col(old)).otherwise(F.concat(new, old)).alias(old)
        return joined.select(
            *sections.columns,
            longer("__path", "section_path"),
            longer("__key", "order_key"),
            longer("__more", "__ids"),
            (F.col("cyclic") | F.col("__round") | F.coalesce(F.col("__cyclic"), F.lit(False))).alias("cyclic"),
            F.when(~F.col("__round"), F.col("__next")).alias("__up"),
        )

    as_above = lambda n: n.select("doc_id", F.col("section_id").alias("__up"), F.col("section_path").alias("__path"), F.col("order_key").alias("__key"), F.col("__ids").alias("__more"), F.col("cyclic").alias("__cyclic"), F.col("__up").alias("__next"))
    parents = as_above(nodes)
    for _ in LEVELS[1:]:
        nodes = higher(nodes, parents)
    nodes = written(nodes, "tree")
    while not nodes.filter("__up is not null").isEmpty():
        nodes = written(higher(nodes, as_above(nodes)), "tree")
    alone = lambda c, column: F.when(F.col("cyclic"), c).otherwise(F.col(column)).alias(column)
    return nodes.select(*sections.columns, alone(own, "section_path"), alone(F.array("sibling_ord"), "order_key"), "cyclic")


def reading_order(tree: DataFrame) -> DataFrame:
    """Depth-first number of each section in its document, from 1, as ``section_order``."""
    return tree.withColumn("section_order", F.row_number().over(Window.partitionBy("doc_id").orderBy("order_key", "section_id")))


def library_tables(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of read documents as the tables that validation and chunking take: elements, sections, documents.

    ``blocks`` has ``doc_id``, ``pos``, ``level`` (of a heading, else null), ``kind`` (``paragraph`` or ``table``), ``text``, ``rows``,
    ``page_number`` and ``source_path``. Ids of sections and elements are UUIDs made of the document and the place, the same on every
    run. A heading that stands below none, however deep, is a top section. A document's title is its first heading.
    """
    placed = written(
        outline(blocks.select("doc_id", "pos", "level", "text")).join(blocks.select("doc_id", "pos", "kind", "rows", "page_number", "source_path"), ["doc_id", "pos"]),
        "outline",
    )
    made = lambda kind, pos: F.when(pos.isNotNull(), uuid5(NAMESPACE_URL, F.concat_ws(":", F.lit(kind), "doc_id", pos.cast("string"))))
    file = F.element_at(F.split("source_path", "/"), -1)
    stem = F.regexp_replace(file, r"\.[^.]+$", "")
    none = lambda kind: F.lit(None).cast(kind)
    section = made("section", F.col("section_pos"))
    elements = placed.filter("level is null").select(
        "doc_id",
        made("element", F.col("pos")).alias("element_id"),
        section.alias("section_id"),
        section.alias("containing_section_id"),
        F.col("order_index").cast("int").alias("order_index"),
        F.col("kind").alias("element_type"),
        F.when(F.col("kind") == "paragraph", F.col("text")).alias("content"),
        "page_number",
        "rows",
        none("string").alias("caption"),
        none("string").alias("alt_text"),
        none("string").alias("list_type"),
        none("array<struct<content:string,level:int>>").alias("items"),
        file.alias("source_file"),
        "source_path",
        stem.alias("source_document"),
    )
    order = Window.partitionBy("doc_id", "parent_pos").orderBy("pos")
    sections = placed.filter("level is not null").select(
        "doc_id",
        made("section", F.col("pos")).alias("section_id"),
        made("section", F.col("parent_pos")).alias("parent_section_id"),
        F.col("text").alias("heading"),
        F.col("level").alias("section_level"),
        (F.row_number().over(order) - 1).alias("sibling_ord"),
    )
    files = placed.groupBy("doc_id").agg(F.min(stem).alias("source_document"))
    documents = files.join(titles(blocks), "doc_id").select("doc_id", "title", "source_document", none("string").alias("version"))
    return elements, sections, documents


_CONTAINER = "|".join(
    # Headings of sections that only hold others.
    [r"^form\s*\d+[a-z]?", r"^form\b", r"^appendi", r"^annex", r"^annexure", r"^table\s+of\s+contents", r"^contents?\b", r"^section.*(appendi|annex)", r"^section\s+[a-z0-9]+\b", r"^chapter\b", r"^part\b"]
)


def is_container_heading(heading: Column) -> Column:
    """Whether a heading names a section that may be empty, like an annex or a table of contents."""
    return F.coalesce(F.lower(trim_ws(heading)).rlike(_CONTAINER), F.lit(False))


def classify_sections(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """``doc_id``, ``section_id`` and ``section_type`` of every section, by the first rule that fits."""
    text = F.when(F.col("element_type") == "paragraph", F.length(F.coalesce("content", F.lit("")))).otherwise(0)
    held = elements.groupBy("doc_id", F.col("containing_section_id").alias("section_id")).agg(
        F.sum(text).alias("chars"),
        F.max((F.col("element_type") == "table").cast("int")).alias("tables"),
        F.max(((F.col("element_type") == "paragraph") & ~is_blank(F.col("content"))).cast("int")).alias("paragraphs"),
    )
    parents = sections.select("doc_id", F.col("parent_section_id").alias("section_id"), F.lit(1).alias("subsections")).dropna().distinct()
    top = sections.filter("parent_section_id is null").groupBy("doc_id").agg(F.min("sibling_ord").alias("first_ord"))
    h = F.coalesce(F.lower(trim_ws(F.col("heading"))), F.lit(""))
    first = F.col("parent_section_id").isNull() & (F.col("sibling_ord") == F.col("first_ord"))
    cover = first & ((h == "") | h.contains("title") | h.contains("cover")) & (F.coalesce("chars", F.lit(0)) < 300) & F.col("subsections").isNull()
    # The names of the types.
    kind = (
        F.when(h.rlike(r"table\s*of\s*contents|^contents$"), "TABLE_OF_CONTENTS")
        .when(cover, "COVER_PAGE")
        .when(h.rlike(r"^form\b|^form\s*\d+[a-z]?"), "TEMPLATE_FORM")
        .when(h.contains("signature"), "SIGNATURE_PAGE")
        .when(h.rlike("signed by|signatory|certificate"), "CERTIFICATE")
        .when(h.rlike("left blank|to be completed|tbd|placeholder"), "PLACEHOLDER_SECTION")
        .when(h.rlike("^appendi|^annex"), "CONTAINER_SECTION")
        .when(F.col("subsections").isNotNull(), "CONTAINER_SECTION")
        .when((F.coalesce("tables", F.lit(0)) == 1) & (F.coalesce("paragraphs", F.lit(0)) == 0), "TEMPLATE_FORM")
        .otherwise("CONTENT_SECTION")
    )
    keys = ["doc_id", "section_id"]
    return sections.join(held, keys, "left").join(parents, keys, "left").join(top, "doc_id", "left").select(*keys, kind.alias("section_type"))
