"""Queries on elements and sections: validation, structure, chunks, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestone.functions.text import normalize_ws
from quirestone.operators.chunk import char_spans, chunk_elements, chunks
from quirestone.operators.elements import once, rendered
from quirestone.operators.enrich import chunk_id, embedding_text, enriched, payload
from quirestone.operators.structure import classify_sections, is_container_heading, reading_order, section_tree
from quirestone.operators.validate import document_findings, library_findings, statistics, verdicts
from quirestone.plans import sql
from quirestone.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "elements")


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sections")


_ONCE = "once AS (SELECT * FROM elements QUALIFY row_number() OVER (PARTITION BY doc_id, element_id ORDER BY ingested_at) = 1)"
_TREE = f"""tree AS (
  SELECT doc_id, section_id, CASE WHEN {sql.blank('heading')} THEN [] ELSE [heading] END AS path, [sibling_ord] AS okey FROM sections WHERE parent_section_id IS NULL
  UNION ALL
  SELECT s.doc_id, s.section_id, CASE WHEN {sql.blank('s.heading')} THEN t.path ELSE list_append(t.path, s.heading) END, list_append(t.okey, s.sibling_ord)
  FROM sections s JOIN tree t ON s.doc_id = t.doc_id AND s.parent_section_id = t.section_id)"""
_CELL = sql.trim("coalesce(c.content, '')")
_ITEM = sql.trim("coalesce(x.content, '')")
_RENDERED = f"""CASE element_type
  WHEN 'table' THEN coalesce(array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r.cells, lambda c: {_CELL}), ' | ')), chr(10)), '')
  WHEN 'list' THEN coalesce(array_to_string(list_transform(items, lambda x, i: CASE list_type WHEN 'ordered' THEN i || '.' WHEN 'checklist' THEN '- [ ]' ELSE '-' END || ' ' || {_ITEM}), chr(10)), '')
  WHEN 'image' THEN coalesce(nullif({sql.trim('caption')}, ''), nullif({sql.trim('alt_text')}, ''), '[Image]')
  ELSE coalesce(content, '') END"""


@query(f"WITH RECURSIVE {_TREE} SELECT doc_id, section_id, array_to_string(path, ' > ') AS section_path, row_number() OVER (PARTITION BY doc_id ORDER BY okey, section_id) AS section_order FROM tree")
def section_order(spark, folder):
    """Path and depth-first number of every section."""
    return reading_order(section_tree(_sections(spark, folder))).select("doc_id", "section_id", F.array_join("section_path", " > ").alias("section_path"), F.col("section_order").cast("long").alias("section_order"))


@query(f"WITH {_ONCE} SELECT element_id, {_RENDERED} AS text FROM once")
def rendered_elements(spark, folder):
    """Every element as text."""
    return once(_elements(spark, folder)).select("element_id", rendered().alias("text"))


_CONTAINER = r"^form\s*\d+[a-z]?|^form\b|^appendi|^annex|^annexure|^table\s+of\s+contents|^contents?\b|^section.*(appendi|annex)|^section\s+[a-z0-9]+\b|^chapter\b|^part\b"
_HEAD = f"coalesce(lower({sql.trim('heading')}), '')"


@query(f"SELECT section_id, coalesce(regexp_matches({_HEAD}, '{_CONTAINER}'), FALSE) AS is_container FROM sections")
def container_sections(spark, folder):
    """Sections that may be empty."""
    return _sections(spark, folder).select("section_id", is_container_heading(F.col("heading")).alias("is_container"))


_HELD = f"""{_ONCE}, held AS (
  SELECT doc_id, containing_section_id AS section_id, count(*) AS held, sum(CASE WHEN element_type = 'paragraph' THEN length(coalesce(content, '')) ELSE 0 END) AS chars,
    max((element_type = 'table')::INT) AS tables, max((element_type = 'paragraph' AND NOT {sql.blank('content')})::INT) AS paragraphs
  FROM once WHERE containing_section_id IS NOT NULL GROUP BY ALL),
subs AS (SELECT DISTINCT doc_id, parent_section_id AS section_id, 1 AS subsections FROM sections WHERE parent_section_id IS NOT NULL),
top AS (SELECT doc_id, min(sibling_ord) AS first_ord FROM sections WHERE parent_section_id IS NULL GROUP BY 1),
full_ AS (SELECT s.*, h.held, h.chars, h.tables, h.paragraphs, b.subsections, t.first_ord, {_HEAD.replace('heading', 's.heading')} AS h FROM sections s
  LEFT JOIN held h ON s.doc_id = h.doc_id AND s.section_id = h.section_id LEFT JOIN subs b ON s.doc_id = b.doc_id AND s.section_id = b.section_id LEFT JOIN top t ON s.doc_id = t.doc_id)"""


@query(
    f"""WITH {_HELD} SELECT doc_id, section_id, CASE
  WHEN regexp_matches(h, 'table\\s*of\\s*contents|^contents$') THEN 'TABLE_OF_CONTENTS'
  WHEN parent_section_id IS NULL AND sibling_ord = first_ord AND (h = '' OR contains(h, 'title') OR contains(h, 'cover')) AND coalesce(chars, 0) < 300 AND subsections IS NULL THEN 'COVER_PAGE'
  WHEN regexp_matches(h, '^form\\b|^form\\s*\\d+[a-z]?') THEN 'TEMPLATE_FORM'
  WHEN contains(h, 'signature') THEN 'SIGNATURE_PAGE'
  WHEN regexp_matches(h, 'signed by|signatory|certificate') THEN 'CERTIFICATE'
  WHEN regexp_matches(h, 'left blank|to be completed|tbd|placeholder') THEN 'PLACEHOLDER_SECTION'
  WHEN regexp_matches(h, '^appendi|^annex') OR subsections IS NOT NULL THEN 'CONTAINER_SECTION'
  WHEN coalesce(tables, 0) = 1 AND coalesce(paragraphs, 0) = 0 THEN 'TEMPLATE_FORM'
  ELSE 'CONTENT_SECTION' END AS section_type FROM full_"""
)
def section_types(spark, folder):
    """What kind of section every section is."""
    return classify_sections(_sections(spark, folder), once(_elements(spark, folder)))


_UUID = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def _rule(source: str, where: str, code: str, severity: str, subject: str, detail: str = "NULL") -> str:
    return f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, '{code}' AS code, '{severity}' AS severity, CAST({subject} AS VARCHAR) AS subject_id, CAST({detail} AS VARCHAR) AS detail FROM {source} WHERE {where}"


_GOOD = f"regexp_matches(element_id, '{_UUID}')"
_FINDINGS = f"""{_HELD}, good AS (SELECT * FROM elements WHERE {_GOOD}), nested AS (
  SELECT s.*, p.section_level AS parent_level FROM sections s JOIN sections p ON s.doc_id = p.doc_id AND s.parent_section_id = p.section_id), findings AS ("""
_FINDINGS += " UNION ALL ".join(
    [
        _rule("documents", sql.blank("title"), "MISSING_DOCUMENT_TITLE", "error", "doc_id"),
        _rule("documents", "title IS NULL AND source IS NULL AND lang IS NULL", "MISSING_METADATA", "error", "doc_id"),
        _rule("documents", "NOT (title IS NULL AND source IS NULL AND lang IS NULL) AND coalesce(source, '') = ''", "MISSING_SOURCE", "warning", "doc_id"),
        _rule("documents", "NOT (title IS NULL AND source IS NULL AND lang IS NULL) AND coalesce(lang, '') = ''", "MISSING_LANGUAGE", "warning", "doc_id"),
        _rule("elements", f"NOT coalesce({_GOOD}, FALSE)", "INVALID_ELEMENT_ID", "error", "element_id"),
        _rule("good", "'doc-' || lpad(CAST(try_cast(regexp_extract(source_document, '(\\d+)$', 1) AS INTEGER) - 1 AS VARCHAR), 8, '0') IS DISTINCT FROM doc_id", "MISMATCHED_DOCUMENT_ID", "error", "element_id"),
        _rule("good", "order_index IS NULL OR order_index < 0", "INVALID_ORDER_INDEX", "error", "element_id"),
        _rule("good", sql.blank("source_file"), "MISSING_SOURCE_FILE", "warning", "element_id"),
        _rule("good", "containing_section_id IS NOT NULL AND section_id IS NULL", "MISSING_SECTION_ID", "error", "element_id"),
        _rule("good", "section_id <> containing_section_id", "MISMATCHED_SECTION_ID", "error", "element_id", "section_id"),
        _rule("good", "containing_section_id IS NULL AND section_id IS NOT NULL", "UNEXPECTED_SECTION_ID", "error", "element_id", "section_id"),
        _rule("good", f"element_type = 'paragraph' AND {sql.blank('content')}", "EMPTY_PARAGRAPH", "warning", "element_id"),
        _rule("good", "element_type = 'table' AND coalesce(len(rows), 0) = 0", "EMPTY_TABLE", "error", "element_id"),
        _rule("good", f"element_type = 'image' AND {sql.blank('alt_text')}", "MISSING_ALT_TEXT", "warning", "element_id"),
        _rule("good", "element_type = 'list' AND coalesce(len(items), 0) = 0", "EMPTY_LIST", "error", "element_id"),
        _rule("good", "containing_section_id IS NOT NULL AND section_id IS DISTINCT FROM containing_section_id", "ORPHAN_SECTION_REFERENCE", "error", "element_id", "section_id"),
        _rule("good", "containing_section_id IS NULL AND section_id IS NOT NULL AND (doc_id, section_id) NOT IN (SELECT (doc_id, section_id) FROM sections)", "ORPHAN_SECTION_REFERENCE", "error", "element_id", "section_id"),
        _rule("(SELECT doc_id, element_id, len(rows[1].cells) AS w, unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS i FROM good WHERE element_type = 'table')", "i > 0 AND len(r.cells) <> w", "TABLE_INCONSISTENT_COLUMNS", "warning", "element_id", "i"),
        _rule("(SELECT doc_id, element_id FROM good GROUP BY ALL HAVING count(*) > 1)", "TRUE", "DUPLICATE_ELEMENT_UUID", "error", "element_id"),
        _rule("(SELECT doc_id, order_index FROM good WHERE order_index >= 0 GROUP BY ALL HAVING count(*) > 1)", "TRUE", "DUPLICATE_ORDER_INDEX", "error", "NULL", "order_index"),
        _rule("(SELECT DISTINCT doc_id, section_id FROM sections)", "(doc_id, section_id) IN (SELECT (doc_id, element_id) FROM good)", "CONFLICTING_UUID", "error", "section_id"),
        _rule("sections", f"NOT coalesce(regexp_matches(section_id, '{_UUID}'), FALSE)", "INVALID_SECTION_ID", "error", "section_id"),
        _rule("sections", sql.blank("heading"), "EMPTY_SECTION_HEADING", "error", "section_id"),
        _rule("sections", "section_level < 1 OR section_level > 6", "INVALID_SECTION_LEVEL", "error", "section_id", "section_level"),
        _rule("nested", "section_level <= parent_level", "BROKEN_SECTION_HIERARCHY", "error", "section_id", "section_level"),
        _rule("sections", "parent_section_id IS NULL AND section_level <> 1", "TOP_LEVEL_SECTION_NOT_LEVEL_1", "warning", "section_id", "section_level"),
        _rule("nested", "section_level > parent_level + 2", "SECTION_LEVEL_GAP", "warning", "section_id", "section_level"),
        _rule("full_", f"held IS NULL AND subsections IS NULL AND NOT (parent_section_id IS NULL AND sibling_ord = first_ord AND (h = '' OR contains(h, 'title') OR contains(h, 'cover'))) AND NOT regexp_matches(h, '{_CONTAINER}')", "EMPTY_SECTION", "warning", "section_id"),
    ]
)
_FINDINGS += ")"


#: Findings on elements and sections, each element once.
LIBRARY_FINDINGS_SQL = f"WITH {_FINDINGS} SELECT * FROM findings WHERE code NOT IN ('MISSING_DOCUMENT_TITLE', 'MISSING_METADATA', 'MISSING_SOURCE', 'MISSING_LANGUAGE', 'MISMATCHED_DOCUMENT_ID')".replace("good AS (SELECT * FROM elements", "good AS (SELECT * FROM once").replace("FROM elements WHERE NOT", "FROM once WHERE NOT")


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    # the document that an element names: the number of its source document, counted from 1
    number = F.regexp_extract("source_document", r"(\d+)$", 1).try_cast("int") - 1
    e = _elements(spark, folder).withColumn("declared_doc_id", F.concat(F.lit("doc-"), F.lpad(number.cast("string"), 8, "0")))
    return document_findings(table(spark, folder, "documents")).unionByName(library_findings(e, _sections(spark, folder)))


@query(f"WITH {_FINDINGS} SELECT * FROM findings")
def validation_findings(spark, folder):
    """Everything that is wrong with documents, elements and sections."""
    return _findings(spark, folder)


@query(
    f"""WITH {_FINDINGS}, n AS (SELECT doc_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM findings GROUP BY 1)
SELECT d.doc_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS is_valid, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARNINGS' ELSE 'PASS' END AS verdict FROM (SELECT DISTINCT doc_id FROM elements) d LEFT JOIN n ON d.doc_id = n.doc_id"""
)
def validation_verdicts(spark, folder):
    """Errors and warnings of every library document."""
    return verdicts(_findings(spark, folder), _elements(spark, folder).select("doc_id"))


@query(
    """WITH e AS (SELECT doc_id, count(*) AS elements, count(DISTINCT element_id) AS element_ids, count(DISTINCT order_index) AS order_indices, count(*) FILTER (WHERE element_type = 'paragraph') AS paragraphs,
  count(*) FILTER (WHERE element_type = 'table') AS tables, count(*) FILTER (WHERE element_type = 'image') AS images, count(*) FILTER (WHERE element_type = 'list') AS lists FROM elements GROUP BY 1),
s AS (SELECT doc_id, count(*) AS sections, max(section_level) AS deepest_level FROM sections GROUP BY 1)
SELECT coalesce(e.doc_id, s.doc_id) AS doc_id, coalesce(elements, 0) AS elements, coalesce(element_ids, 0) AS element_ids, coalesce(order_indices, 0) AS order_indices, coalesce(paragraphs, 0) AS paragraphs,
  coalesce(tables, 0) AS tables, coalesce(images, 0) AS images, coalesce(lists, 0) AS lists, coalesce(sections, 0) AS sections, coalesce(deepest_level, 0) AS deepest_level FROM e FULL JOIN s ON e.doc_id = s.doc_id"""
)
def validation_statistics(spark, folder):
    """Counts of every library document."""
    return statistics(_elements(spark, folder), _sections(spark, folder))


_CHUNKS = f"""WITH RECURSIVE {_TREE}, {_ONCE}, ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY okey, section_id) AS section_order FROM tree),
j AS (SELECT o.doc_id, o.containing_section_id AS section_id, o.element_id, o.order_index, o.element_type, {_RENDERED} AS text, coalesce(t.path, []) AS path, coalesce(t.section_order, 0) AS section_order
  FROM once o LEFT JOIN ordered t ON o.doc_id = t.doc_id AND o.containing_section_id = t.section_id),
k AS (SELECT *, length({sql.trim("array_to_string(path, chr(10))")}) AS head, {sql.tokens('text')} AS n FROM j),
l AS (SELECT *, CASE WHEN head > 0 THEN head + 2 ELSE 0 END + coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, section_id ORDER BY order_index, element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM k),
g AS (SELECT doc_id, section_id, any_value(section_order) AS section_order, any_value(path) AS path, {sql.tokens("array_to_string(any_value(path), chr(10))")} AS h, count(*) AS c, list(n ORDER BY order_index, element_id) AS ns,
  list(element_type ORDER BY order_index, element_id) AS kinds, list(text ORDER BY order_index, element_id) AS texts, list(order_index ORDER BY order_index, element_id) AS places,
  list(s ORDER BY order_index, element_id) AS starts, list(s + length(text) ORDER BY order_index, element_id) AS ends FROM l GROUP BY doc_id, section_id),
f AS (SELECT doc_id, section_id, 0::BIGINT AS i, 1::BIGINT AS a, FALSE AS fresh, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS done FROM g
  UNION ALL
  SELECT doc_id, section_id, i + 1, CASE WHEN is_table THEN i + 2 WHEN is_full THEN coalesce(list_max(list_filter(range(a, i + 1), lambda x: list_sum(ns[x:i]) >= 50)), a) ELSE a END, NOT is_table,
    CASE WHEN is_table THEN list_concat(CASE WHEN fresh AND i >= a THEN [{{'a': a, 'b': i}}] ELSE [] END, [{{'a': i + 1, 'b': i + 1}}]) WHEN is_full THEN [{{'a': a, 'b': i}}] ELSE [] END
  FROM (SELECT g.doc_id, g.section_id, i, a, fresh, ns, kinds[i + 1] = 'table' AS is_table, i >= a AND h + coalesce(list_sum(ns[a:i]), 0) + ns[i + 1] > 500 AS is_full
    FROM f JOIN g ON f.doc_id = g.doc_id AND f.section_id IS NOT DISTINCT FROM g.section_id AND i < c)),
ranges AS (SELECT doc_id, section_id, unnest(done) AS x FROM f UNION ALL SELECT f.doc_id, f.section_id, {{'a': a, 'b': i}} FROM f JOIN g ON f.doc_id = g.doc_id AND f.section_id IS NOT DISTINCT FROM g.section_id AND i = c WHERE fresh AND a <= i),
chunks AS (SELECT g.doc_id, g.section_id, section_order, path, x.a, x.b, places[x.a] AS order_start, places[x.b] AS order_end, starts[x.a] AS char_start, ends[x.b] AS char_end,
  CASE WHEN len(list_distinct(kinds[x.a:x.b])) = 1 THEN kinds[x.a] ELSE 'mixed' END AS element_type,
  array_to_string(list_concat(CASE WHEN len(path) > 0 THEN [array_to_string(path, chr(10))] ELSE [] END, list_filter(texts[x.a:x.b], lambda t: NOT {sql.blank('t')})), chr(10) || chr(10)) AS text
  FROM ranges r JOIN g ON r.doc_id = g.doc_id AND r.section_id IS NOT DISTINCT FROM g.section_id)"""


_NUMBERED = f"""{_CHUNKS}, titles AS (SELECT doc_id, min(source_document) AS title FROM elements GROUP BY 1),
points AS (SELECT c.*, title, row_number() OVER (PARTITION BY c.doc_id ORDER BY section_order, section_id NULLS FIRST, a, b) - 1 AS chunk_index FROM chunks c LEFT JOIN titles t ON c.doc_id = t.doc_id),
ids AS (SELECT *, sha256(doc_id || coalesce(section_id, '') || chunk_index || {sql.norm('text')}) AS chunk_id, array_to_string(path, chr(10)) AS head FROM points)"""
POINTS_SQL = f"{_NUMBERED} SELECT chunk_id, doc_id, chunk_index, path, text, element_type, head, title, sha256({sql.norm('text')}) AS content_hash FROM ids"


@query(
    f"""{_CHUNKS} SELECT doc_id, section_id, order_start, order_end, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, element_type, {sql.tokens('text')} AS token_count, sha256(text) AS text_hash,
row_number() OVER (PARTITION BY doc_id ORDER BY section_order, section_id NULLS FIRST, a, b) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM chunks"""
)
def section_chunks(spark, folder):
    """Chunks of 500 tokens with a tenth of overlap, of all library documents."""
    c = chunks(chunk_elements(_elements(spark, folder), _sections(spark, folder)))
    whole = {n: F.col(n).cast("long").alias(n) for n in ("char_start", "char_end", "token_count", "chunk_index")}
    return c.select("doc_id", "section_id", "order_start", "order_end", whole["char_start"], whole["char_end"], "element_type", whole["token_count"], F.sha2("text", 256).alias("text_hash"), whole["chunk_index"], "total_chunks")


@query(
    f"""WITH RECURSIVE {_TREE}, {_ONCE}, r AS (SELECT o.doc_id, o.containing_section_id AS section_id, element_id, order_index, {_RENDERED} AS text FROM once o),
j AS (SELECT r.*, length({sql.trim("array_to_string(coalesce(path, []), chr(10))")}) AS head FROM r LEFT JOIN tree t ON r.doc_id = t.doc_id AND r.section_id = t.section_id),
k AS (SELECT *, CASE WHEN head > 0 THEN head + 2 ELSE 0 END + coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, section_id ORDER BY order_index, element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM j)
SELECT element_id, CAST(s AS BIGINT) AS char_start, CAST(s + length(text) AS BIGINT) AS char_end FROM k"""
)
def element_char_spans(spark, folder):
    """Where every element stands in its section's text."""
    return char_spans(chunk_elements(_elements(spark, folder), _sections(spark, folder))).select("element_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(f"WITH {_ONCE} SELECT element_id, sha256(doc_id || coalesce(section_id, '') || order_index || {sql.norm('r')}) AS chunk_id FROM (SELECT *, {_RENDERED} AS r FROM once)")
def chunk_ids(spark, folder):
    """Content-derived id of every element as a chunk."""
    rows = once(_elements(spark, folder)).withColumn("r", rendered())
    return rows.select("element_id", chunk_id(F.col("doc_id"), F.col("section_id"), F.col("order_index"), F.col("r")).alias("chunk_id"))


@query(
    f"""WITH RECURSIVE {_TREE}, {_ONCE}, j AS (SELECT o.element_id, o.element_type, o.source_document, coalesce(path, []) AS path, {_RENDERED} AS r
  FROM once o LEFT JOIN tree t ON o.doc_id = t.doc_id AND o.containing_section_id = t.section_id), k AS (SELECT *, array_to_string(path, chr(10)) AS head FROM j)
SELECT element_id, concat_ws(chr(10), CASE WHEN coalesce({sql.trim('source_document')}, '') <> '' THEN 'Document: ' || source_document END, CASE WHEN len(path) > 0 THEN 'Section Path: ' || array_to_string(path, ' > ') END,
  'Element Type: ' || element_type) || chr(10) || chr(10) || CASE WHEN head <> '' AND starts_with(r, head) THEN {sql.trim('substr(r, length(head) + 1)')} ELSE r END AS embedding_text FROM k"""
)
def embedding_texts(spark, folder):
    """The text that is embedded for every element."""
    rows = chunk_elements(_elements(spark, folder), _sections(spark, folder))
    titles = once(_elements(spark, folder)).select("doc_id", "element_id", "source_document")
    joined = rows.join(titles, ["doc_id", "element_id"])
    return joined.select("element_id", embedding_text(F.col("source_document"), F.col("section_path"), F.col("element_type"), F.col("text")).alias("embedding_text"))


@query(
    f"""{_NUMBERED} SELECT chunk_id, doc_id AS document_id, title AS document_title, section_id, coalesce(path[-1], '') AS section_title, element_type, chunk_index, sha256({sql.norm('text')}) AS content_hash,
sha256(concat_ws(chr(10), CASE WHEN coalesce({sql.trim('title')}, '') <> '' THEN 'Document: ' || title END, CASE WHEN len(path) > 0 THEN 'Section Path: ' || array_to_string(path, ' > ') END, 'Element Type: ' || element_type) || chr(10) || chr(10)
|| CASE WHEN head <> '' AND starts_with(text, head) THEN {sql.trim('substr(text, length(head) + 1)')} ELSE text END) AS embedding_hash FROM ids"""
)
def index_payloads(spark, folder):
    """Enriched chunks as they are written to an index, the embedding text as its hash."""
    e = _elements(spark, folder)
    docs = e.groupBy("doc_id").agg(F.min("source_document").alias("title"))
    p = payload(enriched(chunks(chunk_elements(e, _sections(spark, folder))), docs))
    columns = ["chunk_id", "document_id", "document_title", "section_id", "section_title", "element_type"]
    return p.select(*columns, F.col("chunk_index").cast("long").alias("chunk_index"), "content_hash", F.sha2("embedding_text", 256).alias("embedding_hash"))


@query(
    f"""SELECT doc_id, count(DISTINCT {sql.norm('content')}) AS distinct_texts, count(*) AS paragraphs FROM elements WHERE element_type = 'paragraph' AND NOT {sql.blank('content')} GROUP BY ROLLUP (doc_id)""".replace("SELECT doc_id,", "SELECT coalesce(doc_id, 'all') AS doc_id,")
)
def paragraph_variety(spark, folder):
    """Distinct paragraphs of every document and of all."""
    p = _elements(spark, folder).filter("element_type = 'paragraph'").select("doc_id", normalize_ws(F.col("content")).alias("t")).filter("t <> ''")
    return p.rollup("doc_id").agg(F.count_distinct("t").alias("distinct_texts"), F.count(F.lit(1)).alias("paragraphs")).withColumn("doc_id", F.coalesce("doc_id", F.lit("all")))
