"""Queries on generated documents: validation, references, plans, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestone.operators.planning import SECTION_RULES, assembly_errors, generation_strategy, proposal_prompts, review_findings, section_queries
from quirestone.operators.transport import (
    block_errors,
    component_ids,
    document_errors,
    grouped_references,
    hierarchy_errors,
    once,
    plan_conformance,
    render_operations,
    section_sequences,
    spread_slots,
    undeclared_references,
)
from quirestone.plans import sql
from quirestone.sources.proposals import as_json, parse_json
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


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "transport_blocks"))


_ONCE = "once AS (SELECT * FROM transport_blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) = 1)"
_ANY_BLANK = lambda c, x="x": f"coalesce(len(list_filter({c}, lambda x: {sql.blank(x)})) > 0, FALSE)"
_RULES = {
    "UNKNOWN_BLOCK_TYPE": "coalesce(type NOT IN ('paragraph', 'callout', 'requirement_matrix', 'bullet_list', 'table', 'visual_placeholder'), TRUE)",
    "MISSING_TEXT": f"type IN ('paragraph', 'callout') AND {sql.blank('text')}",
    "MISSING_LABEL": f"type = 'callout' AND {sql.blank('label')}",
    "BLANK_TABLE_HEADER": f"type = 'table' AND {_ANY_BLANK('headers')}",
    "MISSING_TABLE_ROWS": "type = 'table' AND coalesce(len(rows), 0) = 0",
    "MISSING_DESCRIPTION": f"type = 'visual_placeholder' AND {sql.blank('description')}",
    "EMPTY_LIST": "type = 'bullet_list' AND coalesce(len(items), 0) = 0",
    "BLANK_LIST_ITEM": f"type = 'bullet_list' AND {_ANY_BLANK('items')}",
    "MISSING_TABLE_HEADERS": "type = 'table' AND coalesce(len(headers), 0) = 0",
    "RAGGED_TABLE": "type = 'table' AND coalesce(len(list_filter(rows, lambda r: coalesce(len(r), 0) <> coalesce(len(headers), 0))) > 0, FALSE)",
    "MISSING_VISUAL_ID": f"type = 'visual_placeholder' AND {sql.blank('visual_id')}",
    "EMPTY_MATRIX": "type = 'requirement_matrix' AND coalesce(len(entries), 0) = 0",
    "BLANK_MATRIX_FIELD": f"type = 'requirement_matrix' AND ({_ANY_BLANK('entries', 'x.requirement_id')} OR {_ANY_BLANK('entries', 'x.requirement')} OR {_ANY_BLANK('entries', 'x.response')})",
    "DUPLICATE_REQUIREMENT": "type = 'requirement_matrix' AND coalesce(len(list_distinct(list_transform(entries, lambda e: e.requirement_id))) < len(list_filter(entries, lambda e: e.requirement_id IS NOT NULL)), FALSE)",
    "BLANK_REFERENCE": _ANY_BLANK("reference_ids"),
}


@query(f"WITH {_ONCE} " + " UNION ALL ".join(f"SELECT block_id, '{code}' AS error FROM once WHERE {rule}" for code, rule in _RULES.items()))
def transport_errors(spark, folder):
    """Rules that generated blocks break."""
    return block_errors(_blocks(spark, folder))


@query(
    f"""WITH {_ONCE}, c AS (SELECT proposal_id, unnest(reference_ids) AS reference_id FROM once UNION ALL SELECT proposal_id, unnest(e.evidence_reference_ids) FROM (SELECT proposal_id, unnest(entries) AS e FROM once))
SELECT DISTINCT proposal_id, reference_id FROM c WHERE NOT {sql.blank('reference_id')} AND (proposal_id, reference_id) NOT IN (SELECT (proposal_id, reference_id) FROM knowledge_refs)"""
)
def unknown_references(spark, folder):
    """Cited references that a proposal never declared, as written."""
    return undeclared_references(_blocks(spark, folder), table(spark, folder, "knowledge_refs"))


_DOCUMENT_ERRORS = f"""d AS (SELECT DISTINCT proposal_id, reference_id, title, source, declared_at FROM knowledge_refs WHERE deleted_at IS NULL),
s AS (SELECT DISTINCT proposal_id, section_id, CAST(regexp_extract(path, '^sections\\[(\\d+)\\]', 1) AS INTEGER) AS section_at FROM once)
SELECT proposal_id, 'DUPLICATE_VISUAL_ID' AS error, visual_id AS subject FROM once WHERE type = 'visual_placeholder' AND NOT {sql.blank('visual_id')} GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT DISTINCT proposal_id, 'BLANK_REFERENCE_ID', reference_id FROM d WHERE {sql.blank('reference_id')} UNION ALL SELECT DISTINCT proposal_id, 'BLANK_REFERENCE_TITLE', reference_id FROM d WHERE {sql.blank('title')}
UNION ALL SELECT DISTINCT proposal_id, 'BLANK_REFERENCE_SOURCE', reference_id FROM d WHERE {sql.blank('source')}
UNION ALL SELECT proposal_id, 'DUPLICATE_REFERENCE', reference_id FROM d WHERE NOT {sql.blank('reference_id')} GROUP BY 1, 3 HAVING count(DISTINCT declared_at) > 1
UNION ALL SELECT proposal_id, unnest(['BLANK_SECTION_ID', 'BLANK_HEADING']), section_id FROM s WHERE {sql.blank('section_id')}
UNION ALL SELECT proposal_id, 'DUPLICATE_SECTION', section_id FROM s WHERE NOT {sql.blank('section_id')} GROUP BY 1, 3 HAVING count(*) > 1"""


@query(f"WITH {_ONCE}, {_DOCUMENT_ERRORS} UNION ALL SELECT proposal_id, 'UNKNOWN_REFERENCE', reference_id FROM ({ORACLE_SQL['unknown_references']})")
def transport_document_errors(spark, folder):
    """Rules on whole proposals: visual ids, references and sections."""
    return document_errors(_blocks(spark, folder), table(spark, folder, "knowledge_refs"))


@query(
    f"""WITH s AS (SELECT DISTINCT doc_id, section_id, parent_section_id, heading, section_level FROM sections), p AS (SELECT doc_id, section_id, max(section_level) AS above FROM s GROUP BY ALL)
SELECT doc_id, 'BLANK_HEADING' AS error, section_id AS subject FROM s WHERE {sql.blank('heading')} UNION ALL SELECT doc_id, 'BLANK_SECTION_ID', section_id FROM s WHERE {sql.blank('section_id')}
UNION ALL SELECT doc_id, 'INVALID_HEADING_LEVEL', section_id FROM s WHERE section_level < 1
UNION ALL SELECT s.doc_id, 'INVALID_HIERARCHY', s.section_id FROM s JOIN p ON s.doc_id = p.doc_id AND s.parent_section_id = p.section_id WHERE section_level <= above
UNION ALL SELECT doc_id, 'DUPLICATE_SECTION', section_id FROM s WHERE NOT {sql.blank('section_id')} GROUP BY 1, 3 HAVING count(*) > 1"""
)
def hierarchy_problems(spark, folder):
    """What is wrong with the sections of library documents below each other; none stands below itself."""
    s = table(spark, folder, "sections").select("doc_id", "section_id", F.col("parent_section_id").alias("parent_id"), "heading", F.col("section_level").alias("level")).distinct()
    return hierarchy_errors(s, key="doc_id")


_PLAN = """plan AS (SELECT proposal_id, list(section_id ORDER BY o, section_id) AS plan FROM (SELECT proposal_id, section_id, min(query_ord) AS o FROM retrieved_refs GROUP BY ALL) GROUP BY 1)"""


@query(
    f"""WITH {_ONCE}, {_PLAN}, has AS (SELECT proposal_id, list(section_id ORDER BY o, section_id) AS has FROM (
  SELECT DISTINCT proposal_id, section_id, CAST(regexp_extract(path, '^sections\\[(\\d+)\\]', 1) AS INTEGER) AS o FROM once) GROUP BY 1),
b AS (SELECT coalesce(p.proposal_id, h.proposal_id) AS proposal_id, coalesce(plan, []) AS plan, coalesce(has, []) AS has FROM plan p FULL JOIN has h ON p.proposal_id = h.proposal_id),
d AS (SELECT proposal_id, list_filter(plan, lambda s: NOT list_contains(has, s)) AS missing, list_filter(has, lambda s: NOT list_contains(plan, s)) AS unexpected,
  list_distinct(list_filter(has, lambda s: len(list_filter(has, lambda x: x = s)) > 1)) AS repeated, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(has, lambda s: [s])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS once_each, plan, has FROM b),
e AS (SELECT *, list_filter(plan, lambda s: list_contains(has, s)) = list_filter(once_each, lambda s: list_contains(plan, s)) AS in_order FROM d)
SELECT proposal_id, array_to_string(list_sort(missing), ',') AS missing, array_to_string(list_sort(unexpected), ',') AS unexpected, array_to_string(list_sort(repeated), ',') AS repeated, in_order,
len(missing) + len(unexpected) + len(repeated) = 0 AND in_order AS conforms FROM e"""
)
def plan_differences(spark, folder):
    """How the sections of every proposal differ from those that were searched for."""
    refs = table(spark, folder, "retrieved_refs").groupBy("proposal_id", "section_id").agg(F.min("query_ord").alias("o"))
    plan = refs.groupBy("proposal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "section_id"))), lambda x: x["section_id"]).alias("sections"))
    d = plan_conformance(plan, section_sequences(_blocks(spark, folder)), "proposal_id")
    return d.select("proposal_id", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), F.array_join("repeated", ",").alias("repeated"), "in_order", "conforms")


@query(
    """WITH f AS (SELECT proposal_id, section_id, reference_type, reference_id, min({'o': query_ord, 't': retrieved_at}) AS seen FROM retrieved_refs GROUP BY ALL)
SELECT proposal_id, section_id, reference_type, reference_id, row_number() OVER (PARTITION BY proposal_id, section_id, reference_type ORDER BY seen, reference_id) AS place FROM f"""
)
def reference_groups(spark, folder):
    """References of every section by type, in the order in which they came."""
    return grouped_references(table(spark, folder, "retrieved_refs")).withColumn("place", F.col("place").cast("long"))


def _uuid5_sql(name: str) -> str:
    d = f"sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    variant = f"substr('89ab', (CAST(('0x' || substr({d}, 17, 1)) AS INTEGER) & 3) + 1, 1)"
    return f"substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || {variant} || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"


@query(
    f"""WITH {_ONCE} SELECT block_id, {_uuid5_sql("'composition:' || proposal_id")} AS composition_id, {_uuid5_sql("'component:' || proposal_id || ':' || section_id || ':heading'")} AS section_component_id,
{_uuid5_sql("'component:' || proposal_id || ':' || section_id || ':' || type || ':' || ord")} AS component_id FROM once"""
)
def composition_ids(spark, folder):
    """Name-based ids of every block and what it stands in."""
    return component_ids(_blocks(spark, folder))


_CELLS = "array_to_string(list_transform({}, lambda c: coalesce(c, '')), ' | ')"


@query(
    f"""WITH {_ONCE}, s AS (SELECT *, CAST(regexp_extract(path, '^sections\\[(\\d+)\\]', 1) AS INTEGER) AS section_at FROM once),
l AS (SELECT proposal_id, section_at, section_id, ord AS block_at, block_id, type, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_at FROM (SELECT *, CASE type
  WHEN 'paragraph' THEN [text] WHEN 'callout' THEN [label, text] WHEN 'bullet_list' THEN items
  WHEN 'table' THEN list_concat([{_CELLS.format('headers')}], list_transform(rows, lambda r: {_CELLS.format('r')}))
  WHEN 'requirement_matrix' THEN list_transform(entries, lambda e: concat_ws(' | ', coalesce(e.requirement_id, ''), coalesce(e.requirement, ''), coalesce(e.response, ''), coalesce(array_to_string(e.evidence_reference_ids, ', '), '')))
  WHEN 'visual_placeholder' THEN [description] END AS ls FROM s)
UNION ALL SELECT proposal_id, section_at, section_id, 2147483647, 0, 'reference', concat_ws(' \u2014 ', nullif(reference_id, ''), nullif(title, ''), nullif(source, ''), nullif(locator, '')), row_number() OVER (PARTITION BY proposal_id
  ORDER BY reference_id, concat_ws(' \u2014 ', nullif(reference_id, ''), nullif(title, ''), nullif(source, ''), nullif(locator, ''))) FROM (SELECT DISTINCT proposal_id, section_at, section_id FROM s WHERE section_id = 'references')
  JOIN (SELECT DISTINCT proposal_id, reference_id, title, source, locator FROM knowledge_refs WHERE deleted_at IS NULL) USING (proposal_id)
UNION ALL SELECT DISTINCT proposal_id, section_at, section_id, -2, -2, 'page_break', '', 0 FROM s WHERE section_id = 'references'
UNION ALL SELECT DISTINCT proposal_id, section_at, section_id, -3, -3, 'title', proposal_id, 0 FROM s WHERE section_id = 'cover'
UNION ALL SELECT DISTINCT proposal_id, section_at, section_id, -1, -1, 'heading', array_to_string(list_transform(string_split(section_id, '_'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' '), 0 FROM s)
SELECT proposal_id, row_number() OVER (PARTITION BY proposal_id ORDER BY section_at, section_id, block_at, block_id, line_at) AS op_ord,
CASE type WHEN 'heading' THEN 'heading' WHEN 'page_break' THEN 'page_break' WHEN 'bullet_list' THEN 'list_item' WHEN 'table' THEN 'table_row' WHEN 'requirement_matrix' THEN 'table_row' ELSE 'paragraph' END AS kind,
CASE WHEN type = 'heading' THEN 'heading_1' WHEN type = 'title' THEN 'proposal_title' WHEN type IN ('paragraph', 'reference', 'visual_placeholder') THEN 'body' WHEN type = 'bullet_list' THEN 'bullet' WHEN type = 'table' THEN
  CASE WHEN line_at = 0 THEN 'table_header' ELSE 'table_cell' END ELSE type END AS style, coalesce(line, '') AS text FROM l"""
)
def render_ops(spark, folder):
    """Every proposal as a sequence of lines to print."""
    return printed(_blocks(spark, folder), table(spark, folder, "knowledge_refs")).withColumn("op_ord", F.col("op_ord").cast("long"))


def printed(blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """Lines of proposals with their id as the title and the references that they declare on a page of their own."""
    references = declared.filter("deleted_at is null").select("proposal_id", "reference_id", "title", "source", "locator").distinct()
    titles = blocks.select("proposal_id", F.col("proposal_id").alias("title")).distinct()
    return render_operations(blocks, titles=titles, references=references, breaks=("references",))


@query(
    f"""WITH {_ONCE}, n AS (SELECT proposal_id, section_id, count(*) AS blocks FROM once GROUP BY ALL)
SELECT proposal_id, section_id, i AS block, CASE WHEN blocks = 1 THEN 0 ELSE CAST(round_even(i * 11 / (blocks - 1), 0) AS INTEGER) END AS slot FROM (SELECT *, unnest(range(blocks)) AS i FROM n)"""
)
def slot_spread(spark, folder):
    """The blocks of every section spread over twelve slots."""
    n = _blocks(spark, folder).groupBy("proposal_id", "section_id").agg(F.count(F.lit(1)).alias("blocks"))
    s = n.select("proposal_id", "section_id", F.posexplode(spread_slots(F.col("blocks").cast("int"), F.lit(12))).alias("block", "slot"))
    return s.withColumn("block", F.col("block").cast("long"))


@query(f"WITH {_ONCE} SELECT proposal_id, type, count(*) AS blocks, count(DISTINCT section_id) AS sections FROM once GROUP BY CUBE (proposal_id, type)")
def block_statistics(spark, folder):
    """Blocks by proposal and type, with subtotals."""
    return _blocks(spark, folder).cube("proposal_id", "type").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("section_id").alias("sections"))


_NEEDS = """needs AS (SELECT proposal_id, section_id, min(query_ord) AS ord, bool_or(reference_type = 'authoring') AS authoring, bool_or(reference_type = 'technical') AS technical, bool_or(reference_type = 'blueprint') AS blueprint
FROM retrieved_refs GROUP BY ALL)"""


def _needs(spark: SparkSession, folder: str) -> DataFrame:
    flags = [F.max(F.col("reference_type") == t).alias(t) for t in ("authoring", "technical", "blueprint")]
    return table(spark, folder, "retrieved_refs").groupBy("proposal_id", "section_id").agg(F.min("query_ord").alias("ord"), *flags)


@query(
    f"""WITH {_NEEDS}, q AS (SELECT proposal_id, ord, section_id, 1 AS i, 'authoring' AS t FROM needs WHERE authoring UNION ALL SELECT proposal_id, ord, section_id, 2, 'technical' FROM needs WHERE technical
UNION ALL SELECT proposal_id, ord, section_id, 3, 'blueprint' FROM needs WHERE blueprint)
SELECT proposal_id, row_number() OVER (PARTITION BY proposal_id ORDER BY ord, i) AS query_ord, section_id, t AS reference_type,
replace(section_id, '_', ' ') || ' | ' || t || ' | general' || CASE WHEN t = 'technical' THEN ' | ' || proposal_id ELSE '' END AS query FROM q"""
)
def section_searches(spark, folder):
    """The searches of every proposal's sections."""
    plan = _needs(spark, folder).select("*", F.translate("section_id", "_", " ").alias("title"), F.lit("general").alias("kind"), F.array("proposal_id").alias("requirements"))
    return section_queries(plan, key="proposal_id").select("proposal_id", F.col("query_ord").cast("long").alias("query_ord"), "section_id", "reference_type", "query")


@query(
    """WITH n AS (SELECT proposal_id, section_id, count(DISTINCT reference_id) FILTER (WHERE reference_type = 'authoring') AS a, count(DISTINCT reference_id) FILTER (WHERE reference_type = 'technical') AS t,
count(DISTINCT reference_id) FILTER (WHERE reference_type = 'blueprint') AS b FROM retrieved_refs GROUP BY ALL)
SELECT proposal_id, section_id, CASE WHEN a > 0 AND t > 0 THEN 'combined' WHEN t > 0 THEN 'technical' WHEN a > 0 OR b > 0 THEN 'reference_based' ELSE 'user_input_only' END AS strategy FROM n"""
)
def generation_strategies(spark, folder):
    """How every section is written."""
    types = [F.count_if(F.col("reference_type") == t).alias(t) for t in ("authoring", "technical", "blueprint")]
    g = table(spark, folder, "retrieved_refs").groupBy("proposal_id", "section_id").agg(*types)
    return g.select("proposal_id", "section_id", generation_strategy(F.col("authoring"), F.col("technical"), F.col("blueprint")).alias("strategy"))


_TITLE = "array_to_string(list_transform(string_split(section_id, '_'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
_REFERENCE_BLOCK = lambda kind, name: f"""'[{name}]' || chr(10) || 'Lower priority than user ground truth.' || chr(10) || coalesce(string_agg('Section: ' || section_id || chr(10) || 'Reference ID: ' || reference_id || chr(10) || 'Source: ' || coalesce(source_document, 'None') || chr(10)
|| 'Content: ' || coalesce(content, 'None'), chr(10) ORDER BY ord, section_id, place) FILTER (WHERE reference_type = '{kind}'), 'None retrieved')"""  # noqa: E731


@query(
    f"""WITH {_NEEDS}, r AS (SELECT proposal_id, section_id, reference_type, reference_id, max(CASE WHEN NOT isnan(score) THEN score END) AS s, min({{'a': source_document, 'b': content}}) AS lowest,
  max_by({{'a': source_document, 'b': content}}, CASE WHEN NOT isnan(score) THEN score END) AS best, count(DISTINCT source_document) AS sources FROM retrieved_refs GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY proposal_id, section_id, reference_type ORDER BY s DESC NULLS LAST, reference_id) AS place FROM r),
v AS (SELECT u.proposal_id, u.section_id, reference_type, reference_id, coalesce(best, lowest).b AS content, '-' AS source_document, place, ord FROM u JOIN needs USING (proposal_id, section_id) WHERE place <= 3),
b AS (SELECT proposal_id, {_REFERENCE_BLOCK('technical', 'TECHNICAL_REFERENCES')} AS t, {_REFERENCE_BLOCK('authoring', 'AUTHORING_REFERENCES')} AS a, {_REFERENCE_BLOCK('blueprint', 'BLUEPRINT_REFERENCES')} AS p, count(*) AS n,
  count(*) FILTER (WHERE reference_type = 'technical') AS nt, count(*) FILTER (WHERE reference_type = 'authoring') AS na, count(*) FILTER (WHERE reference_type = 'blueprint') AS np FROM v GROUP BY 1),
o AS (SELECT proposal_id, count(*) AS sections, string_agg(i || '. section_id: ' || section_id || chr(10) || '   title: ' || {_TITLE}, chr(10) ORDER BY i) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY ord, section_id) AS i FROM needs) GROUP BY 1)
SELECT proposal_id, CAST(sections AS INTEGER) AS sections, CAST(coalesce(n, 0) AS INTEGER) AS "references", CASE WHEN na > 0 AND nt > 0 THEN 'combined' WHEN nt > 0 THEN 'technical' WHEN na > 0 OR np > 0 THEN 'reference_based' ELSE 'user_input_only' END AS strategy,
sha256('[USER_GROUND_TRUTH]' || chr(10) || 'Highest priority. Project-specific facts supplied by the user.' || chr(10) || 'Client: ' || proposal_id || chr(10) || 'Proposal Title: Offer' || chr(10) || 'Project Data: {{"id":"' || proposal_id || '","kind":"general"}}' || chr(10)
|| 'Requirements:' || chr(10) || '- Answer ' || proposal_id || chr(10) || 'Constraints:' || chr(10) || '- None supplied' || repeat(chr(10), 2) || t || repeat(chr(10), 2) || a || repeat(chr(10), 2) || p || repeat(chr(10), 2)
|| '[PLANNED_SECTION_CONTRACT]' || chr(10) || 'Return exactly these top-level sections, exactly once, in exactly this order:' || chr(10) || listed || chr(10) || '{SECTION_RULES}') AS facts_hash FROM o JOIN b USING (proposal_id)"""
)
def section_prompts(spark, folder):
    """The prompt of every proposal by its plan and the best references of each section; the schema is tested apart."""
    refs = table(spark, folder, "retrieved_refs")
    plan = _needs(spark, folder).select("proposal_id", "ord", "section_id", F.initcap(F.translate("section_id", "_", " ")).alias("title"))
    data = F.create_map(F.lit("kind"), F.lit("general"), F.lit("id"), F.col("proposal_id"))
    none = F.array().cast("array<string>")
    projects = plan.select("proposal_id").distinct().select("proposal_id", F.col("proposal_id").alias("client"), F.lit("Offer").alias("title"), data.alias("data"), F.array(F.concat(F.lit("Answer "), "proposal_id")).alias("requirements"), none.alias("constraints"))
    p = proposal_prompts(projects, plan, refs.withColumn("source_document", F.lit("-")), key="proposal_id")
    return p.select("proposal_id", "sections", "references", "strategy", F.sha2("facts", 256).alias("facts_hash"))


_PLAN_AND_PARTS = f"""{_ONCE}, {_NEEDS}, c AS (SELECT proposal_id, section_id, path, ord, coalesce(text, '') AS text, reference_ids FROM once WHERE type = 'paragraph'),
p AS (SELECT proposal_id, section_id, count(*) AS planned FROM needs GROUP BY ALL), g AS (SELECT proposal_id, section_id, count(*) AS given FROM c GROUP BY ALL),
e AS (SELECT coalesce(p.proposal_id, g.proposal_id) AS proposal_id, coalesce(p.section_id, g.section_id) AS section_id, coalesce(planned, 0) AS planned, coalesce(given, 0) AS given
  FROM p FULL JOIN g ON p.proposal_id = g.proposal_id AND p.section_id = g.section_id),
errors AS (SELECT proposal_id, section_id, 'duplicate_content' AS error FROM e WHERE given > 1 UNION ALL SELECT proposal_id, section_id, 'missing_content' FROM e WHERE given = 0
  UNION ALL SELECT proposal_id, section_id, 'unplanned_content' FROM e WHERE planned = 0)"""


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs with their section's index as ``ord``."""
    section = F.regexp_extract("path", r"^sections\[(\d+)\]", 1).cast("int")
    return _blocks(spark, folder).filter("type = 'paragraph'").select("proposal_id", "section_id", "block_id", section.alias("ord"), F.coalesce("text", F.lit("")).alias("text"), "reference_ids")


@query(f"WITH {_PLAN_AND_PARTS} SELECT * FROM errors")
def assembly_problems(spark, folder):
    """Sections with no paragraph, more than one, or none planned."""
    return assembly_errors(_needs(spark, folder), _paragraphs(spark, folder), key="proposal_id", part="section_id")


@query(
    f"""WITH {_PLAN_AND_PARTS}, f AS (SELECT proposal_id, section_id, error AS finding, NULL AS detail FROM errors
UNION ALL SELECT proposal_id, section_id, 'empty_content', NULL FROM c WHERE {sql.blank('text')}
UNION ALL SELECT DISTINCT proposal_id, section_id, 'unknown_reference', r FROM (SELECT proposal_id, section_id, unnest(reference_ids) AS r FROM c) WHERE r IS NULL OR (proposal_id, r) NOT IN (SELECT (proposal_id, reference_id) FROM knowledge_refs)
UNION ALL SELECT proposal_id, section_id, 'out_of_order', CAST(a AS VARCHAR) FROM (SELECT proposal_id, section_id, row_number() OVER (PARTITION BY proposal_id ORDER BY o, section_id) AS a, row_number() OVER (PARTITION BY proposal_id ORDER BY n.ord, section_id) AS b
  FROM (SELECT proposal_id, section_id, min(CAST(regexp_extract(path, '^sections\\[(\\d+)\\]', 1) AS INTEGER)) AS o FROM c GROUP BY ALL) JOIN needs n USING (proposal_id, section_id)) WHERE a <> b
UNION ALL SELECT proposal_id, section_id, finding, detail FROM (SELECT DISTINCT proposal_id, section_id, reference_id, x.f AS finding, x.d AS detail FROM (SELECT *, unnest([
  CASE WHEN {sql.blank('reference_id')} THEN {{'f': 'invalid_reference', 'd': 'reference_id'}} END, CASE WHEN {sql.blank('reference_type')} THEN {{'f': 'invalid_reference', 'd': 'reference_type'}} END,
  CASE WHEN {sql.blank('chunk_id')} THEN {{'f': 'invalid_reference', 'd': 'chunk_id'}} END, CASE WHEN {sql.blank('source_document')} THEN {{'f': 'invalid_reference', 'd': 'source_document'}} END,
  CASE WHEN {sql.blank('content')} THEN {{'f': 'invalid_reference', 'd': 'content'}} END, CASE WHEN NOT coalesce(isfinite(score) AND score >= 0, FALSE) THEN {{'f': 'invalid_reference', 'd': 'score'}} END,
  CASE WHEN NOT coalesce(isfinite(score), TRUE) THEN {{'f': 'invalid_metadata', 'd': 'score'}} END]) AS x FROM retrieved_refs) WHERE x IS NOT NULL))
SELECT finding, count(*) AS n, count(DISTINCT proposal_id) AS proposals, count(DISTINCT detail) AS details FROM f GROUP BY 1"""
)
def review_summary(spark, folder):
    """What a review of all paragraphs finds, counted."""
    retrieved = table(spark, folder, "retrieved_refs").withColumn("metadata", F.create_map(F.lit("score"), F.col("score")))
    f = review_findings(_needs(spark, folder), _paragraphs(spark, folder), table(spark, folder, "knowledge_refs"), key="proposal_id", part="section_id", retrieved=retrieved, metadata="metadata")
    return f.groupBy("finding").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("proposal_id").alias("proposals"), F.count_distinct("detail").alias("details"))


@query(
    """WITH d AS (SELECT DISTINCT query_id, citation_id, document_id, header_path FROM citations),
r AS (SELECT query_id, list_distinct(list(candidate_index)) AS cited FROM rerank_scores WHERE query_id IN (SELECT query_id FROM citations) AND relevance_score > 0.8 AND isfinite(relevance_score) GROUP BY 1)
SELECT r.query_id, (SELECT count(DISTINCT citation_id) FROM d WHERE d.query_id = r.query_id AND list_contains(r.cited, CAST(substr(citation_id, 2) AS INTEGER))) AS supported,
(SELECT count(*) FROM (SELECT unnest(r.cited) AS i) WHERE 'c' || i NOT IN (SELECT citation_id FROM d WHERE d.query_id = r.query_id)) AS unsupported FROM r"""
)
def answer_support(spark, folder):
    """Of all candidates with a score above 0.8, how many each query's context has."""
    context = table(spark, folder, "citations").select("query_id", "citation_id").distinct()
    scores = table(spark, folder, "rerank_scores").filter((F.col("relevance_score") > 0.8) & ~F.isnan("relevance_score") & (F.col("relevance_score") < float("inf")) & F.col("candidate_index").isNotNull())
    cited = scores.select("query_id", F.concat(F.lit("c"), F.col("candidate_index").cast("string")).alias("citation_id")).distinct()
    # both sides have a pair once, and queries meet only when counted, so that none is hot
    found = cited.join(context.withColumn("known", F.lit(True)), ["query_id", "citation_id"], "left")
    counts = found.groupBy("query_id").agg(F.count_if(F.col("known").isNotNull()).alias("supported"), F.count_if(F.col("known").isNull()).alias("unsupported"))
    return counts.join(context.select("query_id").distinct(), "query_id", "left_semi")


@query(
    f"""WITH {_ONCE}, s AS (SELECT *, CAST(regexp_extract(path, '^sections\\[(\\d+)\\]', 1) AS INTEGER) AS section_at FROM once),
d AS (SELECT DISTINCT proposal_id, section_at, section_id FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY section_at, section_id) - 1 AS i FROM d)
SELECT s.proposal_id, s.section_id, block_id, 'sections[' || i || '].blocks[' || (row_number() OVER (PARTITION BY s.proposal_id, s.section_at, s.section_id ORDER BY ord, block_id) - 1) || ']' AS path,
type, text, coalesce(len(items), -1) AS items, coalesce(len(rows), -1) AS rows, coalesce(len(entries), -1) AS entries, array_to_string(list_transform(reference_ids, lambda r: coalesce(r, '?')), ',') AS reference_ids
FROM s JOIN n ON s.proposal_id = n.proposal_id AND s.section_at = n.section_at AND s.section_id = n.section_id"""
)
def json_round_trip(spark, folder):
    """Blocks of every proposal, written as a JSON document and read again."""
    blocks, _ = parse_json(as_json(_blocks(spark, folder)), key="proposal_id", json="json")
    size = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.size(c)).cast("long").alias(c)
    ids = F.array_join("reference_ids", ",", "?").alias("reference_ids")
    return blocks.select("proposal_id", "section_id", "block_id", "path", "type", "text", size("items"), size("rows"), size("entries"), ids)
