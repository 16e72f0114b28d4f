"""The three ways through the engine: index documents, answer questions, check and print proposals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from uuid import NAMESPACE_URL

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirestone.functions.text import uuid5
from quirestone.operators.candidates import Reranker, drop_reasons, merged_neighbours, reranked, scored_by, without_near_duplicates
from quirestone.operators.chunk import chunk_elements, chunks
from quirestone.operators.collections import run_statistics
from quirestone.operators.context import SYSTEM_PROMPT, budgeted, prompts
from quirestone.operators.elements import once as unique
from quirestone.operators.embed import EmbeddingProvider, embedded, mock_embedding
from quirestone.operators.enrich import enriched, payload
from quirestone.operators.generate import LanguageModel, StubModel, generated
from quirestone.operators.index import fingerprints, not_yet_indexed
from quirestone.operators.qualify import processed, qualified, rejection
from quirestone.operators.search import nearest
from quirestone.operators.skew import join_spread
from quirestone.operators.structure import library_tables
from quirestone.operators.validate import ERROR, library_findings
from quirestone.operators.transport import block_errors, document_errors, once
from quirestone.plans import proposal_queries, sql
from quirestone.plans.document_queries import LIBRARY_FINDINGS_SQL, POINTS_SQL
from quirestone.session import written
from quirestone.sources.docx import authorized, composed_documents, discover, docx_blocks, package_inventory, package_parts, read_docx
from quirestone.sources.layout import layout_blocks, page_blocks, spans_of, unreadable
from quirestone.sources.tables import table

DIMENSIONS = 32
#: Fixed value: the role of documents that may be indexed and searched for proposals.
REFERENCE_ROLE = "REFERENCE_KNOWLEDGE"
#: Points that are broadcast by their ids at most.
FEW_POINTS = 200_000


@dataclass(frozen=True)
class IndexRun:
    """What a run has made: ``points``, ``errors`` (``doc_id``, ``stage``, ``detail``) of documents that it left out, and ``statistics``, one row."""

    points: DataFrame
    errors: DataFrame
    statistics: DataFrame


def index_run(
    elements: DataFrame,
    sections: DataFrame,
    *,
    documents: DataFrame | None = None,
    provider: Callable[[], EmbeddingProvider] | None = None,
    cache: DataFrame | None = None,
    indexed: DataFrame | None = None,
    dimensions: int = DIMENSIONS,
    chunk_size: int = 500,
    overlap_ratio: float = 0.1,
) -> IndexRun:
    """Validate, chunk, enrich and embed all documents that ``indexed`` (``document_fingerprint``) doesn't have.

    A document with an error of validation (stage ``validation``), without a chunk (``chunking``), or with a text that the
    provider failed on (``embedding``) is left out whole and reported; it doesn't stop the others. ``documents`` may give
    ``doc_id``, ``title``, ``source_document`` and ``version``; without it the title is the source document. ``cache`` has known vectors
    (``hash``, ``vector``). Without a provider vectors are made of hashes, the same on every run.
    """
    if dimensions < 1 or chunk_size < 1 or not 0 <= overlap_ratio < 1:
        raise ValueError("dimensions and chunk_size must be positive, overlap_ratio at least 0 and below 1")
    elements = unique(elements)
    known = elements.groupBy("doc_id").agg(F.min("source_document").alias("source_document"))
    if documents is None:
        named = known.select("doc_id", F.col("source_document").alias("title"), "source_document", F.lit(None).cast("string").alias("version"))
    else:
        given = documents.select("doc_id", "title", F.col("source_document").alias("__given"), "version")
        named = known.join(given, "doc_id", "left").select("doc_id", "title", F.coalesce("__given", "source_document").alias("source_document"), "version")
    prints = written(fingerprints(elements, sections).join(named, "doc_id"), "documents")
    due = prints if indexed is None else not_yet_indexed(prints, indexed, fingerprint="document_fingerprint")
    ours = lambda df: df if indexed is None else df.join(due.select("doc_id"), "doc_id", "left_semi")
    findings = library_findings(ours(elements), ours(sections)).filter(F.col("severity") == ERROR)
    broken = findings.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("detail")).select("doc_id", F.lit("validation").alias("stage"), "detail")
    broken = written(broken.join(due.select("doc_id"), "doc_id", "left_semi"), "broken")
    valid = written(due.join(broken, "doc_id", "left_anti"), "valid")

    rows = chunk_elements(elements.join(valid.select("doc_id"), "doc_id", "left_semi"), sections)
    flat = payload(enriched(chunks(rows, chunk_size=chunk_size, overlap_ratio=overlap_ratio), valid.select("doc_id", "title")))
    runtime = valid.select(F.col("doc_id").alias("document_id"), "source_document", "version", "document_fingerprint")
    points = flat.join(runtime, "document_id").withColumns({"page_number": F.lit(None).cast("int"), "point_id": uuid5(NAMESPACE_URL, F.col("chunk_id")), "document_role": F.lit(REFERENCE_ROLE), "indexed_at": F.current_timestamp()})
    if provider is None:
        points = points.withColumns({"vector": mock_embedding(F.col("embedding_text"), dimensions), "__error": F.lit(None).cast("string")})
    else:
        points = embedded(points, text="embedding_text", provider=provider, cache=cache, isolate=True).withColumnRenamed("error", "__error").drop("hash", "cache_hit")
    made = written(points, "points")
    failed = made.filter("__error is not null").groupBy(F.col("document_id").alias("doc_id")).agg(F.min("__error").alias("detail")).select("doc_id", F.lit("embedding").alias("stage"), "detail")
    empty = valid.join(made.select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_anti").select("doc_id", F.lit("chunking").alias("stage"), F.lit("no chunks").alias("detail"))
    errors = broken.unionByName(failed).unionByName(empty)
    points = made.drop("__error")
    if provider is not None:
        points = points.join(failed.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
    done = points.select(F.col("document_id").alias("doc_id"))
    return IndexRun(points, errors, run_statistics(prints.select("doc_id"), done, points, errors))


def index_files(spark: SparkSession, folder: str, *, role: str, root: str | None = None, extractor: Callable[[bytes], list[dict]] | None = None, **more) -> IndexRun:
    """``index_run`` over the Word files, and with an extractor the PDF files, of a folder; ``more`` is passed on.

    All files are authorized before any is parsed: the role must be the allowed one and every path lie below ``root`` (default: the folder).
    A file that can't be read, or has no text, is among the errors (stage ``parsing``), and doesn't stop the others.
    """
    files = discover(spark, folder)
    authorized(files, root or folder, role=role)
    word = F.lower("path").endswith(".docx")
    read = written(read_docx(files.filter(word)), "read")
    blocks, broken = docx_blocks(read), read.filter("error is not null").select(F.col("path").alias("doc_id"), F.lit("parsing").alias("stage"), F.col("error").alias("detail"))
    others = files.filter(~word)
    if extractor is not None:
        spans = written(spans_of(others, extractor), "spans")
        blocks = blocks.unionByName(layout_blocks(page_blocks(spans)))
        broken = broken.unionByName(unreadable(spans, others).select(F.col("path").alias("doc_id"), F.lit("parsing").alias("stage"), F.lit("no text").alias("detail")))
    else:
        broken = broken.unionByName(others.select(F.col("path").alias("doc_id"), F.lit("parsing").alias("stage"), F.lit("no extractor").alias("detail")))
    elements, sections, documents = library_tables(blocks)
    run = index_run(elements, sections, documents=documents, **more)
    errors = run.errors.unionByName(broken)
    return IndexRun(run.points, errors, run_statistics(files.select(F.col("path").alias("doc_id")), run.points.select(F.col("document_id").alias("doc_id")), run.points, errors))


def index(elements: DataFrame, sections: DataFrame, **more) -> DataFrame:
    """Only the points of ``index_run``."""
    return index_run(elements, sections, **more).points


def search(queries: DataFrame, points: DataFrame, *, k: int = 20, threshold: float | None = None, match: Sequence[str] = ()) -> DataFrame:
    """Candidates of each query (``query_id``, ``vector``): the points with the largest cosine, with their payload, ``score`` and ``rank``.

    ``match`` are columns of ``queries`` that a point must have alike, all of them; null doesn't matter. Columns that points
    lack match nothing. Of the collection, the payload of the points that were found is read, and nothing else is shuffled
    if they are few.
    """
    lacking = {c: F.lit(None).cast("string") for c in match if c not in points.columns}
    found = written(nearest(points.withColumns(lacking), queries, id="point_id", vector="vector", query_id="query_id", query_vector="vector", k=k, threshold=threshold, match=match).withColumnRenamed("id", "point_id"), "found")
    wanted = found.select("point_id").distinct()
    if wanted.limit(FEW_POINTS + 1).count() <= FEW_POINTS:
        wanted = F.broadcast(wanted)
    payloads = points.drop("vector", "embedding_text").join(wanted, "point_id", "left_semi").dropDuplicates(["point_id"])
    return join_spread(found, payloads, ["point_id"], ["query_id"])


def retrieve_references(queries: DataFrame, points: DataFrame, *, key: str, limit: int = 3, provider: Callable[[], EmbeddingProvider] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """The references of each search of a section (``key``, ``section_id``, ``reference_type``, ``query``), by rank.

    Only points of the role of reference knowledge are searched, whatever a search wants; one that has a ``document_role`` and wants another is
    refused before anything is searched. ``reference_id`` is the point's id; ``chunk_id``, ``source_document``, ``score`` and ``content`` are its own.
    """
    if "document_role" in queries.columns and not queries.filter((F.col("document_role") != REFERENCE_ROLE)).isEmpty():
        raise PermissionError(f"searches of proposals need documents of the role {REFERENCE_ROLE}")
    id_ = F.sha2(F.concat_ws("\u0000", F.col(key).cast("string"), "section_id", "reference_type"), 256)
    asked = written(queries.select(id_.alias("query_id"), key, "section_id", "reference_type", F.col("query").alias("text"), F.lit(REFERENCE_ROLE).alias("document_role")), "searches")
    vectors = asked.withColumn("vector", mock_embedding(F.col("text"), dimensions)) if provider is None else embedded(asked, text="text", provider=provider)
    found = search(vectors.select("query_id", "vector", "document_role"), points, k=limit, match=["document_role"]).select("query_id", "rank", "point_id", "chunk_id", "source_document", "score", "original_text")
    return found.join(asked.select("query_id", key, "section_id", "reference_type"), "query_id").select(
        key, "section_id", "reference_type", "rank", F.col("point_id").alias("reference_id"), "chunk_id", "source_document", "score", F.col("original_text").alias("content")
    )


#: Parameters of a question and the field of a point that each must equal.
FILTERS = {"document": "source_document", "department": "department", "version": "version"}


def ask(
    questions: DataFrame,
    points: DataFrame,
    *,
    top_k: int = 5,
    candidate_budget: int = 20,
    threshold: float = 0.0,
    context_tokens: int = 4000,
    provider: Callable[[], EmbeddingProvider] | None = None,
    cache: DataFrame | None = None,
    reranker: Callable[[], Reranker] | None = None,
    models: Sequence[Callable[[], LanguageModel]] = (StubModel,),
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """The prompt of every question (``query_id``, ``question``, and ``history`` if there is one) and the answer to it.

    Parameters in a question (``document: x``) restrict the points, all at once. Candidates below ``threshold``, blank, or like an
    accepted one are dropped, neighbours are merged, and of what is left the first ``top_k``, or with a reranker its best, are the
    context. Refused questions come back with ``rejection`` and without a prompt; those without a context are still asked.
    ``text``, ``model``, ``attempts`` and ``error`` are of the models, which are tried in order. Without a provider vectors are made of hashes.
    """
    history = ["history"] if "history" in questions.columns else []
    asked = questions.select("query_id", F.col("question").alias("raw"), *history).withColumn("rejection", rejection(F.col("raw")))
    good = written(processed(qualified(asked.filter("rejection is null"), text="raw"), text="raw").withColumnsRenamed({a: f"__{a}" for a in FILTERS}).withColumnsRenamed({f"__{a}": b for a, b in FILTERS.items()}), "questions")
    if provider is None:
        vectors = good.withColumn("vector", mock_embedding(F.col("normalized"), dimensions))
    else:
        vectors = embedded(good, text="normalized", provider=provider, cache=cache)
    found = search(vectors.select("query_id", "vector", *FILTERS.values()), points, k=candidate_budget, match=list(FILTERS.values()))
    hits = written(drop_reasons(found, score="score", text="original_text", threshold=threshold).filter("drop_reason is null"), "hits")
    hits = hits.withColumn("place", F.concat_ws("/", "document_id", "chunk_index"))
    kept = without_near_duplicates(hits, group=["query_id"], rank="rank", identities=["chunk_id", "place", "content_hash"], budget=candidate_budget)
    merged = merged_neighbours(kept, group=["query_id"], rank="rank", document="document_id", path="section_path", index="chunk_index", text="original_text", score="score", id="chunk_id")
    # places after folding and merging, so that candidates beyond the first hits take the places of those that are gone
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")).alias("rank")
    ranked = merged.select("*", place).withColumnsRenamed({"original_text": "text", "section_path": "header_path"}).withColumn("page", F.lit(None).cast("int"))
    to_ask = good.select("query_id", F.col("normalized").alias("question"), *history)
    if reranker is not None:
        ranked = written(ranked, "ranked")
        scores = scored_by(ranked, to_ask, group="query_id", index="rank", text="text", budget=candidate_budget, provider=reranker)
        order = reranked(scores, group="query_id", index="rank", score="score", budget=candidate_budget + 1, top_k=top_k, place="new_rank").select("query_id", "rank", "new_rank")
        ranked = ranked.join(order, ["query_id", "rank"]).drop("rank").withColumnRenamed("new_rank", "rank")
    context = budgeted(ranked.filter(F.col("rank") <= top_k), query="query_id", rank="rank", text="text", budget=context_tokens)
    ready = written(prompts(context, to_ask, query="query_id"), "prompts")
    answers = ready.join(generated(ready, key="query_id", models=list(models)).drop("prompt_tokens"), "query_id")
    return asked.select("query_id", "rejection").join(answers, "query_id", "left")


def publish(blocks: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Errors of generated blocks, and the lines to print of proposals without any.

    Errors: ``proposal_id``, ``error``, ``subject``. Lines: as ``render_operations`` gives them.
    """
    blocks = written(once(blocks), "blocks")
    broken = block_errors(blocks).join(blocks.select("block_id", "proposal_id"), "block_id").select("proposal_id", "error", F.col("block_id").cast("string").alias("subject"))
    errors = written(broken.unionByName(document_errors(blocks, declared)), "errors")
    return errors, proposal_queries.printed(blocks.join(errors.select("proposal_id").distinct(), "proposal_id", "left_anti"), declared)


def _ask_eval_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every held-out passage asked against the index of all library documents."""
    points = index(table(spark, folder, "elements"), table(spark, folder, "sections"))
    questions = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return ask(questions, points).select("query_id", "rejection", "context_tokens", "prompt_tokens", F.sha2("context_block", 256).alias("context_hash"))


def _published_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the proposals that break no rule."""
    return publish(table(spark, folder, "transport_blocks"), table(spark, folder, "knowledge_refs"))[1].withColumn("op_ord", F.col("op_ord").cast("long"))


def _index_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points of all library documents, without their vectors."""
    return index(table(spark, folder, "elements"), table(spark, folder, "sections")).select("chunk_id", "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("point_id").alias("point_uuid"), F.size("vector").alias("dimensions"))


def _index_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Library documents that can't be indexed, and why."""
    return index_run(table(spark, folder, "elements"), table(spark, folder, "sections")).errors


def _index_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a run over all library documents, of which those that came before July 2024 were indexed already."""
    elements, sections = table(spark, folder, "elements"), table(spark, folder, "sections")
    first = elements.groupBy("doc_id").agg(F.min("ingested_at").alias("at")).filter(F.col("at") < F.lit("2024-07-01").cast("timestamp"))
    before = fingerprints(unique(elements), sections).join(first, "doc_id", "left_semi").select("document_fingerprint")
    return index_run(elements, sections, indexed=before).statistics


def _word_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all proposals, written as Word documents and read again: the blocks of each, their levels and texts."""
    printed = proposal_queries.printed(once(table(spark, folder, "transport_blocks")), table(spark, folder, "knowledge_refs"))
    files = written(composed_documents(printed.filter("kind <> 'table_row'")), "word").select(F.col("proposal_id").alias("path"), F.sha2("content", 256).alias("fingerprint"), "content")
    return docx_blocks(read_docx(files)).select(F.col("doc_id").alias("proposal_id"), F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), "text")


def _package_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the packages of all proposals, printed as Word documents."""
    printed = proposal_queries.printed(once(table(spark, folder, "transport_blocks")), table(spark, folder, "knowledge_refs"))
    parts = package_parts(composed_documents(printed).select(F.col("proposal_id").alias("path"), "content"))
    return package_inventory(parts).select(F.col("path").alias("proposal_id"), "parts", "table_rows", "tables")


def _section_references(spark: SparkSession, folder: str) -> DataFrame:
    """The 3 best points for every search of every proposal's sections."""
    points = index(table(spark, folder, "elements"), table(spark, folder, "sections"))
    found = retrieve_references(proposal_queries.QUERIES["section_searches"](spark, folder), points, key="proposal_id")
    return found.select("proposal_id", "section_id", "reference_type", F.col("rank").cast("long").alias("rank"), "reference_id", "chunk_id", F.round("score", 6).alias("score"), F.sha2("content", 256).alias("content_hash"))


QUERIES = {"section_references": _section_references, "ask_pipeline": _ask_eval_items, "published_lines": _published_lines, "indexed_points": _index_points, "index_errors": _index_errors, "index_run_statistics": _index_statistics, "word_round_trip": _word_round_trip, "package_statistics": _package_statistics}
_BROKEN = f"""SELECT proposal_id FROM transport_blocks JOIN ({proposal_queries.ORACLE_SQL['transport_errors']}) USING (block_id) UNION ALL SELECT proposal_id FROM ({proposal_queries.ORACLE_SQL['transport_document_errors']})"""
_INDEX_ERRORS = f"""SELECT doc_id, 'validation' AS stage, string_agg(DISTINCT code, ',' ORDER BY code) AS detail FROM ({LIBRARY_FINDINGS_SQL}) WHERE severity = 'error' GROUP BY 1"""
_VALID = f"(SELECT * FROM ({POINTS_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_INDEX_ERRORS})))"
_DUE = "(SELECT doc_id FROM elements GROUP BY 1 HAVING min(ingested_at) >= TIMESTAMPTZ '2024-07-01 00:00:00+00')"
ORACLE_SQL = {
    "published_lines": f"SELECT * FROM ({proposal_queries.ORACLE_SQL['render_ops']}) WHERE proposal_id NOT IN ({_BROKEN})",
    "indexed_points": f"SELECT chunk_id, doc_id AS document_id, chunk_index, {proposal_queries._uuid5_sql('chunk_id')} AS point_uuid, {DIMENSIONS} AS dimensions FROM {_VALID}",
    "index_errors": _INDEX_ERRORS,
    "word_round_trip": f"""SELECT proposal_id, row_number() OVER (PARTITION BY proposal_id ORDER BY op_ord) - 1 AS pos, CASE WHEN kind = 'heading' THEN 1 END AS level, text
FROM ({proposal_queries.ORACLE_SQL['render_ops']}) WHERE kind NOT IN ('table_row', 'page_break') AND NOT {sql.blank('text')}""",
    "package_statistics": f"""SELECT proposal_id, 4 AS parts, CAST(count(*) FILTER (WHERE kind = 'table_row') AS BIGINT) AS table_rows, CAST(count(*) FILTER (WHERE kind = 'table_row' AND (style = 'table_header' OR last IS DISTINCT FROM 'table_row')) AS BIGINT) AS tables
FROM (SELECT *, lag(kind) OVER (PARTITION BY proposal_id ORDER BY op_ord) AS last FROM ({proposal_queries.ORACLE_SQL['render_ops']})) GROUP BY 1""",
    "index_run_statistics": f"""WITH p AS (SELECT * FROM {_VALID} WHERE doc_id IN {_DUE}), e AS (SELECT doc_id FROM ({_INDEX_ERRORS}) WHERE doc_id IN {_DUE}), d AS (SELECT count(DISTINCT doc_id) AS discovered FROM elements)
SELECT discovered, (SELECT count(DISTINCT doc_id) FROM p) AS indexed, (SELECT count(*) FROM p) AS chunks, (SELECT count(DISTINCT content_hash) FROM p) AS embedded_texts, (SELECT count(*) FROM e) AS failed,
discovered - (SELECT count(DISTINCT doc_id) FROM p) - (SELECT count(*) FROM e) AS skipped FROM d""",
}


_VECTOR = lambda text: f"list_transform(range(32), lambda i: CAST(('0x' || substr(sha256({text} || ':0'), CAST(i * 2 + 1 AS INTEGER), 2)) AS INTEGER) / 255.0::DOUBLE)"
_PARAMETER = lambda name: sql.trim(rf"nullif(regexp_extract(raw, '(?i)\b{name}\s*[:=]\s*([^,;]+)', 1), '')")
_EMBEDDED = f"""concat_ws(chr(10), CASE WHEN coalesce({sql.trim('title')}, '') <> '' THEN 'Document: ' || title END, CASE WHEN len(path) > 0 THEN 'Section Path: ' || array_to_string(path, ' > ') END, 'Element Type: ' || element_type) || chr(10) || chr(10)
|| CASE WHEN head <> '' AND starts_with(text, head) THEN {sql.trim('substr(text, length(head) + 1)')} ELSE text END"""
ORACLE_SQL["section_references"] = f"""WITH points AS MATERIALIZED (SELECT chunk_id, {proposal_queries._uuid5_sql('chunk_id')} AS point_id, text, {_VECTOR(sql.norm(f"({_EMBEDDED})"))} AS v FROM {_VALID}),
q AS (SELECT *, {_VECTOR(sql.norm('query'))} AS v FROM ({proposal_queries.ORACLE_SQL['section_searches']})), s AS (SELECT q.proposal_id, section_id, reference_type, point_id, chunk_id, text, round(list_cosine_similarity(p.v, q.v), 12) AS score FROM q, points p),
r AS (SELECT *, row_number() OVER (PARTITION BY proposal_id, section_id, reference_type ORDER BY score DESC, point_id) AS rank FROM s)
SELECT proposal_id, section_id, reference_type, rank, point_id AS reference_id, chunk_id, round(score, 6) AS score, sha256(text) AS content_hash FROM r WHERE rank <= 3"""
ORACLE_SQL["ask_pipeline"] = f"""WITH RECURSIVE points AS MATERIALIZED (SELECT chunk_id, {proposal_queries._uuid5_sql('chunk_id')} AS point_id, doc_id, title, chunk_index, path, text, content_hash, {_VECTOR(sql.norm(f"({_EMBEDDED})"))} AS v FROM {_VALID}),
asked AS (SELECT item_id AS query_id, text AS raw, {sql.norm('nfc_normalize(text)')} AS question, CASE WHEN {sql.blank('text')} THEN 'empty' WHEN length(text) > 10000 THEN 'too_long'
  WHEN regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') THEN 'control_character' END AS rejection FROM eval_items),
good AS (SELECT *, {_VECTOR('question')} AS v, {_PARAMETER('document')} AS document, {_PARAMETER('department')} AS department, {_PARAMETER('version')} AS version FROM asked WHERE rejection IS NULL),
scored AS (SELECT query_id, p.*, round(list_cosine_similarity(p.v, g.v), 12) AS score FROM good g JOIN points p ON (document IS NULL OR document = title) AND department IS NULL AND version IS NULL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM scored) WHERE rank <= 20 AND score >= 0 AND NOT {sql.blank('text')}),
n AS MATERIALIZED (SELECT query_id, rank, chunk_id, doc_id || '/' || chunk_index AS place, content_hash, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM hits),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS r, CAST(NULL AS BIGINT) AS rank, FALSE AS kept, CAST([] AS VARCHAR[]) AS seen FROM n
  UNION ALL SELECT query_id, r, rank, ok, CASE WHEN ok THEN list_concat(seen, mine) ELSE seen END FROM (SELECT n.query_id, n.r, n.rank, f.seen, ['k' || chunk_id, 'p' || place, 'h' || content_hash] AS mine,
    NOT list_has_any(seen, ['k' || chunk_id, 'p' || place, 'h' || content_hash]) AS ok FROM f JOIN n ON n.query_id = f.query_id AND n.r = f.r + 1)),
k AS (SELECT h.* FROM hits h JOIN f ON f.query_id = h.query_id AND f.rank = h.rank WHERE kept),
a AS (SELECT *, CASE WHEN lag(doc_id) OVER w = doc_id AND lag(path) OVER w = path AND chunk_index = lag(chunk_index) OVER w + 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
b AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS island FROM a),
m AS (SELECT query_id, island AS rank, any_value(doc_id) AS doc_id, any_value(path) AS path, string_agg(text, chr(10) || chr(10) ORDER BY b.rank) AS text FROM b GROUP BY query_id, island HAVING island <= 5),
t AS (SELECT *, {sql.tokens('text')} AS n FROM m), u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
c AS (SELECT query_id, rank, concat_ws(' ', '[c' || rank || ']', doc_id, nullif(array_to_string(path, ' > '), '')) AS line, least(n, 4000 - before) AS tokens,
  CASE WHEN n > 4000 - before THEN {sql.first_tokens('text', 'CAST(4000 - before AS BIGINT)')} ELSE text END AS text FROM u WHERE before < 4000),
x AS (SELECT query_id, sum(tokens) AS tokens, 'Context:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Citations:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS block FROM c GROUP BY 1)
SELECT asked.query_id, rejection, CASE WHEN rejection IS NULL THEN CAST(coalesce(tokens, 0) AS INTEGER) END AS context_tokens, CASE WHEN rejection IS NULL THEN CAST(coalesce(tokens, 0) + {len(SYSTEM_PROMPT.split())} + 1 + {sql.tokens('question')} AS INTEGER) END AS prompt_tokens,
CASE WHEN rejection IS NULL THEN sha256(coalesce(block, '')) END AS context_hash FROM asked LEFT JOIN x USING (query_id)"""
