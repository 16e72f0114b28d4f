"""Queries on vectors, candidates, citations and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestone.operators.candidates import drop_reasons, drop_summary, exact_duplicates, merged_neighbours, refined, reranked, score_gaps, without_near_duplicates
from quirestone.operators.context import SYSTEM_PROMPT, budgeted, citation_line, context_statistics, prompts, routed
from quirestone.operators.elements import rendered
from quirestone.functions.text import token_count
from quirestone.operators.generate import response_errors
from quirestone.operators.search import nearest
from quirestone.operators.skew import join_spread
from quirestone.operators.vector_index import centroids, indexed, nearest_by_index, recall
from quirestone.plans import sql
from quirestone.plans.document_queries import _ONCE, _RENDERED
from quirestone.session import written
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


_SCORES = {
    "cosine": "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))",
    "dot": "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))",
    "euclid": "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))",
}


def _knn_sql(metric: str, k: int, extra: str = "TRUE") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, {_SCORES[metric]} AS score FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND {extra})
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) {'ASC' if metric == 'euclid' else 'DESC'}, vec_id) AS rank FROM s) WHERE rank <= {k}"""


def _knn(spark: SparkSession, folder: str, metric: str, k: int, **more) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    found = nearest(rows, rows.filter("vec_id % 20 = 0"), id="vec_id", vector="embedding", query_id="vec_id", query_vector="embedding", k=k, metric=metric, **more)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_knn_sql("cosine", 20))
def knn_cosine(spark, folder):
    """The 20 most similar vectors to every twentieth one."""
    return _knn(spark, folder, "cosine", 20)


@query(_knn_sql("dot", 10))
def knn_dot(spark, folder):
    """The 10 vectors with the largest inner product."""
    return _knn(spark, folder, "dot", 10)


@query(_knn_sql("euclid", 10, "q.vec_id <> r.vec_id").replace("AND q.vec_id <> r.vec_id", ""))
def knn_euclid(spark, folder):
    """The 10 nearest vectors by distance."""
    return _knn(spark, folder, "euclid", 10)


@query(_knn_sql("cosine", 5, "q.label = r.label"))
def knn_filtered(spark, folder):
    """The 5 most similar vectors with the same label."""
    return _knn(spark, folder, "cosine", 5, match="label")


@query(_knn_sql("cosine", 20, f"{_SCORES['cosine']} >= 0.2"))
def knn_threshold(spark, folder):
    """The most similar vectors, 20 at most, with a similarity of 0.2 or more."""
    return _knn(spark, folder, "cosine", 20, threshold=0.2)


@query(
    f"""WITH b AS (SELECT *, CASE WHEN label = 0 THEN NULL ELSE embedding[1] >= 0 END AS wanted FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, {_SCORES['cosine']} AS score FROM b q JOIN embeddings r ON q.label = r.label AND (q.wanted IS NULL OR q.wanted = (r.embedding[1] >= 0)))
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
)
def knn_payload_filter(spark, folder):
    """The 5 most similar vectors with the same label and, unless the label is 0, the same sign of the first component."""
    rows = table(spark, folder, "embeddings").withColumn("positive", F.col("embedding")[0] >= 0)
    queries = rows.filter("vec_id % 20 = 0").withColumn("positive", F.when(F.col("label") != 0, F.col("positive")))
    found = nearest(rows, queries, id="vec_id", vector="embedding", query_id="vec_id", query_vector="embedding", k=5, match=["label", "positive"])
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) FILTER (WHERE vec_id % 20 = 0) AS queries, TRUE AS enough, count(*) AS indexed FROM embeddings")
def knn_index_recall(spark, folder):
    """Whether an index over all vectors finds 0.9 or more of the 10 nearest rows of every twentieth one."""
    rows = table(spark, folder, "embeddings")
    queries = rows.filter("vec_id % 20 = 0")
    centers = centroids(rows, vector="embedding")
    index = indexed(rows, centers, id="vec_id", vector="embedding")
    found = nearest_by_index(index, centers, queries, query_id="vec_id", query_vector="embedding", k=10, probes=max(16, len(centers) * 3 // 4))
    exact = nearest(rows, queries, id="vec_id", vector="embedding", query_id="vec_id", query_vector="embedding", k=10)
    return recall(found, exact).select("queries", (F.col("recall") >= 0.9).alias("enough"), F.lit(index.count()).alias("indexed"))


@query(
    f"""SELECT proposal_id, count(*) AS total, count(*) FILTER (WHERE r = 1) AS below_threshold, count(*) FILTER (WHERE r = 2) AS blank_text, count(*) FILTER (WHERE r = 0) AS kept
FROM (SELECT proposal_id, CASE WHEN score IS NULL OR isnan(score) OR score < 0.5 THEN 1 WHEN {sql.blank('content')} THEN 2 ELSE 0 END AS r FROM retrieved_refs) GROUP BY 1"""
)
def candidate_filter(spark, folder):
    """Candidates of every proposal that a threshold of 0.5 and the blank-text rule drop or keep."""
    return drop_summary(drop_reasons(table(spark, folder, "retrieved_refs"), score="score", text="content", threshold=0.5), ["proposal_id"])


@query(
    """SELECT query_id, count(*) AS duplicates FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id, citation_id, chunk_id, document_id, header_path, chunk_index, token_count, page, truncated) AS r FROM citations)
WHERE r > 1 GROUP BY 1"""
)
def exact_candidate_duplicates(spark, folder):
    """Citations that a query has again, in every column."""
    c = table(spark, folder, "citations")
    same = [x for x in c.columns if x != "query_id"]
    return exact_duplicates(c, group=["query_id"], same=same, order=["citation_id"]).filter("duplicate").groupBy("query_id").agg(F.count(F.lit(1)).alias("duplicates"))


_CITED = """cited AS (SELECT DISTINCT query_id, citation_id, CAST(substr(citation_id, 2) AS INTEGER) AS rank, chunk_id, document_id, header_path, chunk_index, page FROM citations)"""


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "citations").select("query_id", "citation_id", "chunk_id", "document_id", "header_path", "chunk_index", "page").distinct()
    return c.withColumn("rank", F.substr("citation_id", F.lit(2)).cast("int"))


@query(
    f"""WITH RECURSIVE {_CITED}, n AS (SELECT query_id, citation_id, chunk_id, place, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id, place) AS r
  FROM (SELECT *, document_id || '/' || chunk_index AS place FROM cited)),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS r, CAST(NULL AS VARCHAR) AS citation_id, CAST(NULL AS VARCHAR) AS chunk_id, FALSE AS kept, CAST([] AS VARCHAR[]) AS chunks, CAST([] AS VARCHAR[]) AS places FROM n
  UNION ALL SELECT query_id, r, citation_id, chunk_id, ok, CASE WHEN ok THEN list_append(chunks, chunk_id) ELSE chunks END, CASE WHEN ok THEN list_append(places, place) ELSE places END
  FROM (SELECT n.*, f.chunks, f.places, NOT list_contains(chunks, n.chunk_id) AND NOT list_contains(places, n.place) AS ok FROM f JOIN n ON n.query_id = f.query_id AND n.r = f.r + 1 AND n.r <= 20))
SELECT query_id, citation_id, chunk_id FROM f WHERE kept"""
)
def near_candidate_duplicates(spark, folder):
    """Candidates that are left when those with the chunk or the place of an accepted one are dropped."""
    c = _cited(spark, folder).withColumn("place", F.concat_ws("/", "document_id", "chunk_index"))
    return without_near_duplicates(c, group=["query_id"], rank="rank", identities=["chunk_id", "place"], budget=20).select("query_id", "citation_id", "chunk_id")


@query(
    f"""WITH {_CITED}, t AS (SELECT c.*, coalesce(e.content, '') AS text FROM cited c LEFT JOIN (SELECT element_id, min(content) AS content FROM elements GROUP BY 1) e ON c.chunk_id = e.element_id),
a AS (SELECT *, CASE WHEN lag(document_id) OVER w IS NOT DISTINCT FROM document_id AND lag(header_path) OVER w IS NOT DISTINCT FROM header_path AND chunk_index = lag(chunk_index) OVER w + 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY query_id ORDER BY rank, chunk_index)),
b AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY rank, chunk_index ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT query_id, min(rank) AS first_rank, count(*) AS merged, min(chunk_index) AS first_index, max(chunk_index) AS last_index, sha256(string_agg(text, chr(10) || chr(10) ORDER BY rank, chunk_index)) AS text_hash FROM b GROUP BY query_id, island"""
)
def adjacent_merge(spark, folder):
    """Citations of a query that follow each other in their document, as one."""
    texts = table(spark, folder, "elements").groupBy(F.col("element_id").alias("chunk_id")).agg(F.min("content").alias("text"))
    c = join_spread(_cited(spark, folder), texts, ["chunk_id"], ["query_id"], "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("score", F.lit(0.0))
    m = merged_neighbours(c, group=["query_id"], rank="rank", document="document_id", path="header_path", index="chunk_index", text="text", score="score")
    return m.select("query_id", "first_rank", "merged", "first_index", "last_index", F.sha2("text", 256).alias("text_hash"))


@query(
    f"""WITH RECURSIVE e AS (SELECT element_id, min(content) AS text, min(doc_id) AS doc_id FROM elements GROUP BY 1), a AS (SELECT c.*, CAST(substr(citation_id, 2) AS INTEGER) AS rank, text, doc_id, 1.0 / (1 + CAST(substr(citation_id, 2) AS INTEGER)) AS score FROM citations c LEFT JOIN e ON chunk_id = element_id),
m AS (SELECT *, CASE WHEN doc_id <> document_id THEN 'i' WHEN score < 0.1 THEN 't' WHEN {sql.blank('text')} THEN 'b' ELSE 'k' END AS r FROM a),
x AS (SELECT *, CASE WHEN r = 'k' AND row_number() OVER (PARTITION BY query_id, r, citation_id, chunk_id, document_id, header_path, chunk_index, token_count, page, truncated) > 1 THEN 'x' ELSE r END AS s FROM m),
n AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id, document_id || '/' || chunk_index, citation_id) AS n, chunk_id, document_id || '/' || chunk_index AS place, document_id, header_path, chunk_index, rank FROM x WHERE s = 'k'),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS n, FALSE AS kept, CAST([] AS VARCHAR[]) AS seen FROM n UNION ALL SELECT query_id, n, ok, CASE WHEN ok THEN list_concat(seen, mine) ELSE seen END
  FROM (SELECT n.query_id, n.n, seen, ['k' || chunk_id, 'p' || place] AS mine, NOT list_has_any(seen, ['k' || chunk_id, 'p' || place]) AS ok FROM f JOIN n ON n.query_id = f.query_id AND n.n = f.n + 1 AND n.n <= 20)),
g AS (SELECT n.* FROM n JOIN f ON n.query_id = f.query_id AND n.n = f.n WHERE kept),
h AS (SELECT *, CASE WHEN lag(document_id) OVER w IS NOT DISTINCT FROM document_id AND lag(header_path) OVER w IS NOT DISTINCT FROM header_path AND chunk_index = lag(chunk_index) OVER w + 1 THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY query_id ORDER BY rank, chunk_index)),
k AS (SELECT query_id, count(*) AS accepted, CAST(sum(new) AS BIGINT) AS kept FROM h GROUP BY 1)
SELECT x.query_id, count(*) AS total, count(*) FILTER (WHERE s = 'i') AS invalid_metadata, count(*) FILTER (WHERE s = 't') AS below_threshold, count(*) FILTER (WHERE s = 'b') AS blank_text, count(*) FILTER (WHERE s = 'x') AS exact_duplicates,
least(20, count(*) FILTER (WHERE s = 'k')) - coalesce(any_value(accepted), 0) AS near_duplicates, coalesce(any_value(accepted) - any_value(kept), 0) AS adjacent_merges, coalesce(any_value(kept), 0) AS kept FROM x LEFT JOIN k ON k.query_id = x.query_id GROUP BY 1"""
)
def processing_summary(spark, folder):
    """What becomes of the citations of every query as candidates, step by step."""
    texts = table(spark, folder, "elements").groupBy(F.col("element_id").alias("chunk_id")).agg(F.min("content").alias("text"), F.min("doc_id").alias("payload_document"))
    c = table(spark, folder, "citations").withColumn("rank", F.substr("citation_id", F.lit(2)).cast("int"))
    c = join_spread(written(c, "citations"), texts, ["chunk_id"], ["query_id"], "left")
    c = c.withColumns({"score": 1.0 / (1 + F.col("rank")), "place": F.concat_ws("/", "document_id", "chunk_index")})
    names = {"group": "query_id", "rank": "rank", "id": "citation_id", "document": "document_id", "path": "header_path", "index": "chunk_index", "text": "text", "score": "score"}
    return refined(c, identities=["chunk_id", "place"], threshold=0.1, budget=20, payload={"document_id": "payload_document"}, **names)[1]


@query(
    """WITH s AS (SELECT query_id, candidate_index, max(relevance_score) AS s FROM rerank_scores WHERE query_id IS NOT NULL AND isfinite(relevance_score) AND candidate_index < 20 GROUP BY ALL)
SELECT query_id, candidate_index, s AS relevance_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_index) AS rank FROM s) WHERE rank <= 5"""
)
def rerank_topk(spark, folder):
    """The best 5 of the first 20 candidates of every query."""
    r = reranked(table(spark, folder, "rerank_scores"), group="query_id", index="candidate_index", score="relevance_score", budget=20, top_k=5)
    return r.withColumn("rank", F.col("rank").cast("long"))


@query(
    """SELECT query_id, scored, distinct_, highest, scored = distinct_ AND lowest = 0 AND highest = scored - 1 AS complete
FROM (SELECT query_id, count(*) AS scored, count(DISTINCT candidate_index) AS distinct_, min(candidate_index) AS lowest, max(candidate_index) AS highest FROM rerank_scores WHERE query_id IS NOT NULL GROUP BY 1)"""
)
def rerank_completeness(spark, folder):
    """Whether every candidate of a query was scored once."""
    g = score_gaps(table(spark, folder, "rerank_scores"), group="query_id", index="candidate_index")
    return g.select("query_id", "scored", F.col("distinct").alias("distinct_"), "highest", "complete")


_TEXTS = f"{_ONCE}, e AS (SELECT element_id, min({_RENDERED}) AS text FROM once GROUP BY 1)"
_CONTEXT = f"""WITH {_CITED}, {_TEXTS}, t AS (SELECT c.*, e.text, {sql.tokens('e.text')} AS n FROM cited c JOIN e ON c.chunk_id = e.element_id WHERE NOT {sql.blank('e.text')}),
u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
context AS (SELECT query_id, rank, 'c' || rank AS citation_id, document_id, page, header_path, CAST(before AS BIGINT) AS tokens_before, CAST(least(n, 400 - before) AS BIGINT) AS tokens, n > 400 - before AS truncated,
  CASE WHEN n > 400 - before THEN {sql.first_tokens('text', 'CAST(400 - before AS BIGINT)')} ELSE text END AS text FROM u WHERE before < 400)"""


def _context(spark: SparkSession, folder: str) -> DataFrame:
    cited = written(_cited(spark, folder), "cited")
    elements = table(spark, folder, "elements").withColumnRenamed("element_id", "chunk_id").join(cited.select("chunk_id").distinct(), "chunk_id", "left_semi")
    texts = elements.groupBy("chunk_id").agg(F.min(rendered()).alias("text"))
    return budgeted(join_spread(cited.drop("citation_id"), texts, ["chunk_id"], ["query_id"]), query="query_id", rank="rank", text="text", budget=400)


@query(f"{_CONTEXT} SELECT query_id, citation_id, tokens_before, tokens, truncated, text FROM context")
def budget_assembly(spark, folder):
    """Citations of every query that fit into 400 tokens, the last one cut."""
    return _context(spark, folder).select("query_id", "citation_id", "tokens_before", "tokens", "truncated", "text")


@query(f"{_CONTEXT} SELECT query_id, count(*) AS citations, CAST(sum(tokens) AS BIGINT) AS used_tokens, bool_or(truncated) AS truncated FROM context GROUP BY 1")
def budget_statistics(spark, folder):
    """Tokens that every query's context uses."""
    return context_statistics(_context(spark, folder), "query_id")


_LINE = "concat_ws(' ', '[' || citation_id || ']', document_id, 'page ' || page, nullif(array_to_string(header_path, ' > '), ''))"


@query(f"WITH {_CITED} SELECT query_id, citation_id, chunk_id, {_LINE} AS line FROM cited")
def citation_lines(spark, folder):
    """Every citation as it is printed."""
    return _cited(spark, folder).select("query_id", "citation_id", "chunk_id", citation_line(F.col("citation_id"), F.col("document_id"), F.col("page"), F.col("header_path")).alias("line"))


@query(
    f"""{_CONTEXT}, b AS (SELECT query_id, 'Context:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Citations:' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY rank) AS block, sum(tokens) AS n FROM context GROUP BY 1),
q AS (SELECT DISTINCT query_id FROM citations)
SELECT q.query_id, sha256(coalesce(block, '')) AS context_hash, CAST(coalesce(n, 0) AS INTEGER) AS context_tokens, CAST(coalesce(n, 0) + {len(SYSTEM_PROMPT.split())} + 3 AS INTEGER) AS prompt_tokens FROM q LEFT JOIN b ON q.query_id = b.query_id"""
)
def prompt_statistics(spark, folder):
    """The prompt of every query: hash of its context, and tokens."""
    questions = table(spark, folder, "citations").select("query_id").distinct().withColumn("question", F.concat(F.lit("what "), "query_id"))
    p = prompts(_context(spark, folder), questions, query="query_id")
    return p.select("query_id", F.sha2("context_block", 256).alias("context_hash"), "context_tokens", "prompt_tokens")


@query(
    f"""WITH r AS (SELECT DISTINCT reference_id, content, source_document, score, chunk_id, retrieved_at, {sql.tokens('content')} AS n FROM retrieved_refs),
e AS (SELECT reference_id, unnest([CASE WHEN {sql.blank('content')} THEN 'blank_text' END, CASE WHEN {sql.blank('source_document')} THEN 'blank_model' END, CASE WHEN NOT coalesce(isfinite(score) AND score >= 0, FALSE) THEN 'invalid_latency' END, CASE WHEN n % 10 = 0 THEN 'invalid_tokens' END]) AS error FROM r)
SELECT reference_id, error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL"""
)
def response_problems(spark, folder):
    """What would be wrong with retrieved references, were they responses of a model: the score their latency, every tenth number of tokens a wrong sum."""
    r = table(spark, folder, "retrieved_refs").select("reference_id", "content", "source_document", "score", "chunk_id", "retrieved_at").distinct()
    n = token_count(F.col("content"))
    responses = r.select(
        "reference_id", F.col("content").alias("text"), F.col("source_document").alias("model"), F.lit("stop").alias("finish_reason"), F.col("score").alias("latency_ms"), n.alias("prompt_tokens"), F.lit(1).alias("completion_tokens"),
        (n + F.when(n % 10 == 0, 2).otherwise(1)).alias("total_tokens"), F.col("retrieved_at").alias("generated_at"),
    )
    return response_errors(responses, key="reference_id").groupBy("reference_id", "error").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT name, row_number() OVER (ORDER BY priority, cost, latency, name) AS attempt FROM (
SELECT s_name AS name, CASE WHEN s_nationkey % 5 = 0 THEN 100 ELSE s_nationkey END AS priority, s_suppkey % 3 AS cost, s_suppkey % 2 AS latency FROM supplier WHERE s_acctbal > 0)"""
)
def provider_routing(spark, folder):
    """Order in which providers are tried, with suppliers in their place."""
    s = table(spark, folder, "supplier")
    tiers = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    p = s.select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey").cast("int")).alias("priority"),
        F.element_at(tiers, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("cost_tier"),
        (F.col("s_suppkey") % 2).cast("string").alias("latency_tier"),
        (F.col("s_acctbal") > 0).alias("healthy"),
    )
    return routed(p).select("name", F.col("attempt").cast("long").alias("attempt"))


@query(
    """WITH r AS (SELECT query_id, min(scored_at) AS first_at, max(scored_at) AS last_at, count(*) AS n FROM rerank_scores WHERE query_id IS NOT NULL GROUP BY 1)
SELECT strftime(first_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS queries, CAST(sum(n) AS BIGINT) AS scores, max(n) AS most FROM r GROUP BY 1"""
)
def retrieval_telemetry(spark, folder):
    """Queries and scores by month."""
    r = table(spark, folder, "rerank_scores").filter("query_id is not null").groupBy("query_id").agg(F.min("scored_at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    return r.groupBy(F.date_format("first_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("scores"), F.max("n").alias("most"))
