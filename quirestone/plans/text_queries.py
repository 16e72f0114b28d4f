"""Queries on texts: tokens, hashes, embeddings, questions, languages, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestone.functions.text import content_hash, first_tokens, normalize_ws, token_count
from quirestone.operators.embed import embedded, is_valid_vector, mock_embedding
from quirestone.operators.index import invalid_points, not_yet_indexed, upsert_counts, upserted, version_changes
from quirestone.operators.qualify import SCRIPTS, clarifications, language, processed, qualified, rejection, retrieval_requests
from quirestone.operators.structure import looks_upper, outline, text_blocks, titles
from quirestone.operators.transport import has_markdown, markdown_tables
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


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query(f"SELECT doc_id, {sql.tokens('text')} AS tokens FROM documents")
def token_counts(spark, folder):
    """Tokens of every document."""
    return _documents(spark, folder).select("doc_id", token_count(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, sha256({sql.norm('text')}) AS content_hash FROM documents")
def content_hashes(spark, folder):
    """Hash of every document's normalized text."""
    return _documents(spark, folder).select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, {sql.first_tokens('text', '100')} AS head FROM documents WHERE text IS NOT NULL")
def truncated_texts(spark, folder):
    """The first 100 tokens of every document, white space inside kept."""
    return _documents(spark, folder).filter("text is not null").select("doc_id", first_tokens(F.col("text"), F.lit(100)).alias("head"))


@query(f"SELECT content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256({sql.norm('text')}) AS content_hash FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, folder):
    """Contents that several documents have."""
    hashed = _documents(spark, folder).filter("text is not null").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(
    f"""SELECT doc_id, i AS component, CAST(('0x' || substr(sha256({sql.norm('text')} || ':0'), CAST(i * 2 + 1 AS INTEGER), 2)) AS INTEGER) / 255.0::DOUBLE AS value
FROM documents, (SELECT unnest(range(16)) AS i) WHERE text IS NOT NULL"""
)
def mock_embeddings(spark, folder):
    """Deterministic vectors of 16 components, a row each."""
    vectors = _documents(spark, folder).filter("text is not null").select("doc_id", mock_embedding(F.col("text"), 16).alias("v"))
    return vectors.select("doc_id", F.posexplode("v").alias("component", "value")).withColumn("component", F.col("component").cast("long"))


class _HashProvider:
    """A stand-in for an embedding service: the bytes of the text's hash."""

    dimensions = 8

    def embed(self, texts):
        import hashlib

        return [[b / 255 for b in hashlib.sha256(" ".join(t.split()).encode()).digest()[:8]] for t in texts]


@query(
    f"""WITH d AS (SELECT doc_id, ingested_at, sha256({sql.norm('text')}) AS hash FROM documents WHERE text IS NOT NULL),
known AS (SELECT DISTINCT hash FROM d WHERE ingested_at < TIMESTAMPTZ '2024-07-01 00:00:00+00')
SELECT doc_id, d.hash, hash IN (SELECT hash FROM known) AS cache_hit, round(CAST(('0x' || substr(d.hash, 1, 2)) AS INTEGER) / 255.0::DOUBLE, 6) AS first_component FROM d"""
)
def embed_dedup(spark, folder):
    """Every document with a vector, each distinct text embedded once, those of before July 2024 from the cache."""
    docs = _documents(spark, folder).filter("text is not null").select("doc_id", "text", "ingested_at")
    before = docs.filter(F.col("ingested_at") < F.lit("2024-07-01").cast("timestamp"))
    cache = embedded(before.select("text"), text="text", provider=_HashProvider).select("hash", "vector").dropDuplicates(["hash"])
    rows = embedded(docs, text="text", provider=_HashProvider, cache=cache)
    return rows.select("doc_id", "hash", "cache_hit", F.round(F.col("vector")[0], 6).alias("first_component"))


@query("SELECT vec_id, len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0 AS valid FROM embeddings")
def vector_validity(spark, folder):
    """Whether every vector has 64 finite components."""
    return table(spark, folder, "embeddings").select("vec_id", is_valid_vector(F.col("embedding"), 64).alias("valid"))


@query(
    f"""WITH d AS (SELECT doc_id, ingested_at, sha256(coalesce(text, '')) AS fingerprint FROM documents)
SELECT doc_id, fingerprint FROM d WHERE ingested_at >= TIMESTAMPTZ '2024-07-01 00:00:00+00'
AND fingerprint NOT IN (SELECT fingerprint FROM d WHERE ingested_at < TIMESTAMPTZ '2024-07-01 00:00:00+00')"""
)
def incremental_skip(spark, folder):
    """Documents of July 2024 and later whose text wasn't there before."""
    docs = _documents(spark, folder).select("doc_id", "ingested_at", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))
    old = F.col("ingested_at") < F.lit("2024-07-01").cast("timestamp")
    return not_yet_indexed(docs.filter(~old), docs.filter(old), fingerprint="fingerprint").select("doc_id", "fingerprint")


@query(
    """WITH m AS (SELECT quantile_disc(ingested_at, 0.5) AS t FROM elements), p AS (SELECT element_id AS id FROM elements, m WHERE ingested_at <= t), n AS (SELECT DISTINCT element_id AS id FROM elements, m WHERE ingested_at > t)
SELECT count(*) FILTER (WHERE id NOT IN (SELECT id FROM p)) AS inserted, count(*) FILTER (WHERE id IN (SELECT id FROM p)) AS updated FROM n"""
)
def upsert_statistics(spark, folder):
    """Elements of the later half of all deliveries that the collection of the earlier half lacks or has."""
    e = table(spark, folder, "elements").select(F.col("element_id").alias("id"), "ingested_at")
    half = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(ingested_at))")).first()[0]
    old = F.unix_micros("ingested_at") <= F.lit(half)
    return upsert_counts(e.filter(old), e.filter(~old), id="id")


@query(
    """WITH n AS (SELECT vec_id, label + 100 AS label, embedding FROM embeddings WHERE label >= (SELECT avg(label) FROM embeddings)),
c AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n)
SELECT vec_id, label, round(CAST(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS DOUBLE), 4) AS total FROM c"""
)
def upserted_collection(spark, folder):
    """The collection of all embeddings after those with a label of the mean or above have been written again with another one."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    again = e.filter(F.col("label") >= e.agg(F.avg("label")).scalar()).withColumn("label", F.col("label") + 100)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return upserted(e, again, id="vec_id").select("vec_id", "label", F.round(total, 4).alias("total"))


@query("SELECT element_id AS id, 'duplicate_id' AS reason FROM elements GROUP BY 1 HAVING count(*) > 1")
def point_errors(spark, folder):
    """Ids that come more than once in a batch of points."""
    points = table(spark, folder, "elements").select(F.col("element_id").alias("id"), F.array(F.col("order_index").cast("double")).alias("v"))
    return invalid_points(points, id="id", vector="v", dimensions=1)


@query(
    """WITH v AS (SELECT source, lead(source) OVER (ORDER BY source) AS next FROM (SELECT DISTINCT source FROM documents WHERE title IS NOT NULL AND source IS NOT NULL)),
t AS (SELECT source, title, list_sort(list(DISTINCT coalesce(sha256(text), '-'))) AS texts FROM documents WHERE title IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
o AS (SELECT source AS before, next AS after, title, texts FROM v JOIN t USING (source) WHERE next IS NOT NULL), n AS (SELECT v.source AS before, next AS after, title, texts FROM v JOIN t ON t.source = v.next)
SELECT coalesce(o.before, n.before) AS before, coalesce(o.after, n.after) AS after, coalesce(o.title, n.title) AS title, CASE WHEN o.title IS NULL THEN 'added' WHEN n.title IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.before = n.before AND o.title = n.title WHERE o.title IS NULL OR n.title IS NULL OR o.texts <> n.texts"""
)
def package_changes(spark, folder):
    """Titles that a source or the next one has alone, or with other texts."""
    return version_changes(_documents(spark, folder).filter("title is not null"), version="source", part="title", content="text")


# --- questions -------------------------------------------------------------------------------

_QUESTION = "concat('What about ', coalesce(title, ''), '?', coalesce(' document: ' || source, ''), coalesce(', department: ' || document_type, ''), coalesce(', version: ' || version, ''), CASE WHEN doc_id % 7 = 0 THEN ', document: other or ' || source ELSE '' END)"


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.expr(_QUESTION).alias("q"))


_QUALIFIED_SQL = f"""WITH q AS (SELECT doc_id, {_QUESTION} AS q FROM documents),
x AS (SELECT doc_id, q, list_transform(regexp_extract_all(q, '(?i)\\b(document|department|version)\\s*[:=]\\s*([^,;]+)', 1), lambda k: lower(k)) AS ks,
  list_transform(regexp_extract_all(q, '(?i)\\b(document|department|version)\\s*[:=]\\s*([^,;]+)', 2), lambda v: {sql.trim('v')}) AS vs FROM q),
y AS (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(q, '(?i)\\b(document|department|version)\\s*[:=]\\s*([^,;]+)', '', 'g'), '({sql.WS_CLASS}|[,;])+$', ''), '^({sql.WS_CLASS}|[,;])+', '') AS question,
  list_transform(['document', 'department', 'version'], lambda p: list_transform(list_filter(list_zip(ks, vs), lambda z: z[1] = p), lambda z: z[2])) AS per FROM x),
z AS (SELECT doc_id, question, per[1][1] AS document, per[2][1] AS department, per[3][1] AS version,
  len(list_filter(per, lambda v: len(list_filter(v, lambda w: regexp_matches(w, '(?i)\\s(or|and/or)\\s|/'))) > 0)) AS ambiguous,
  len(list_filter(per, lambda v: len(list_distinct(v)) > 1)) AS conflicting FROM y)
SELECT *, round(greatest(0, 1 - 0.45 * CASE WHEN question = '' THEN 1 ELSE 0 END - 0.2 * ambiguous - 0.25 * conflicting)::DOUBLE, 2) AS confidence FROM z"""


@query(_QUALIFIED_SQL)
def query_parameters(spark, folder):
    """Parameters, ambiguities, conflicts and confidence of a question about every document."""
    q = qualified(_questions(spark, folder), text="q")
    return q.select("doc_id", "question", "document", "department", "version", F.size("ambiguous").cast("long").alias("ambiguous"), F.size("conflicting").cast("long").alias("conflicting"), "confidence")


@query(
    _QUALIFIED_SQL[: _QUALIFIED_SQL.rindex("SELECT *, round")].replace("SELECT doc_id, question, per[1][1]", "SELECT doc_id, question, per, per[1][1]")
    + """, a AS (SELECT doc_id, 0 AS k, 0 AS p, 'missing' AS kind, 'question' AS parameter FROM z WHERE question = ''
UNION ALL SELECT doc_id, 1, i, 'ambiguous', ['document', 'department', 'version'][i] FROM z, (SELECT unnest([1, 2, 3]) AS i) WHERE len(list_filter(per[i], lambda w: regexp_matches(w, '(?i)\\s(or|and/or)\\s|/'))) > 0
UNION ALL SELECT doc_id, 2, i, 'conflicting', ['document', 'department', 'version'][i] FROM z, (SELECT unnest([1, 2, 3]) AS i) WHERE len(list_distinct(per[i])) > 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, p) - 1 AS ord, kind, parameter FROM a"""
)
def query_clarifications(spark, folder):
    """What has to be asked back."""
    return clarifications(qualified(_questions(spark, folder), text="q"), "doc_id").withColumn("ord", F.col("ord").cast("long"))


_FILTER = " , ".join(f"CASE WHEN {p} IS NOT NULL THEN '\"{p}\":' || to_json({p}) END" for p in ("document", "department", "version"))


@query(
    _QUALIFIED_SQL[: _QUALIFIED_SQL.rindex("SELECT *, round")]
    + f"""SELECT doc_id, question, '{{' || concat_ws(',', {_FILTER}) || '}}' AS filters, CASE WHEN version IS NOT NULL THEN 30 ELSE 5 END AS top_k, CASE WHEN version IS NOT NULL THEN 30 ELSE 20 END AS candidate_budget, 0.0::DOUBLE AS score_threshold, 1000 AS max_latency_ms, 4000 AS max_context_tokens FROM z"""
)
def query_requests(spark, folder):
    """The search request of every question, its filters as JSON; those that name a version want 30 results."""
    q = qualified(_questions(spark, folder), text="q").withColumn("overrides", F.when(F.col("version").isNotNull(), F.create_map(F.lit("top_k"), F.lit("30"))))
    return retrieval_requests(q, "doc_id", overrides="overrides").withColumn("filters", F.to_json("filters"))


@query(
    f"""SELECT doc_id, n AS normalized, length(n) AS char_count, {sql.tokens('n')} AS word_count, CAST(ceil(length(n) / 4) AS BIGINT) AS estimated_tokens, 'query:' || sha256(n) AS cache_key
FROM (SELECT doc_id, {sql.norm('nfc_normalize(text)')} AS n FROM documents WHERE text IS NOT NULL)"""
)
def query_normalization(spark, folder):
    """Normal form and statistics of every text."""
    p = processed(_documents(spark, folder).filter("text is not null").select("doc_id", "text"), text="text")
    return p.select("doc_id", "normalized", F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"), "estimated_tokens", "cache_key")


_HITS = "{" + ", ".join(f"'{k}': len(regexp_extract_all(text, '[{v}]'))" for k, v in SCRIPTS.items()) + "}"


@query(
    f"""WITH h AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, {_HITS} AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN letters = 0 THEN 'en' {' '.join(f"WHEN h.{k} > 0 THEN '{k}'" for k in ('ar', 'hi', 'ru', 'zh', 'ja', 'ko'))} ELSE 'en' END AS language,
CASE WHEN letters = 0 THEN 0.0::DOUBLE {' '.join(f"WHEN h.{k} > 0 THEN round_even(h.{k} / letters, 2)" for k in ('ar', 'hi', 'ru', 'zh', 'ja', 'ko'))} ELSE 0.6::DOUBLE END AS confidence FROM h"""
)
def query_language(spark, folder):
    """Language of every text by its script."""
    rows = _documents(spark, folder).filter("text is not null").select("doc_id", language(F.col("text")).alias("x"))
    return rows.select("doc_id", "x.language", "x.confidence")


@query(
    f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {sql.blank('text')} THEN 'empty' WHEN length(text) > 10000 THEN 'too_long'
WHEN regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') THEN 'control_character' ELSE 'accepted' END AS reason FROM documents) GROUP BY 1"""
)
def query_guards(spark, folder):
    """How many texts could be asked as a question, and why the others couldn't."""
    return _documents(spark, folder).select(F.coalesce(rejection(F.col("text")), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- outlines --------------------------------------------------------------------------------

_LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM documents WHERE text IS NOT NULL)"
_BLOCKS = f"""lines AS ({_LINES}), blocks AS (
  SELECT doc_id, pos, CASE WHEN m <> '' THEN length(m) END AS level, CASE WHEN m <> '' THEN {sql.trim("regexp_replace(line, '^#{1,6}', '')")} ELSE line END AS text
  FROM (SELECT *, regexp_extract(line, '^(#{{1,6}})[ \\t]+\\S', 1) AS m FROM lines WHERE NOT {sql.blank('line')}))"""
_HEADS = ", ".join(f"last_value(CASE WHEN level = {k} THEN {{'pos': pos, 'text': text}} END IGNORE NULLS) OVER w AS h{k}" for k in range(1, 7))
_OPEN = ", ".join(f"CASE WHEN h{k}.pos > greatest(-1{''.join(f', coalesce(h{j}.pos, -1)' for j in range(1, k))}) THEN h{k} END" for k in range(1, 7))


@query(
    f"""WITH {_BLOCKS}, o AS (SELECT *, list_filter([{_OPEN}], lambda x: x IS NOT NULL) AS path FROM (
  SELECT *, {_HEADS}, sum(CASE WHEN level IS NULL THEN 1 ELSE 0 END) OVER w - 1 AS n FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)))
SELECT doc_id, pos, level, path[-1].pos AS section_pos, array_to_string(list_transform(path, lambda x: x.text), ' > ') AS section_path, CASE WHEN level IS NULL THEN CAST(n AS BIGINT) END AS order_index FROM o"""
)
def section_paths(spark, folder):
    """The section of every line of every document."""
    o = outline(text_blocks(_documents(spark, folder)))
    return o.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), F.col("section_pos").cast("long").alias("section_pos"), F.array_join("section_path", " > ").alias("section_path"), "order_index")


@query(f"WITH {_BLOCKS} SELECT doc_id, coalesce(arg_min(text, pos) FILTER (WHERE level IS NOT NULL), 'Untitled Document') AS title FROM blocks GROUP BY 1")
def inferred_titles(spark, folder):
    """The first heading of every document."""
    return titles(text_blocks(_documents(spark, folder)))


@query(
    f"""WITH {_BLOCKS} SELECT doc_id, count(*) AS upper_lines FROM blocks WHERE length(text) <= 160 AND len(regexp_extract_all(text, '\\p{{L}}')) > 0
AND len(regexp_extract_all(text, '\\p{{Lu}}')) >= len(regexp_extract_all(text, '\\p{{L}}')) * 0.8 GROUP BY 1"""
)
def uppercase_headings(spark, folder):
    """Lines that look like headings in capitals, by document."""
    return text_blocks(_documents(spark, folder)).filter(looks_upper(F.col("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("upper_lines"))


_ROW = "'| ' || array_to_string({}, ' | ') || ' |'"
_WRITTEN = f"""SELECT block_id AS doc_id, 'Values' || chr(10) || {_ROW.format('headers')} || chr(10) || {_ROW.format("list_transform(headers, lambda x: ':---')")} || chr(10)
|| array_to_string(list_transform(rows, lambda r: {_ROW.format('r')}), chr(10)) || chr(10) || 'a | b' || chr(10) || 'end' AS text FROM transport_blocks WHERE type = 'table'"""


@query(
    f"""WITH l AS ({_LINES.replace('FROM documents', f'FROM ({_WRITTEN})')}), c AS (
  SELECT *, list_transform(string_split(regexp_replace(trim(line, ' '), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x, ' ')) AS cells FROM l),
d AS (SELECT *, CASE WHEN contains(line, '|') AND len(cells) >= 2 THEN len(cells) END AS columns FROM c),
e AS (SELECT *, columns IS NOT NULL AND len(list_filter(cells, lambda x: NOT regexp_full_match(x, ':?-{{3,}}:?'))) = 0 AS rule FROM d),
f AS (SELECT *, columns IS NOT NULL AND NOT rule AND coalesce(lead(rule) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS head FROM (SELECT DISTINCT * FROM e)),
g AS (SELECT *, sum(CASE WHEN columns IS NULL OR head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, min(pos) AS first_line, count(*) AS lines, arg_min(columns, pos) AS columns FROM g WHERE columns IS NOT NULL GROUP BY doc_id, island HAVING arg_min(head, pos)"""
)
def markdown_table_blocks(spark, folder):
    """Markdown tables in the tables of generated documents, written as Markdown."""
    row = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    blocks = table(spark, folder, "transport_blocks").filter("type = 'table'").dropDuplicates(["block_id"])
    lines = [F.lit("Values"), row(F.col("headers")), row(F.transform("headers", lambda _: F.lit(":---"))), F.array_join(F.transform("rows", row), "\n"), F.lit("a | b"), F.lit("end")]
    text = F.array_join(F.array(*lines), "\n")
    t = markdown_tables(blocks.select(F.col("block_id").alias("doc_id"), text.alias("text")))
    return t.select("doc_id", F.col("first_line").cast("long").alias("first_line"), "lines", F.col("columns").cast("long").alias("columns"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '(?m)^\\s{0,3}(?:#{1,6}|[-*])\\s+'), FALSE) AS has_markdown FROM documents")
def markdown_flags(spark, folder):
    """Whether a document has Markdown headings or lists."""
    return _documents(spark, folder).select("doc_id", has_markdown(F.col("text")).alias("has_markdown"))


@query(f"SELECT coalesce(lower({sql.trim('lang')}), 'none') AS lang, count(*) AS documents, sum(n_chars) AS chars, avg({sql.tokens('text')}) AS mean_tokens, stddev_samp({sql.tokens('text')}) AS sd_tokens FROM documents GROUP BY 1 UNION ALL SELECT 'all', count(*), sum(n_chars), avg({sql.tokens('text')}), stddev_samp({sql.tokens('text')}) FROM documents")
def corpus_statistics(spark, folder):
    """Mean and deviation of document lengths, by language and of all."""
    docs = _documents(spark, folder).select(F.coalesce(F.lower(normalize_ws(F.col("lang"))), F.lit("none")).alias("lang"), "n_chars", token_count(F.col("text")).alias("t"))
    rolled = docs.rollup("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.avg("t").alias("mean_tokens"), F.stddev_samp("t").alias("sd_tokens"))
    return rolled.withColumn("lang", F.coalesce("lang", F.lit("all")))
