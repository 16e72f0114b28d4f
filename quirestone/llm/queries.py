"""The queries of problems 2 to 7, with SQL for those that SQL can express."""

from __future__ import annotations

import os
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirestone.functions.text import has_more_tokens, token_count
from quirestone.llm.leaks import leaked_spans
from quirestone.llm.looks import LOOK_ALIKES, consistent, look_alike_groups, look_alike_pairs
from quirestone.llm.neardup import groups_of_records, near_duplicates, pairs_of_records
from quirestone.llm.pack import packed, token_sizes
from quirestone.llm.split import split_oversized
from quirestone.llm.topn import top_n
from quirestone.operators.skew import hot_keys, repeat, spread
from quirestone.plans import sql
from quirestone.session import written
from quirestone.sources.tables import table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("QUIRESTONE_TOKENIZERS", "/opt/tokenizers")
#: Tokens of a piece, and tokens that it repeats of the one before.
LIMIT, OVERLAP = 500, 50

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _alike(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    paragraphs = table(spark, folder, "elements").filter("element_type = 'paragraph'").select(F.lit("elements").alias("space"), F.col("element_id").alias("key"), F.col("content").alias("text"))
    references = table(spark, folder, "retrieved_refs").select(F.lit("retrieved_refs").alias("space"), F.col("reference_id").alias("key"), F.col("content").alias("text"))
    return near_duplicates(paragraphs.unionByName(references), key="key", text="text", space="space", k=3, similarity="0.6", min_words=20)


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of paragraphs, and pairs of references, with nearly the same text."""
    return pairs_of_records(*_alike(spark, folder)).withColumnRenamed("space", "source_table")


@query
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every paragraph and reference of 20 or more words."""
    return groups_of_records(*_alike(spark, folder)).select(F.col("space").alias("source_table"), "key", "group_key", "links")


_SETS_SQL = r"""r AS (SELECT DISTINCT 'elements' AS space, element_id AS key, content AS text FROM elements WHERE element_type = 'paragraph' AND content IS NOT NULL AND element_id IS NOT NULL
  UNION SELECT 'retrieved_refs', reference_id, content FROM retrieved_refs WHERE content IS NOT NULL AND reference_id IS NOT NULL),
t AS (SELECT space, text, space || ':' || md5(text) AS class_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT space, text FROM r)),
s AS MATERIALIZED (SELECT space, class_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2])))) AS h FROM t WHERE len(w) >= 20),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.space = b.space AND a.class_id < b.class_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b WHERE 5 * common >= 3 * (x.n + y.n - common)),
c AS MATERIALIZED (SELECT DISTINCT space, key, class_id FROM r JOIN t USING (space, text) WHERE len(w) >= 20)""".replace("\\\\", "\\")
ORACLE_SQL["p4_found"] = f"""WITH {_SETS_SQL}, l AS (SELECT a, b FROM links UNION ALL SELECT DISTINCT class_id, class_id FROM c)
SELECT DISTINCT x.space AS source_table, least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b FROM l JOIN c x ON x.class_id = a JOIN c y ON y.class_id = b WHERE x.key <> y.key"""
ORACLE_SQL["p4_groups"] = f"""WITH RECURSIVE {_SETS_SQL}, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT class_id AS a, class_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS class_id, min(key) AS group_key FROM reach JOIN c ON c.class_id = reach.b GROUP BY 1), d AS (SELECT a AS class_id, count(*) AS links FROM e GROUP BY 1)
SELECT c.space AS source_table, key, group_key, coalesce(links, 0) AS links FROM c JOIN g USING (class_id) LEFT JOIN d USING (class_id)"""


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best candidates of every query and the 3 best references of every section and type of a proposal."""
    ranked = top_n(table(spark, folder, "rerank_scores"), groups=["query_id"], score="relevance_score", item="candidate_index", n=5)
    refs = top_n(table(spark, folder, "retrieved_refs"), groups=["proposal_id", "section_id", "reference_type"], score="score", item="reference_id", n=3)
    return ranked.select(F.lit("rerank_scores").alias("source_table"), F.col("query_id").alias("group_key"), F.col("candidate_index").cast("string").alias("item_key")).unionByName(
        refs.select(F.lit("retrieved_refs").alias("source_table"), F.concat_ws("/", "proposal_id", "section_id", "reference_type").alias("group_key"), F.col("reference_id").alias("item_key"))
    )


ORACLE_SQL["p3_found"] = """
WITH a AS (
  SELECT query_id, candidate_index, max(relevance_score) AS s FROM rerank_scores
  WHERE query_id IS NOT NULL AND candidate_index IS NOT NULL AND isfinite(relevance_score) GROUP BY ALL
), b AS (
  SELECT proposal_id || '/' || section_id || '/' || reference_type AS g, reference_id, max(score) AS s FROM retrieved_refs
  WHERE isfinite(score) GROUP BY ALL
)
SELECT 'rerank_scores' AS source_table, query_id AS group_key, CAST(candidate_index AS VARCHAR) AS item_key
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_index) AS r FROM a) WHERE r <= 5
UNION ALL
SELECT 'retrieved_refs', g, reference_id
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, reference_id) AS r FROM b) WHERE r <= 3
"""


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"), key="doc_id", text="text", item_key="item_id", item_text="text", k=12)


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 12 or more consecutive words of a test item, and the items."""
    return _leaks(spark, folder).select("doc_id", F.explode("item_ids").alias("item_id")).distinct()


_LEAKS_SQL = r"""WITH i AS (SELECT DISTINCT item_id, h FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS h
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL) WHERE len(w) >= 12)),
d AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS pos, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS h
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 12),
m AS (SELECT doc_id, pos - 1 AS pos, item_id FROM d JOIN i USING (h))"""
ORACLE_SQL["p6_found"] = f"{_LEAKS_SQL} SELECT DISTINCT doc_id, item_id FROM m"
ORACLE_SQL["p6_spans"] = f"""{_LEAKS_SQL}, o AS (SELECT DISTINCT doc_id, pos FROM m), b AS (SELECT *, sum(CASE WHEN pos <= prev + 12 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM o)),
g AS (SELECT doc_id, span, min(pos) AS start_word, max(pos) + 12 AS end_word FROM b GROUP BY ALL)
SELECT g.doc_id, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM g JOIN m ON m.doc_id = g.doc_id AND pos BETWEEN start_word AND end_word - 12 GROUP BY ALL"""


@query
def p6_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of words to remove from each such document."""
    return _leaks(spark, folder).select("doc_id", "start_word", "end_word", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items"))


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same and differ."""
    return look_alike_pairs(table(spark, folder, "documents"), key="doc_id", text="text").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def _form_sql() -> str:
    """The consistent form of ``text`` as a DuckDB expression, from Unicode's tables and the list of look-alikes."""
    wide = {chr(c): "".join(chr(int(x, 16)) for x in d.split()[1:]) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))).startswith(("<wide>", "<narrow>"))}
    look = dict(zip(LOOK_ALIKES.split()[::2], LOOK_ALIKES.split()[1::2]))
    composed = {}
    for c in map(chr, range(0x250, 0x2000)):  # Greek and Cyrillic letters that have their accents in them
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and apart[0] in look:
            composed[c] = unicodedata.normalize("NFC", look[apart[0]] + apart[1:])
    changed = look | composed
    one = {k: v for k, v in changed.items() if len(v) == 1}
    many = {k: v for k, v in changed.items() if len(v) > 1}
    text = "text"
    text = rf"nfc_normalize(regexp_replace({text}, '[\p{{Cf}}]', '', 'g'))"
    quoted = lambda x: x.replace("'", "''")
    text = f"nfc_normalize(translate({text}, '{quoted(''.join(wide))}', '{quoted(''.join(wide.values()))}'))"
    word = f"translate(w, '{''.join(one)}', '{''.join(one.values())}')"
    for k, v in many.items():
        word = f"replace({word}, '{k}', '{v}')"
    words = rf"regexp_extract_all({text}, '[\p{{L}}\p{{M}}\p{{Nd}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}]+')"
    text = rf"coalesce(array_to_string(list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '^[\p{{L}}\p{{M}}\p{{Nd}}]') AND regexp_matches(w, '\p{{Latin}}') THEN nfc_normalize({word}) ELSE w END), ''), '')"
    return sql.norm(text)


_FORMS_SQL = f"f AS (SELECT doc_id, text, {_form_sql()} AS form FROM documents WHERE text IS NOT NULL)"
ORACLE_SQL["p7_found"] = f"WITH {_FORMS_SQL}, g AS (SELECT * FROM f WHERE NOT {sql.blank('text')}) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"
ORACLE_SQL["p7_normalized"] = f"WITH {_FORMS_SQL} SELECT documents.doc_id, form AS text FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id"
ORACLE_SQL["p7_groups"] = f"""WITH {_FORMS_SQL}, g AS (SELECT DISTINCT doc_id, form, text FROM f WHERE NOT {sql.blank('text')}), n AS (SELECT form, count(DISTINCT text) AS texts, count(*) AS members FROM g GROUP BY 1)
SELECT doc_id, upper(md5(form)) AS form, upper(md5(text)) AS raw, texts, members FROM g JOIN n USING (form) WHERE texts > 1"""


@query
def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that look like a different one, in groups."""
    return look_alike_groups(table(spark, folder, "documents"), key="doc_id", text="text")


@query
def p7_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return consistent(table(spark, folder, "documents"), key="doc_id", text="text")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of oversized paragraphs, and of cited paragraphs together with their header path."""
    paragraphs = table(spark, folder, "elements").filter("element_type = 'paragraph'").select("element_id", "content")
    header = F.array_join("header_path", "\n")
    cited = table(spark, folder, "citations").select("query_id", "citation_id", "chunk_id", header.alias("header")).filter("chunk_id is not null").distinct()
    most = cited.agg(F.max(token_count(F.col("header")))).first()[0] or 0
    # no shorter paragraph can exceed the limit, whichever header it has
    long_ = paragraphs.filter(has_more_tokens(F.col("content"), LIMIT - most)).groupBy(F.col("element_id").alias("chunk_id")).agg(F.min("content").alias("content"))
    hot = hot_keys(cited, ["chunk_id"])
    joined = spread(cited, hot, ["chunk_id"], ["query_id", "citation_id"]).join(repeat(long_, hot, ["chunk_id"]), ["chunk_id", "__salt"])
    items = joined.select(
        F.lit("citations").alias("source_table"), F.concat_ws("/", "query_id", "citation_id").alias("item_key"), F.concat_ws("\n\n", F.nullif("header", F.lit("")), "content").alias("text")
    ).unionByName(
        paragraphs.filter(has_more_tokens(F.col("content"), LIMIT)).groupBy("element_id").agg(F.min("content").alias("text")).select(F.lit("elements").alias("source_table"), F.col("element_id").alias("item_key"), "text")
    )
    return split_oversized(items, keys=["source_table", "item_key"], text="text", limit=LIMIT, overlap=OVERLAP)


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs and citations that had to be split."""
    return _pieces(spark, folder).filter("pieces > 1").select("source_table", "item_key").distinct()


@query
def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all oversized paragraphs and citations."""
    return _pieces(spark, folder)


@query
def p2_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the pieces of every oversized text: their tokens in all, and whether they keep to the limit, overlap as they must and leave no gap."""
    each = Window.partitionBy("source_table", "item_key").orderBy("piece")
    before = lambda c: F.lag(c).over(each)
    repeats = F.least(F.lit(OVERLAP).cast("long"), before("end_token").cast("long"))
    p = _pieces(spark, folder).distinct().select(
        "source_table",
        "item_key",
        "end_token",
        (token_count(F.col("piece_text")) == F.col("end_token") - F.col("first_token")).alias("whole"),
        (F.col("end_token") - F.col("first_token") <= LIMIT).alias("fits"),
        F.when(F.col("piece") == 0, (F.col("first_token") == 0) & (F.col("repeated") == 0)).otherwise(F.col("first_token") + F.col("repeated") == before("end_token")).alias("joins"),
        F.when(F.col("piece") == 0, True).otherwise(F.col("repeated") == repeats).alias("repeats"),
    )
    return p.groupBy("source_table", "item_key").agg(F.max("end_token").cast("long").alias("tokens"), *[F.min(c).alias(c) for c in ("whole", "fits", "joins", "repeats")])


_WS = r"[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ORACLE_SQL["p2_found"] = f"""
WITH e AS (
  SELECT element_id, coalesce(max(len(regexp_extract_all(content, '{_WS}'))), 0) AS n FROM elements WHERE element_type = 'paragraph' GROUP BY element_id
)
SELECT DISTINCT 'elements' AS source_table, element_id AS item_key FROM e WHERE n > 500
UNION ALL
SELECT DISTINCT 'citations', query_id || '/' || citation_id FROM citations JOIN e ON chunk_id = element_id
WHERE n + coalesce(list_sum(list_transform(header_path, lambda x: len(regexp_extract_all(x, '{_WS}')))), 0) > 500
"""


ORACLE_SQL["p2_conditions"] = f"""
WITH e AS (
  SELECT element_id, coalesce(max(len(regexp_extract_all(content, '{_WS}'))), 0) AS n FROM elements WHERE element_type = 'paragraph' GROUP BY element_id
), a AS (SELECT 'elements' AS source_table, element_id AS item_key, n FROM e WHERE n > 500
UNION SELECT 'citations', query_id || '/' || citation_id, n + coalesce(list_sum(list_transform(header_path, lambda x: len(regexp_extract_all(x, '{_WS}')))), 0) FROM citations JOIN e ON chunk_id = element_id)
SELECT source_table, item_key, CAST(max(n) AS BIGINT) AS tokens, TRUE AS whole, TRUE AS fits, TRUE AS joins, TRUE AS repeats FROM a WHERE n > 500 GROUP BY ALL"""


@query
def p5_packed(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in containers of 2,048 tokens of the multilingual byte-level BPE vocabulary."""
    sizes = token_sizes(table(spark, folder, "documents"), key="doc_id", text="text", ranks_file=f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    return packed(sizes, key="doc_id", size="size", capacity=2048)


@query
def p5_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for every document: its pieces are all its tokens in order, and it is cut only if it is longer than a container, whose contents all fit."""
    documents = table(spark, folder, "documents")
    sizes = token_sizes(documents, key="doc_id", text="text", ranks_file=f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    placed = written(packed(sizes, key="doc_id", size="size", capacity=2048), "placed")
    full = placed.groupBy("container_id").agg(F.sum("tokens").alias("used")).filter("used > 2048").select("container_id", F.lit(True).alias("over"))
    rows = placed.join(full, "container_id", "left")
    each = rows.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.max(F.coalesce("over", F.lit(False))).alias("over"), F.max(F.col("start_token") % 2048).alias("odd"))
    joined = sizes.join(each, "doc_id", "left")
    whole = (F.col("tokens") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("odd") == 0)
    return joined.select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / 2048))).alias("cut_only_if_longer"), (~F.col("over")).alias("fits"))


ORACLE_SQL["p5_conditions"] = "SELECT doc_id, TRUE AS whole, TRUE AS cut_only_if_longer, TRUE AS fits FROM documents"
