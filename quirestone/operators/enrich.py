"""Deterministic ids, hashes and embedding texts of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestone.functions.text import content_hash, normalize_ws, trim_ws


def chunk_id(doc: Column, section: Column, index: Column, text: Column) -> Column:
    """sha256 of document, section, index and normalized text, without separators."""
    return F.sha2(F.concat(doc.cast("string"), F.coalesce(section.cast("string"), F.lit("")), index.cast("string"), normalize_ws(text)), 256)


def embedding_text(title: Column, path: Column, element_type: Column, text: Column) -> Column:
    """The text that is embedded: what is known of the chunk, and its body without the heading block."""
    head = F.array_join(path, "\n")
    body = F.when((head != "") & text.startswith(head), trim_ws(F.substr(text, F.length(head) + 1))).otherwise(text)
    lines = [
        F.when(F.coalesce(trim_ws(title), F.lit("")) != "", F.concat(F.lit("Document: "), title)),
        F.when(F.size(path) > 0, F.concat(F.lit("Section Path: "), F.array_join(path, " > "))),
        F.concat(F.lit("Element Type: "), element_type),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), body)


def enriched(chunks: DataFrame, documents: DataFrame, *, pipeline_version: str = "2.1") -> DataFrame:
    """Chunks with the payload that is indexed; ``documents`` has ``doc_id`` and ``title``."""
    joined = chunks.join(documents.select("doc_id", F.col("title").alias("document_title")), "doc_id", "left")
    return joined.select(
        F.struct("doc_id", "document_title").alias("document"),
        F.struct("section_id", "section_path", "heading").alias("section"),
        F.struct(
            chunk_id(F.col("doc_id"), F.col("section_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "chunk_index", "token_count", "element_type", "total_chunks", "is_first_chunk", "is_last_chunk"
        ).alias("chunk"),
        F.struct("order_start", "order_end", "char_start", "char_end").alias("location"),
        content_hash(F.col("text")).alias("content_hash"),
        F.col("text").alias("original_text"),
        embedding_text(F.col("document_title"), F.col("section_path"), F.col("element_type"), F.col("text")).alias("embedding_text"),
        F.lit(pipeline_version).alias("pipeline_version"),
    )


def payload(points: DataFrame) -> DataFrame:
    """Flat payload of enriched chunks, the lifted keys at the top."""
    return points.select(
        "chunk.chunk_id",
        F.col("document.doc_id").alias("document_id"),
        "document.document_title",
        "section.section_id",
        "section.section_path",
        F.col("section.heading").alias("section_title"),
        "chunk.element_type",
        "chunk.chunk_index",
        "content_hash",
        "original_text",
        "embedding_text",
    )
