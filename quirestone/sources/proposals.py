"""Generated proposals as JSON documents: written from rows of blocks, and read back into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENTRY = "struct<requirement_id:string,requirement:string,response:string,evidence_reference_ids:array<string>>"
_BLOCK = (
    "struct<block_id:bigint,type:string,text:string,items:array<string>,headers:array<string>,rows:array<array<string>>,visual_id:string,description:string,label:string,"
    f"entries:array<{_ENTRY}>,reference_ids:array<string>>"
)
SCHEMA = f"proposal_id string, sections array<struct<section_id:string,blocks:array<{_BLOCK}>>>, _corrupt_record string"
_FIELDS = [f.split(":")[0] for f in ("block_id", "type", "text", "items", "headers", "rows", "visual_id", "description", "label", "entries", "reference_ids")]


def as_json(blocks: DataFrame) -> DataFrame:
    """``proposal_id`` and ``json``: a document of each proposal, its sections and blocks in order.

    A document is one string, so its blocks come together; keys are in alphabetical order.
    """
    at = F.regexp_extract("path", r"^sections\[(\d+)\]", 1).cast("int")
    entries = F.transform("entries", lambda e: F.struct(*[e[k].alias(k) for k in ("evidence_reference_ids", "requirement", "requirement_id", "response")])).alias("entries")
    block = F.struct(*[entries if c == "entries" else F.col(c) for c in sorted(_FIELDS)])
    rows = blocks.select("proposal_id", "section_id", at.alias("at"), F.struct(F.col("ord"), F.col("block_id").alias("id"), block.alias("block")).alias("row"))
    sections = rows.groupBy("proposal_id", "at", "section_id").agg(F.transform(F.array_sort(F.collect_list("row"), lambda a, b: _before(a, b, "ord", "id")), lambda r: r["block"]).alias("blocks"))
    whole = sections.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("at", "section_id", "blocks")), lambda a, b: _before(a, b, "at", "section_id")).alias("sections"))
    document = F.struct("proposal_id", F.transform("sections", lambda s: F.struct(s["blocks"].alias("blocks"), s["section_id"].alias("section_id"))).alias("sections"))
    return whole.select("proposal_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def _before(a, b, *keys):
    """Comparison of two structs by some of their fields."""
    order = F.lit(0)
    for k in reversed(keys):
        order = F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(order)
    return order


def parse_json(documents: DataFrame, *, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of JSON documents, and the documents that can't be read.

    Blocks: ``proposal_id`` (from ``key``, whatever the document says), ``section_id``, ``path``, ``ord`` and the
    fields of a block. Unreadable: ``proposal_id`` and ``error``: ``missing_payload``, ``invalid_json`` or ``missing_sections``.
    """
    parsed = documents.select(F.col(key).alias("proposal_id"), F.col(json).alias("json"), F.from_json(json, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    error = (
        F.when(F.col("json").isNull() | (F.trim("json") == ""), "missing_payload").when(F.col("d._corrupt_record").isNotNull(), "invalid_json").when(F.col("d.sections").isNull(), "missing_sections")
    )
    marked = parsed.withColumn("error", error)
    sections = marked.filter("error is null").select("proposal_id", F.posexplode("d.sections").alias("at", "section"))
    rows = sections.select("proposal_id", "at", "section.section_id", F.posexplode("section.blocks").alias("ord", "block"))
    path = F.format_string("sections[%d].blocks[%d]", "at", "ord")
    return rows.select("proposal_id", "section_id", path.alias("path"), "ord", "block.*"), marked.filter("error is not null").select("proposal_id", "error")
