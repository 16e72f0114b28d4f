"""Problem 1: references of proposals to declared and retrieved records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestone.functions.text import trim_ws
from quirestone.operators.orphans import orphan_references, orphan_report
from quirestone.sources.tables import table

_KEEP = ["source_field", "owner_key", "reference_id", "period"]


def plain_id(raw: Column) -> Column:
    """The form in which ids are compared: trimmed, lower case; null if nothing is left."""
    return F.nullif(F.lower(trim_ws(raw)), F.lit(""))


def _references(df: DataFrame, field: str, owner: Column, raw: Column, at: str) -> DataFrame:
    return (
        df.select("proposal_id", F.col(at).alias("at"), owner.alias("owner_key"), plain_id(raw).alias("reference_id"), F.lit(field).alias("source_field"))
        .filter("reference_id is not null")
        .withColumn("period", F.date_format("at", "yyyy-MM"))
        .distinct()
    )


def block_references(blocks: DataFrame) -> DataFrame:
    """Every id that a paragraph, a callout or an entry of a requirement matrix cites.

    Distinct rows of proposal, time, source_field, owner_key, reference_id and period. Null and
    blank ids are no references; a null requirement id counts as empty.
    """
    cited = blocks.select("proposal_id", "generated_at", "block_id", F.explode("reference_ids").alias("raw"))
    of_entries = blocks.select("proposal_id", "generated_at", "block_id", F.explode("entries").alias("entry")).select(
        "proposal_id",
        "generated_at",
        F.concat_ws("/", F.col("block_id").cast("string"), F.coalesce("entry.requirement_id", F.lit(""))).alias("owner"),
        F.explode("entry.evidence_reference_ids").alias("raw"),
    )
    return _references(cited, "transport_blocks.reference_ids", F.col("block_id").cast("string"), F.col("raw"), "generated_at").unionByName(
        _references(of_entries, "transport_blocks.evidence_reference_ids", F.col("owner"), F.col("raw"), "generated_at")
    )


def declared_references(declared: DataFrame) -> DataFrame:
    """Every declared reference, deleted or not, as a reference to a retrieved one."""
    return _references(declared, "knowledge_refs.reference_id", F.col("proposal_id"), F.col("reference_id"), "declared_at")


def all_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """source_field, owner_key, reference_id, period and status of every orphan, distinct.

    One reference can be an orphan twice in a month, at different times and for different reasons.
    """
    declared = table(spark, folder, "knowledge_refs")
    retrieved = table(spark, folder, "retrieved_refs")
    of_blocks = orphan_references(
        block_references(table(spark, folder, "transport_blocks")),
        declared.select("proposal_id", plain_id(F.col("reference_id")).alias("reference_id"), "declared_at", "deleted_at"),
        keys=["proposal_id", "reference_id"],
        at="at",
        valid_from="declared_at",
        valid_to="deleted_at",
        keep=_KEEP,
    )
    of_declared = orphan_references(
        declared_references(declared),
        retrieved.select("proposal_id", plain_id(F.col("reference_id")).alias("reference_id"), "retrieved_at"),
        keys=["proposal_id", "reference_id"],
        at="at",
        valid_from="retrieved_at",
        keep=_KEEP,
    )
    return of_blocks.unionByName(of_declared).distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference that points to nothing valid at its time."""
    return all_orphans(spark, folder).select(*_KEEP).distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per field, month and reason."""
    return orphan_report(all_orphans(spark, folder), ["source_field", "period", "status"])


_SQL_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SQL_ORPHANS = rf"""
WITH raw AS (
  SELECT 'transport_blocks.reference_ids' AS source_field, proposal_id, generated_at AS ts, CAST(block_id AS VARCHAR) AS owner_key, unnest(reference_ids) AS raw FROM transport_blocks
  UNION ALL
  SELECT 'transport_blocks.evidence_reference_ids', proposal_id, generated_at, CAST(block_id AS VARCHAR) || '/' || coalesce(e.requirement_id, ''), unnest(e.evidence_reference_ids)
  FROM (SELECT proposal_id, generated_at, block_id, unnest(entries) AS e FROM transport_blocks)
  UNION ALL
  SELECT 'knowledge_refs.reference_id', proposal_id, declared_at, proposal_id, reference_id FROM knowledge_refs
), refs AS (
  SELECT DISTINCT source_field, proposal_id, ts, owner_key, lower(regexp_replace(raw, '^{_SQL_WS}|{_SQL_WS}$', '', 'g')) AS reference_id
  FROM raw WHERE regexp_replace(raw, '^{_SQL_WS}|{_SQL_WS}$', '', 'g') <> ''
), parents AS (
  SELECT 'k' AS kind, proposal_id, lower(regexp_replace(reference_id, '^{_SQL_WS}|{_SQL_WS}$', '', 'g')) AS reference_id, declared_at AS f, coalesce(deleted_at, TIMESTAMPTZ '9999-12-31 00:00:00+00') AS u FROM knowledge_refs
  UNION ALL
  SELECT 'r', proposal_id, lower(regexp_replace(reference_id, '^{_SQL_WS}|{_SQL_WS}$', '', 'g')), retrieved_at, TIMESTAMPTZ '9999-12-31 00:00:00+00' FROM retrieved_refs
), judged AS (
  SELECT r.source_field, r.owner_key, r.reference_id, r.ts, min(p.f) AS first_from, max(CASE WHEN p.f <= r.ts THEN p.u END) AS last_until
  FROM refs r LEFT JOIN parents p ON p.proposal_id = r.proposal_id AND p.reference_id = r.reference_id
    AND p.kind = CASE WHEN r.source_field = 'knowledge_refs.reference_id' THEN 'r' ELSE 'k' END
  GROUP BY ALL
), orphans AS (
  SELECT DISTINCT source_field, owner_key, reference_id, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN first_from IS NULL THEN 'missing' WHEN first_from > ts THEN 'late' ELSE 'deleted' END AS status
  FROM judged WHERE last_until IS NULL OR last_until <= ts
)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLE_SQL = {
    "p1_found": _SQL_ORPHANS + "SELECT DISTINCT source_field, owner_key, reference_id, period FROM orphans",
    "p1_report": _SQL_ORPHANS + "SELECT source_field, period, status, count(*) AS orphans FROM orphans GROUP BY ALL",
}
