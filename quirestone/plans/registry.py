"""All queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirestone.plans import document_queries, pipelines, proposal_queries, references, retrieval_queries, stream_queries, text_queries

_MODULES = [references, text_queries, document_queries, retrieval_queries, proposal_queries, pipelines, stream_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
