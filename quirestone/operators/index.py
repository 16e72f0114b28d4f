"""Incremental indexing: fingerprints, upserts and run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirestone.operators.embed import is_valid_vector
from quirestone.operators.skew import join_spread


def not_yet_indexed(documents: DataFrame, indexed: DataFrame, *, fingerprint: str) -> DataFrame:
    """Documents whose fingerprint the index doesn't have."""
    return documents.join(indexed.select(fingerprint).distinct(), fingerprint, "left_anti")


_UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
#: Fields without which a point can't become a candidate.
REQUIRED_FIELDS = ("chunk_id", "document_id", "original_text", "source_document")


def fingerprints(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc_id`` and ``document_fingerprint`` of every document: of all that reaches its chunks, in whatever order it comes."""
    total = lambda columns: F.sum(F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("decimal(20,0)"))
    of_elements = ("element_id", "containing_section_id", "order_index", "element_type", "content", "rows", "caption", "alt_text", "list_type", "items", "source_document")
    of_sections = ("section_id", "parent_section_id", "heading", "section_level", "sibling_ord")
    made = elements.groupBy("doc_id").agg(total(of_elements).alias("__e"), F.count(F.lit(1)).alias("__n"))
    placed = sections.groupBy("doc_id").agg(total(of_sections).alias("__s"), F.count(F.lit(1)).alias("__m"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("__e", "__n", "__s", "__m")]
    return made.join(placed, "doc_id", "left").select("doc_id", F.sha2(F.concat_ws(":", "doc_id", *parts), 256).alias("document_fingerprint"))


def invalid_points(points: DataFrame, *, id: str, vector: str, dimensions: int, uuids: bool = False, fields: Sequence[str] = ()) -> DataFrame:
    """Ids that a batch may not have, and ``reason``.

    ``duplicate_id``, ``invalid_vector``, with ``uuids`` ``invalid_id`` for ids that aren't UUIDs, and for each of
    ``fields`` that is null or lacks ``missing_`` and its name.
    """
    repeated = points.groupBy(id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id, F.lit("duplicate_id").alias("reason"))
    rules = [("invalid_vector", ~is_valid_vector(F.col(vector), dimensions))]
    if uuids:
        rules.append(("invalid_id", ~F.coalesce(F.col(id).rlike(_UUID), F.lit(False))))
    rules += [(f"missing_{c}", F.col(c).isNull() if c in points.columns else F.lit(True)) for c in fields]
    broken = F.filter(F.array(*[F.when(rule, F.lit(reason)) for reason, rule in rules]), lambda r: r.isNotNull())
    return repeated.unionByName(points.select(id, F.explode(broken).alias("reason")))


def upserted(existing: DataFrame, points: DataFrame, *, id: str) -> DataFrame:
    """The collection after ``points`` have replaced or joined what it had."""
    return existing.join(points.select(id), id, "left_anti").unionByName(points)


def upsert_counts(existing: DataFrame, points: DataFrame, *, id: str) -> DataFrame:
    """``inserted`` and ``updated``, in one row."""
    marked = points.select(id).distinct().join(existing.select(id, F.lit(True).alias("there")).distinct(), id, "left")
    return marked.agg(F.count_if(F.col("there").isNull()).alias("inserted"), F.count_if(F.col("there").isNotNull()).alias("updated"))


def package_diff(before: DataFrame, after: DataFrame, *, part: str, content: str) -> DataFrame:
    """Parts that were ``added``, ``removed`` or ``changed``, by the digest of their content, as ``change``."""
    digest = lambda df, name: df.select(part, F.sha2(F.col(content).cast("binary"), 256).alias(name), F.lit(True).alias(f"has_{name}"))
    joined = digest(before, "old").join(digest(after, "new"), part, "full")
    change = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.select(part, change.alias("change")).filter("change is not null")


def version_changes(parts: DataFrame, *, version: str, part: str, content: str) -> DataFrame:
    """Every version compared with the next one: ``before``, ``after``, the part, and ``change``.

    A part may come more than once in a version; it is ``changed`` if the sets of its contents' digests differ.
    Only the distinct versions are sorted at once.
    """
    rows = parts.select(version, part, F.sha2(F.col(content).cast("binary"), 256).alias("__digest"))
    order = Window.orderBy(version)
    versions = rows.filter(F.col(version).isNotNull()).select(version).distinct().select(version, F.lag(version).over(order).alias("__last"), F.lead(version).over(order).alias("__next"))
    sides = F.array(
        F.struct(F.col("__last").alias("before"), F.col(version).alias("after"), F.lit(False).alias("old"), F.lit(True).alias("new")),
        F.struct(F.col(version).alias("before"), F.col("__next").alias("after"), F.lit(True).alias("old"), F.lit(False).alias("new")),
    )
    placed = join_spread(rows, versions, [version], ["__digest"]).select(part, "__digest", F.explode(sides).alias("__s")).select(part, "__digest", "__s.*")
    digests = placed.filter("before is not null and after is not null").groupBy("before", "after", part, "__digest").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    both = digests.groupBy("before", "after", part).agg(F.max("old").alias("old"), F.max("new").alias("new"), F.max(F.col("old") != F.col("new")).alias("differ"))
    change = F.when(~F.col("old"), "added").when(~F.col("new"), "removed").when(F.col("differ"), "changed")
    return both.select("before", "after", part, change.alias("change")).filter("change is not null")
