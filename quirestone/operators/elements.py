"""Elements of documents: one row each, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestone.functions.text import trim_ws


def once(elements: DataFrame) -> DataFrame:
    """Elements that were delivered more than once, once each."""
    return elements.dropDuplicates(["doc_id", "element_id"])


def rendered() -> Column:
    """Text of an element: paragraphs as they are, tables, lists and images as plain lines."""
    cells = lambda row: F.array_join(F.transform(row["cells"], lambda c: trim_ws(F.coalesce(c["content"], F.lit("")))), " | ")
    table = F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<struct<row_index:int,cells:array<struct<content:string,cell_type:string,column_index:int>>>>")), cells), "\n")
    caption, alt = F.nullif(trim_ws(F.col("caption")), F.lit("")), F.nullif(trim_ws(F.col("alt_text")), F.lit(""))
    mark = lambda i: F.when(F.col("list_type") == "ordered", F.concat((i + 1).cast("string"), F.lit("."))).when(F.col("list_type") == "checklist", "- [ ]").otherwise("-")
    line = lambda x, i: F.concat_ws(" ", mark(i), trim_ws(F.coalesce(x["content"], F.lit(""))))
    items = F.array_join(F.transform(F.coalesce("items", F.array().cast("array<struct<content:string,level:int>>")), line), "\n")
    return (
        F.when(F.col("element_type") == "table", table)
        .when(F.col("element_type") == "list", items)
        .when(F.col("element_type") == "image", F.coalesce(caption, alt, F.lit("[Image]")))
        .otherwise(F.coalesce("content", F.lit("")))
    )
