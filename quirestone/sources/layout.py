"""Pages with a layout, like PDF, as blocks: any extractor gives spans, the rest is done here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirestone.functions.text import WS_CLASS, is_blank, trim_ws
from quirestone.operators.structure import body_sizes, layout_heading_level
from quirestone.session import written

SPANS = "doc_id string, page_number int, kind string, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean"


def spans_of(files: DataFrame, extractor: Callable[[bytes], list[dict]]) -> DataFrame:
    """Text blocks and tables of each file, by an extractor of the user's choice.

    It gets the bytes of a file and returns dictionaries with the fields of ``SPANS`` but ``doc_id``.
    """

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SPANS.split(", ")]
        for frame in frames:
            rows = [{"doc_id": path} | span for path, content in zip(frame["path"], frame["content"]) for span in extractor(bytes(content))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(extract, SPANS)


def page_blocks(spans: DataFrame) -> DataFrame:
    """Blocks in reading order with their heading level, ready for ``structure.outline``.

    Text that lies in a table of its page is left out, lines are stripped, blank ones dropped;
    blocks are ordered by page, then from top to bottom and left to right.
    """
    spans = written(spans, "spans")  # the extractor runs once
    tables = spans.filter("kind = 'table'").select("doc_id", "page_number", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    texts = spans.filter("kind = 'text'")
    overlap = (
        (texts.doc_id == tables.doc_id) & (texts.page_number == tables.page_number) & (F.col("x0") < F.col("t_x1")) & (F.col("x1") > F.col("t_x0")) & (F.col("y0") < F.col("t_y1")) & (F.col("y1") > F.col("t_y0"))
    )
    free = texts.join(tables, overlap, "left_anti")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: trim_ws(x)), lambda x: x != "")
    kept = free.withColumn("text", F.array_join(lines, "\n")).unionByName(spans.filter("kind = 'table'")).filter(~is_blank(F.col("text")))
    sized = kept.join(body_sizes(texts), ["doc_id", "page_number"], "left")
    level = F.when(F.col("kind") == "text", layout_heading_level(F.col("text"), F.col("size"), F.col("body_size"), F.coalesce("bold", F.lit(False))))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "y0", "x0", "y1", "x1", "kind", "text")) - 1
    return sized.select("doc_id", pos.alias("pos"), level.alias("level"), "text", "kind", "page_number")


def layout_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of ``page_blocks`` as ``structure.library_tables`` takes them; a table's lines are its rows, its cells parted by tabs or ``|``."""
    cell = lambda c, j, i: F.struct(trim_ws(c).alias("content"), F.when(i == 0, "header").otherwise("data").alias("cell_type"), j.alias("column_index"))
    row = lambda line, i: F.struct(i.alias("row_index"), F.transform(F.split(line, r"\t|\|"), lambda c, j: cell(c, j, i)).alias("cells"))
    return blocks.select(
        "doc_id",
        "pos",
        F.when(F.col("kind") == "text", F.col("level")).alias("level"),
        F.when(F.col("kind") == "table", "table").otherwise("paragraph").alias("kind"),
        "text",
        F.when(F.col("kind") == "table", F.transform(F.split("text", "\n"), row)).alias("rows"),
        "page_number",
        F.col("doc_id").alias("source_path"),
    )


def unreadable(spans: DataFrame, files: DataFrame) -> DataFrame:
    """``path`` of files from which no text came."""
    full = spans.filter(~is_blank(F.regexp_replace("text", WS_CLASS, " "))).select(F.col("doc_id").alias("path")).distinct()
    return files.select("path").join(full, "path", "left_anti")
