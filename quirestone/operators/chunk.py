"""Section-aware chunking of element streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirestone.functions.text import token_count, trim_ws
from quirestone.operators.elements import once, rendered
from quirestone.operators.structure import reading_order, section_tree

_CHUNK = (
    "doc_id string, section_id string, section_path array<string>, section_order int, no int, order_start int, order_end int, "
    "text string, element_type string, char_start int, char_end int"
)


def chunk_elements(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """The rows that chunks are made of: one for each element, with its text and its section's path."""
    tree = reading_order(section_tree(sections)).select("doc_id", "section_id", "section_path", "section_order")
    rows = once(elements).select("doc_id", F.col("containing_section_id").alias("section_id"), "element_id", "order_index", "element_type", rendered().alias("text"))
    joined = rows.join(tree, ["doc_id", "section_id"], "left")
    return joined.select(
        "doc_id",
        "section_id",
        F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"),
        F.coalesce("section_order", F.lit(0)).alias("section_order"),
        "order_index",
        "element_id",
        "element_type",
        "text",
        token_count(F.col("text")).alias("tokens"),
    )


def _pack(chunk_size: int, budget: int):
    """Greedy packing of a sorted stream of elements. Only the open block is held in memory."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, tokens, heading, no, cursor, fresh, out = None, [], 0, 0, 0, 0, False, []

        def flush() -> None:
            nonlocal no, out
            doc, section, path, order = meta
            body = [t for _, _, t, _, _, _ in block if t and not t.isspace()]
            kinds = {k for _, k, *_ in block}
            text = "\n\n".join(["\n".join(path)] + body if path else body)
            out.append((doc, section, path, order, no, block[0][0], block[-1][0], text, kinds.pop() if len(kinds) == 1 else "mixed", block[0][4], block[-1][5]))
            no += 1

        for batch in batches:
            for doc, section, path, order, index, _, kind, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, section) != key:
                    if block and fresh:
                        flush()
                    key, meta, block, tokens, no, fresh = (doc, section), (doc, section, path, order), [], 0, 0, False
                    joined = "\n".join(path)
                    heading = len(joined.split())
                    tokens, cursor = heading, len(joined.strip()) + 2 if joined.strip() else 0
                item = (index, kind, text, n, cursor, cursor + len(text))
                cursor += len(text) + 2
                if kind == "table":
                    if block and fresh:
                        flush()
                    block = [item]
                    flush()
                    block, tokens, fresh = [], heading, False
                    continue
                if block and tokens + n > chunk_size:
                    flush()
                    tail, run = [], 0
                    for x in reversed(block):
                        tail.insert(0, x)
                        run += x[3]
                        if run >= budget:
                            break
                    block, tokens = tail, heading + sum(x[3] for x in tail)
                block.append(item)
                tokens += n
                fresh = True
            if out:
                yield _batch(out)
                out = []
        if block and fresh:
            flush()
        if out:
            yield _batch(out)

    return pack


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.int32()] * 4, pa.string(), pa.string(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in _CHUNK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def chunks(rows: DataFrame, *, chunk_size: int = 500, overlap_ratio: float = 0.1) -> DataFrame:
    """Chunks of the rows of ``chunk_elements``.

    Elements are taken in order while the section's headings and their tokens fit into
    ``chunk_size``; a longer element is a chunk that is too long. Each chunk begins with as many of the last
    elements of the one before as reach ``overlap_ratio`` of the size, at least one. A table is a
    chunk of its own, and nothing is repeated after it. Every text begins with the section's path.

    Rows are brought together by section and stream by in order; a section may be of any length.
    """
    budget = max(1, int(chunk_size * overlap_ratio))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Named partitions: a plain repartition by the keys that the rows were joined on is planned away, and the
    # join may then be changed at run time to one that doesn't keep them together.
    part = F.pmod(F.xxhash64("doc_id", "section_id"), F.lit(parts)).cast("int")
    sorted_ = rows.repartitionById(parts, part).sortWithinPartitions("doc_id", "section_id", "order_index", "element_id")
    packed = sorted_.mapInArrow(_pack(chunk_size, budget), _CHUNK)
    doc, section = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "section_id")
    order = doc.orderBy("section_order", "section_id", "no")
    return (
        packed.withColumn("chunk_index", F.row_number().over(order) - 1)
        .withColumn("total_chunks", F.count(F.lit(1)).over(doc))
        .withColumn("total_chunks_in_section", F.count(F.lit(1)).over(section))
        .withColumn("token_count", token_count(F.col("text")))
        .withColumn("is_first_chunk", F.col("chunk_index") == 0)
        .withColumn("is_last_chunk", F.col("chunk_index") == F.col("total_chunks") - 1)
        .withColumnRenamed("no", "section_chunk_index")
        .withColumn("heading", F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit("")))
    )


def char_spans(rows: DataFrame) -> DataFrame:
    """``char_start`` and ``char_end`` of every element in the text of its section.

    The text is the stripped heading block, if there is any, and the elements, two line ends apart.
    """
    order = Window.partitionBy("doc_id", "section_id").orderBy("order_index", "element_id").rowsBetween(Window.unboundedPreceding, -1)
    head = F.length(trim_ws(F.array_join("section_path", "\n")))
    start = F.when(head > 0, head + 2).otherwise(0) + F.coalesce(F.sum(F.length("text") + 2).over(order), F.lit(0))
    return rows.select("doc_id", "section_id", "element_id", start.alias("char_start"), (start + F.length("text")).alias("char_end"))
