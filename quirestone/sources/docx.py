"""Word documents as tables of blocks: read from and written to Office Open XML packages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestone.operators.structure import heading_level

# Fixed value: the namespace of WordprocessingML.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CELL = "struct<content:string,cell_type:string,column_index:int>"
BLOCKS = f"path string, fingerprint string, pos int, kind string, style string, text string, rows array<struct<row_index:int,cells:array<{_CELL}>>>, error string"


def discover(spark: SparkSession, folder: str, suffixes: Iterable[str] = (".docx", ".pdf")) -> DataFrame:
    """Files below ``folder``, or the one file it names, with one of the suffixes, in any case: the columns of Spark's binaryFile source and ``fingerprint``.

    Other files aren't read. A folder that doesn't exist or has no such file is refused.
    """
    letters = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    names = "*{" + ",".join(letters(s) for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    if not files.inputFiles():
        raise FileNotFoundError(f"no documents in {folder}")
    return files.withColumn("fingerprint", F.sha2("content", 256))


def authorized(files: DataFrame, root: str, *, role: str, allowed: str = "REFERENCE_KNOWLEDGE") -> DataFrame:
    """``files``, if they may be indexed: the role is the allowed one and every path lies below ``root``.

    All or nothing, before any file is parsed.
    """
    if role != allowed:
        raise PermissionError(f"documents of role {role} may not be indexed")
    path = F.regexp_replace("path", "^file:/*", "/")
    outside = files.filter(~path.startswith(root.rstrip("/") + "/") | path.contains("/../")).select("path").limit(1).collect()
    if outside:
        raise PermissionError(f"{outside[0]['path']} isn't below {root}")
    return files


def _text(node: ElementTree.Element) -> str:
    parts = []
    for x in node.iter():
        if x.tag == _W + "t":
            parts.append(x.text or "")
        elif x.tag == _W + "tab":
            parts.append("\t")
        elif x.tag == _W + "cr" or (x.tag == _W + "br" and x.get(_W + "type", "textWrapping") == "textWrapping"):
            parts.append("\n")
    return "".join(parts)


def _styles(package: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in package.namelist():
        return {}
    root = ElementTree.fromstring(package.read("word/styles.xml"))
    names = {}
    for style in root.iter(_W + "style"):
        name = style.find(_W + "name")
        names[style.get(_W + "styleId", "")] = name.get(_W + "val", "") if name is not None else ""
    return names


def parse_docx(content: bytes) -> Iterator[dict]:
    """Paragraphs and tables of a document's body, in order. Blank paragraphs are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        styles = _styles(package)
        body = ElementTree.fromstring(package.read("word/document.xml")).find(_W + "body")
    pos = 0
    for node in body if body is not None else []:
        if node.tag == _W + "p":
            text = _text(node)
            if not text.strip():
                continue
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = "" if style is None else styles.get(style.get(_W + "val", ""), style.get(_W + "val", ""))
            yield {"pos": pos, "kind": "paragraph", "style": name, "text": text, "rows": None}
        elif node.tag == _W + "tbl":
            rows = []
            for i, row in enumerate(node.findall(_W + "tr")):
                cells = []
                for j, cell in enumerate(row.findall(_W + "tc")):
                    lines = [t for p in cell.findall(_W + "p") if (t := _text(p)).strip()]
                    cells.append({"content": "\n".join(lines), "cell_type": "data" if i else "header", "column_index": j})
                rows.append({"row_index": i, "cells": cells})
            yield {"pos": pos, "kind": "table", "style": None, "text": None, "rows": rows}
        else:
            continue
        pos += 1


def read_docx(files: DataFrame) -> DataFrame:
    """Blocks of the documents in ``files`` (``path``, ``fingerprint``, ``content``).

    A file that can't be read gives one row with ``error`` and no block, and doesn't stop the others.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, fingerprint, content in zip(frame["path"], frame["fingerprint"], frame["content"]):
                known = {"path": path, "fingerprint": fingerprint, "error": None}
                try:
                    rows += [known | block for block in parse_docx(bytes(content))]
                except Exception as e:  # any broken package
                    rows.append(known | {"pos": -1, "kind": None, "style": None, "text": None, "rows": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "fingerprint", "pos", "kind", "style", "text", "rows", "error"])

    return files.select("path", "fingerprint", "content").mapInPandas(parse, BLOCKS)


def docx_blocks(read: DataFrame) -> DataFrame:
    """Blocks of ``read_docx`` without an error as ``structure.library_tables`` takes them; a paragraph with a heading's style is one."""
    return read.filter("error is null").select(
        F.col("path").alias("doc_id"),
        "pos",
        F.when(F.col("kind") == "paragraph", heading_level(F.col("style"))).alias("level"),
        "kind",
        "text",
        "rows",
        F.lit(None).cast("int").alias("page_number"),
        F.col("path").alias("source_path"),
    )


def _xml(kind: str, text: str, style: str) -> str:
    run = f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
    if kind == "table_row":
        cells = "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in text.split(" | "))
        return f"<w:tr>{cells}</w:tr>"
    if kind == "page_break":
        return '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    name = f"Heading{style.removeprefix('heading_')}" if kind == "heading" else style
    return f'<w:p><w:pPr><w:pStyle w:val="{escape(name)}"/></w:pPr>{run}</w:p>'


def compose_docx(lines: Iterable[tuple[str, str, str]]) -> bytes:
    """A Word package of (kind, style, text) lines; table rows that follow each other are one table."""
    body, table = [], []
    for kind, style, text in lines:
        if kind == "table_row":
            if style == "table_header" and table:
                body.append("<w:tbl>" + "".join(table) + "</w:tbl><w:p/>")
                table = []
            table.append(_xml(kind, text, style))
            continue
        if table:
            body.append("<w:tbl>" + "".join(table) + "</w:tbl>")
            table = []
        body.append(_xml(kind, text, style))
    if table:
        body.append("<w:tbl>" + "".join(table) + "</w:tbl>")
    ns = _W.strip("{}")
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
        '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/styles.xml": f'<w:styles xmlns:w="{ns}">' + "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 7)) + "</w:styles>",
        "word/document.xml": f'<w:document xmlns:w="{ns}"><w:body>{"".join(body)}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, text in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # equal content, equal bytes
            package.writestr(info, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()


def composed_documents(operations: DataFrame) -> DataFrame:
    """``proposal_id`` and ``content``: a Word package of each document's render operations.

    One document's lines are one group; a document is what one file holds.
    """

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("op_ord")
        content = compose_docx(zip(frame["kind"], frame["style"], frame["text"]))
        return pd.DataFrame({"proposal_id": [frame["proposal_id"].iloc[0]], "content": [content]})

    return operations.groupBy("proposal_id").applyInPandas(compose, "proposal_id string, content binary")


def package_parts(files: DataFrame) -> DataFrame:
    """Parts of the packages in ``files`` (``path``, ``content``): ``path``, ``part``, ``content``, ``error``.

    A package that can't be read gives one row with ``error`` and no part.
    """

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as package:
                        rows += [(path, name, package.read(name), None) for name in package.namelist()]
                except Exception as e:  # any broken package
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "part", "content", "error"])

    return files.select("path", "content").mapInPandas(unzip, "path string, part string, content binary, error string")


def package_inventory(parts: DataFrame) -> DataFrame:
    """Counts of each package: parts, sections, paragraphs, tables, rows, cells, drawings, fields, styles."""
    text = F.decode("content", "UTF-8")
    count = lambda tag: F.sum(F.when(F.col("part").endswith(".xml"), F.regexp_count(text, F.lit(rf"<w:{tag}[ />]"))).otherwise(0))
    tags = {"paragraphs": "p", "tables": "tbl", "table_rows": "tr", "cells": "tc", "drawings": "drawing", "fields": "fldSimple", "styles": "style", "sections": "sectPr"}
    return parts.groupBy("path").agg(F.count("part").alias("parts"), *[count(t).alias(n) for n, t in tags.items()])
