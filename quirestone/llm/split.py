"""Cutting oversized texts into overlapping pieces at natural boundaries.

A text begins as its smallest natural segments. Neighbours lie in a heap by the strength of the boundary
between them; the weakest boundaries go first, as long as the two segments and the repeated tokens
before them fit into a piece.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestone.functions.text import has_more_tokens

_TOKEN = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"""[.!?…。！？][)\]"'»”’]*$""")
_CLAUSE_END = re.compile(r"[,;:，、；：–—]$")
_LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
# Strengths of boundaries, from none to a blank line.
_NONE, _CLAUSE, _SENTENCE, _LINE, _PARAGRAPH = range(5)


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """How strong the boundary after each token but the last is."""
    strengths = []
    for (start, end), (following, _) in zip(spans, spans[1:]):
        lines = 0 if following - end == 1 and text[end] == " " else len(_LINE_END.findall(text, end, following))
        if lines:
            strengths.append(_PARAGRAPH if lines > 1 else _LINE)
        elif _SENTENCE_END.search(text, start, end):
            strengths.append(_SENTENCE)
        elif _CLAUSE_END.search(text, start, end):
            strengths.append(_CLAUSE)
        else:
            strengths.append(_NONE)
    return strengths


def merged(strengths: list[int], limit: int, overlap: int) -> list[int]:
    """First tokens of the pieces of a text of ``len(strengths) + 1`` tokens.

    A piece ``[start, end)`` is kept to ``end - max(0, start - overlap) <= limit``.
    """
    n = len(strengths) + 1
    fits = lambda start, end: end - max(0, start - overlap) <= limit
    starts = [0]
    for i in range(1, n):  # segments without a natural boundary inside; where one is too long, it is cut by length
        if strengths[i - 1] > _NONE or not fits(starts[-1], i + 1):
            starts.append(i)
    ends = dict(zip(starts, [*starts[1:], n]))
    before = dict(zip(starts[1:], starts))
    offer = lambda start: (strengths[start - 1], ends[start] - before[start], start, before[start], ends[start])
    heap = [offer(s) for s in starts[1:]]
    heapq.heapify(heap)
    while heap:
        _, _, start, left, end = heapq.heappop(heap)
        if before.get(start) != left or ends.get(start) != end or not fits(left, end):
            continue  # one of the two has grown since, or they don't fit
        del before[start], ends[start]
        ends[left] = end
        if end < n:
            before[end] = left
            heapq.heappush(heap, offer(end))
        if left:
            heapq.heappush(heap, offer(left))
    return sorted(ends)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(first token, end, tokens repeated from the piece before, text) of each piece."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    starts = merged(boundaries(text, spans), limit, overlap)
    out = []
    for start, end in zip(starts, [*starts[1:], len(spans)]):
        first = max(0, start - overlap)
        out.append((first, end, start - first, text[spans[first][0] : spans[end - 1][1]]))
    return out


def split_oversized(df: DataFrame, *, keys: list[str], text: str, limit: int = 500, overlap: int = 50) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens.

    Returns ``keys``, ``piece`` (from 0), ``pieces``, ``first_token``, ``end_token`` (exclusive),
    ``repeated`` and ``piece_text``. Each piece has at most ``limit`` tokens; each after the first
    begins with the last ``overlap`` tokens of the one before, or all of it, if it has fewer. Cuts
    are made at the strongest boundaries that a merge of the weaker ones leaves: blank lines, line ends,
    ends of sentences, ends of clauses; only a run of tokens without any that is too long is cut
    inside. Tokens are maximal runs of other characters than white space and are never cut.

    Null, blank and short texts give no rows; equal rows are split once each. Other columns are
    ignored. No shuffle; the size test runs before texts reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    names = [f"k{i}" for i in range(len(keys))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, row = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                found = pieces(t, limit, overlap)
                row += [i] * len(found)
                rows += [(j, len(found), *p) for j, p in enumerate(found)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int32()] * 5 + [pa.string()]
            taken = [batch.column(k).take(pa.array(row, pa.int64())) for k in names]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [*names, "piece", "pieces", "first_token", "end_token", "repeated", "piece_text"])

    taken = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("text")).filter(has_more_tokens(F.col("text"), limit))
    fields = [taken.schema[n] for n in names] + [T.StructField(n, T.IntegerType()) for n in ("piece", "pieces", "first_token", "end_token", "repeated")] + [T.StructField("piece_text", T.StringType())]
    found = taken.mapInArrow(cut, T.StructType(fields))
    return found.withColumnsRenamed(dict(zip(names, keys)))
