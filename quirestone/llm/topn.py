"""The N best items of every group, found by bisection of all groups at once.

A row's place in its group is an order-preserving code of several 64-bit words: the score, then the
identifier. For every group the cutoff code is refined by counting the rows above the midpoint of
what is still open, all groups in the same numpy step, until exactly N rows are above it. This runs
first on the rows of each input partition, so that of any group at most N rows a partition are
shuffled, and again where these meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows held before they are reduced to the best of each group.
BUFFER_ROWS = 500_000
_TOP = np.uint64(1 << 63)


def score_code(scores: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit codes in the order of the doubles; -0.0 equals 0.0."""
    bits = (scores + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def item_codes(items: pa.Array) -> np.ndarray:
    """Codes that are the larger, the smaller the item: numbers by value, strings by their bytes in UTF-8 among those that are here."""
    if pa.types.is_integer(items.type):
        return ~(items.cast(pa.int64()).to_numpy().view(np.uint64) ^ _TOP)
    if pa.types.is_floating(items.type):
        return ~score_code(items.cast(pa.float64()).to_numpy())
    coded = items.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.uint64)
    rank[pc.sort_indices(coded.dictionary.cast(pa.large_binary())).to_numpy()] = np.arange(len(rank), dtype=np.uint64)
    return ~rank[coded.indices.to_numpy()]


def best(group: np.ndarray, codes: Sequence[np.ndarray], n: int) -> np.ndarray:
    """Whether each row is among the ``n`` of its group with the largest codes.

    ``group`` numbers the groups from 0; no two rows of a group have equal codes. A word of the
    code is looked at for the rows that all words before left undecided.
    """
    chosen = np.zeros(len(group), bool)
    if not len(group):
        return chosen
    groups = int(group.max()) + 1
    wanted = np.full(groups, n, np.int64)  # so many of the undecided rows of the group are still to be chosen
    open_ = np.arange(len(group))
    for code in codes:
        counts = np.bincount(group[open_], minlength=groups)
        few = counts[group[open_]] <= wanted[group[open_]]
        chosen[open_[few]] = True
        open_ = open_[~few]
        if not len(open_):
            break
        where, mine = group[open_], code[open_]
        # the cutoff of a group: the largest code that at least `wanted` rows reach, in [low, high]
        low, high = np.zeros(groups, np.uint64), np.full(groups, np.uint64(2**64 - 1))
        rows, at, value = np.arange(len(open_)), where, mine
        above = np.zeros(groups, np.int64)  # rows already known to lie above high
        for _ in range(64):
            middle = low + ((high - low) >> np.uint64(1)) + ((high - low) & np.uint64(1))
            reach = value >= middle[at]
            count = above + np.bincount(at[reach], minlength=groups)
            enough = count >= wanted
            low = np.where(enough, middle, low)
            above = np.where(enough, above, count)
            high = np.where(enough, high, np.maximum(middle, 1) - np.uint64(1))
            stay = reach == enough[at]  # the others are known to lie above or below the cutoff
            rows, at, value = rows[stay], at[stay], value[stay]
            if not len(rows) or bool((low == high)[at].all()):
                break
        over = mine > high[where]
        equal = (mine >= low[where]) & ~over
        chosen[open_[over]] = True
        wanted -= np.bincount(where[over], minlength=groups)
        open_ = open_[equal]
    chosen[open_] = True  # one row a group, the last that was wanted
    return chosen


def _numbered(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """Equal combinations of values get the same number, from 0."""
    total = None
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        code = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = code if total is None else np.unique(total * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    return total


def _reduced(table: pa.Table, keys: list[str], n: int) -> pa.Table:
    """The best ``n`` distinct items of each group, each with its highest score."""
    table = table.group_by([*keys, "item"], use_threads=False).aggregate([("score", "max")]).rename_columns([*keys, "item", "score"])
    codes = [score_code(table.column("score").to_numpy()), item_codes(table.column("item").combine_chunks())]
    return table.filter(pa.array(best(_numbered([table.column(k) for k in keys]), codes, n)))


def top_n(df: DataFrame, *, groups: Sequence[str], score: str, item: str, n: int) -> DataFrame:
    """The ``n`` items of each group with the highest scores; equal scores: the smaller item.

    Returns ``groups``, ``item`` and ``score`` under their names in ``df``; a smaller group gives
    all it has. Items are numbers other than decimals, ordered by value, or strings, ordered by bytes; other types are refused. An item that
    comes more than once in a group counts once, with its highest score. Rows with a null group,
    item or score, or a NaN or infinite score, don't take part. Other columns are ignored; an empty
    input gives an empty result.

    A partition sends at most ``n`` rows of a group for every ``BUFFER_ROWS`` rows it reads, so that even
    a group with most of all rows is small where its rows meet; there they come sorted and are
    reduced as they stream by.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [f"g{i}" for i in range(len(groups))]
    taken = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    kind = taken.schema["item"].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        taken = taken.withColumn("item", F.col("item").cast("double"))
    elif isinstance(kind, T.IntegralType):
        taken = taken.withColumn("item", F.col("item").cast("long"))
    elif not isinstance(kind, T.StringType):
        raise ValueError(f"items of type {kind.simpleString()} have no order here; cast them to a number or a string")
    usable = taken.dropna().filter(~F.isnan("score") & (F.abs("score") < float("inf")))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                yield from _reduced(pa.Table.from_batches(held), keys, n).to_batches()
                held, rows = [], 0
        if rows:
            yield from _reduced(pa.Table.from_batches(held), keys, n).to_batches()

    def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a buffer may go on in the next one."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BUFFER_ROWS:
                continue
            table = _reduced(pa.Table.from_batches(held), keys, n)
            final = batch.slice(batch.num_rows - 1, 1)
            last = pc.equal(table.column(keys[0]), final.column(keys[0])[0])
            for k in keys[1:]:
                last = pc.and_(last, pc.equal(table.column(k), final.column(k)[0]))
            yield from table.filter(pc.invert(last)).to_batches()
            held = table.filter(last).combine_chunks().select(batch.schema.names).cast(batch.schema).to_batches()
            rows = sum(b.num_rows for b in held)
        if rows:
            yield from _reduced(pa.Table.from_batches(held), keys, n).to_batches()

    schema = usable.schema
    reduced = usable.mapInArrow(local, schema)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    met = reduced.repartitionById(parts, part).sortWithinPartitions(*keys).mapInArrow(sorted_groups, schema)
    return met.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], F.col("item").cast(kind).alias(item), F.col("score").alias(score))
