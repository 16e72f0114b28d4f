"""Filling containers of a fixed capacity with the tokens of texts.

Each partition keeps a fixed number of open containers. An item goes where it leaves the least
room; if it fits nowhere, the fullest container is closed and a new one opened. What is still open at the
end of the partitions, a fixed number each, is packed again, a container now being the item, in ever
fewer partitions.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestone.session import written

#: Open containers of a partition.
OPEN = 64
#: Partitions whose leftovers one task of the next round gets.
FAN_IN = 32
#: Empty items that wait for a container to be closed.
MOST_EMPTY = 10_000
_SCHEMA = "container_id string, closed boolean, used int, key long, piece int, start_token int, tokens int"
# Fixed value: how GPT-2's tokenizer cuts a text before it merges bytes, as the vocabulary's README names it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def tokenizer(ranks_file: str):
    """A byte-level BPE tokenizer from a file of ranks."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, *, key: str, text: str, ranks_file: str) -> DataFrame:
    """``key`` and ``size``, the number of tokens of the text; 0 for null or empty text. The file is sent to all executors."""
    df.sparkSession.sparkContext.addFile(ranks_file)
    name = Path(ranks_file).name

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64())], ["key", "size"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(count, "key long, size long").select(F.col("key").alias(key), "size")


class _Windows:
    """The open containers of a partition, by the room that is left in them."""

    def __init__(self, capacity: int, label: str):
        self.capacity, self.label, self.opened = capacity, label, 0
        self.open: list[tuple[int, int]] = []
        self.content: dict[int, list] = {}

    def place(self, size: int, what: list) -> list | None:
        """Place an item best-fit; returns the (number, used, content) that had to be closed, if any."""
        at, out = bisect_left(self.open, (size, -1)), None
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= OPEN:
                room, number = self.open.pop(0)
                out = self.close(number, room)
            room, number = self.capacity, self.opened
            self.opened += 1
            self.content[number] = []
        self.content[number] += what
        if room == size and not out:  # full: nothing with tokens can follow
            return self.close(number, 0)
        insort(self.open, (room - size, number))
        return out

    def close(self, number: int, room: int) -> list:
        return [f"{self.label}-{number}", self.capacity - room, self.content.pop(number)]

    def rest(self) -> Iterator[list]:
        for room, number in self.open:
            yield self.close(number, room)
        self.open = []


def _rows(closed: bool, containers: list[list]) -> pa.RecordBatch:
    flat = [(c, closed, used, *item) for c, used, items in containers for item in items]
    names = ["container_id", "closed", "used", "key", "piece", "start_token", "tokens"]
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*flat), kinds)] if flat else [pa.array([], k) for k in kinds], names)


def _first(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = f"0-{TaskContext.get().partitionId()}"
        windows, whole = _Windows(capacity, label), 0
        last, empty = None, []  # a closed container, which can still take what is empty, and what waits for one
        for batch in batches:
            done = []
            for key, size in zip(batch.column("key").to_pylist(), batch.column("size").to_pylist()):
                if not size:
                    empty.append((key, 0, 0, 0))
                    continue
                piece = start = 0
                while size - start > capacity:  # only a longer item is cut; its full pieces fill containers alone
                    done.append([f"{label}-w{whole}", capacity, [(key, piece, start, capacity)]])
                    whole, piece, start = whole + 1, piece + 1, start + capacity
                if out := windows.place(size - start, [(key, piece, start, size - start)]):
                    done.append(out)
            last = done[-1][:2] if done else last
            if empty and last is None and len(empty) > MOST_EMPTY:
                last = [f"{label}-e", 0]
            if empty and last:
                done.append([*last, empty])
                empty = []
            yield _rows(True, done)
        if empty:
            windows.place(0, empty)
        yield _rows(False, list(windows.rest()))

    return pack


def _again(capacity: int, turn: int, last: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, left = _Windows(capacity, f"{turn}-{TaskContext.get().partitionId()}"), {}
        for batch in batches:
            for container, _, used, *item in zip(*(c.to_pylist() for c in batch.columns)):
                left.setdefault(container, [used, []])[1].append(tuple(item))
        done = []
        for used, items in sorted(left.values(), key=lambda x: (-x[0], x[1])):
            if out := windows.place(used, items):
                done.append(out)
        yield _rows(True, done)
        yield _rows(last, list(windows.rest()))

    return pack


def packed(items: DataFrame, *, key: str, size: str, capacity: int) -> DataFrame:
    """An assignment of all items to containers of ``capacity`` tokens.

    Returns ``container_id``, ``key``, ``piece``, ``start_token`` and ``tokens``. An item of at most
    ``capacity`` tokens is one piece in one container. A longer one fills containers of its own as
    long as it can; its last piece is placed like an item. Items of size 0, null or below count as 0 and
    are placed too; a row that comes twice is placed twice, a null key is kept. Other columns
    are ignored. An empty table gives no containers.

    Items are packed where they lie, without a shuffle. Of each partition ``OPEN`` containers at
    most are left open; ``FAN_IN`` partitions' leftovers meet in a task, until one task is enough, so
    that besides full ones at most ``OPEN`` containers are less than best-fit filled.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = items.select(F.col(key).cast("long").alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    parts = sized.rdd.getNumPartitions()
    now = written(sized.mapInArrow(_first(capacity), _SCHEMA), "packed")
    closed, turn = now.filter("closed"), 0
    while True:
        parts, turn = -(-parts // FAN_IN), turn + 1
        left = now.filter("not closed").withColumn("to", F.pmod(F.xxhash64("container_id"), F.lit(parts)).cast("int"))
        again = left.repartitionById(parts, F.col("to")).drop("to").mapInArrow(_again(capacity, turn, parts == 1), _SCHEMA)
        now = written(again, "packed")
        closed = closed.unionByName(now.filter("closed"))
        if parts == 1:
            break
    return closed.select("container_id", F.col("key").alias(key), "piece", "start_token", "tokens")
