"""Passages of test items inside a corpus.

Each task makes an FM-index of its shard of the corpus and searches it backwards for all phrases of
the test items together. The index is over words, and only over stretches of words that occur in the
items at all and are long enough for a phrase; no other place can match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestone.llm.words import words

#: Characters of documents that one index is made of, at least, if a partition has so many.
SHARD_CHARS = 12_000_000
#: Test items that are searched for in one pass over the corpus.
ITEMS_A_PASS = 20_000
#: Items of spans that are put together in one step.
ITEMS_A_STEP = 2_000_000
#: Every so many-th position of the text is kept for locating.
SAMPLING = 8


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order, by doubling the length that is sorted by."""
    n, codes = len(codes), codes + 1  # 0 is the end
    bits = int(codes.max()).bit_length()
    k = 62 // bits
    key = np.zeros(n, np.int64)
    for i in range(k):  # as many symbols as fit into one number
        key <<= bits
        key[: max(n - i, 0)] |= codes[i:]
    order = np.argsort(key)
    while True:
        ordered = key[order]
        place = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = place
        if place[-1] == n - 1 or k >= n:
            return order
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        k *= 2


class FMIndex:
    """An FM-index of a text of positive symbols, in which 0 separates parts.

    The last symbol is 0. Ranks come from a wavelet matrix of the Burrows-Wheeler transform.
    """

    def __init__(self, codes: np.ndarray):
        order = suffix_order(codes)
        last = codes[order - 1]
        self.n, self.levels = len(codes), max(1, int(codes.max()).bit_length())
        self.below = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=int(codes.max()) + 1))])
        self.last = last
        # a walk back from a match ends at a kept position, or at the first symbol of a part
        kept = (order % SAMPLING == 0) | (last == 0)
        self.kept, self.kept_rank, self.positions = kept, np.cumsum(kept) - 1, order[kept]
        self.ones, self.zeros, symbols = [], [], last
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(len(self.below) - 1)
        self.start = self._walk(every, np.zeros(len(every), np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for ones, zeros, level in zip(self.ones, self.zeros, reversed(range(self.levels))):
            rank = ones[at]
            at = np.where((symbols >> level) & 1, zeros + rank, at - rank)
        return at

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First row of each symbol, plus the number of times that it comes in the transform before ``at``."""
        return self.below[symbols] + self._walk(symbols, at) - self.start[symbols]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases (rows of a matrix) that occur, and positions, one pair an occurrence."""
        which = np.flatnonzero((phrases < len(self.below) - 1).all(axis=1))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n)
        for column in reversed(range(phrases.shape[1])):
            symbols = phrases[which, column]
            low, high = self.step(symbols, low), self.step(symbols, high)
            there = high > low
            which, low, high = which[there], low[there], high[there]
            if not len(which):
                break
        many = high - low
        rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(which, many), self._locate(rows)

    def _locate(self, rows: np.ndarray) -> np.ndarray:
        found, open_ = np.zeros(len(rows), np.int64), np.arange(len(rows))
        steps = 0
        while len(open_):
            here = self.kept[rows]
            found[open_[here]] = self.positions[self.kept_rank[rows[here]]] + steps
            open_, rows = open_[~here], rows[~here]
            rows = self.step(self.last[rows], rows)
            steps += 1
        return found


def _stretches(ids: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in stretches of ``least`` or more known words of one text, and the stretch of each."""
    known = ids > 0
    breaks = np.ones(len(ids), bool)
    breaks[1:] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
    stretch = np.cumsum(breaks) - 1
    long_ = (np.bincount(stretch) >= least)[stretch] & known if len(ids) else known
    places = np.flatnonzero(long_)
    return places, stretch[places]


def _phrases(item_ids: list[int], texts: list[str], k: int) -> dict:
    """Distinct runs of ``k`` words of the items as rows of word numbers, and the items of each."""
    flat, owner = words(texts)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    n = max(len(ids) - k + 1, 0)
    starts = np.flatnonzero(owner[:n] == owner[k - 1 :]) if n else np.zeros(0, np.int64)
    runs = ids[starts[:, None] + np.arange(k)] if len(starts) else np.zeros((0, k), np.int64)
    distinct, which = np.unique(runs, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.reshape(-1), owner[starts].astype(np.int64)], axis=1), axis=0)
    return {"vocabulary": coded.dictionary, "phrases": distinct, "phrase": pairs[:, 0], "item": np.array(item_ids, np.int64)[pairs[:, 1]]}


def _searched(shared, k: int):
    def shard(keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        flat, owner = words(texts)
        ids = pc.fill_null(pc.add(pc.index_in(flat, value_set=known["vocabulary"]), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        places, stretch = _stretches(ids, owner, k)
        if not len(places):
            return
        new = np.concatenate([[0], np.cumsum(stretch[1:] != stretch[:-1])])
        codes = np.zeros(len(places) + int(new[-1]) + 1, np.int64)
        codes[np.arange(len(places)) + new] = ids[places]
        phrase, at = FMIndex(codes).search(known["phrases"])
        if not len(phrase):
            return
        word = places[at - np.searchsorted(np.flatnonzero(codes == 0), at)]
        doc = owner[word].astype(np.int64)
        start = word - np.searchsorted(owner, doc)
        # spans of a document that touch become one, whatever items they are of
        order = np.lexsort((start, doc))
        d, s, phrase = doc[order], start[order], phrase[order]
        apart = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + k)])
        begins = np.flatnonzero(apart)
        ends = np.concatenate([begins[1:], [len(d)]])
        # each phrase once a span, and then the items that have it
        once = np.unique(np.stack([np.cumsum(apart) - 1, phrase], axis=1), axis=0)
        span, phrase = once[:, 0], once[:, 1]
        first, last = np.searchsorted(known["phrase"], phrase), np.searchsorted(known["phrase"], phrase, side="right")
        at, total = 0, np.concatenate([[0], np.cumsum(last - first)])
        while at < len(begins):  # spans whose items fit into memory together, or one
            row = int(np.searchsorted(span, at))
            to = max(at + 1, int(span[min(np.searchsorted(total, total[row] + ITEMS_A_STEP, side="right") - 1, len(span) - 1)]))
            to = len(begins) if total[-1] - total[row] <= ITEMS_A_STEP else to
            r = slice(row, int(np.searchsorted(span, to)))
            n = (last - first)[r]
            which = np.repeat(np.arange(r.start, r.stop), n)
            item = known["item"][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[r], n)]
            pairs = np.unique(np.stack([span[which], item], axis=1), axis=0)
            offsets = np.searchsorted(pairs[:, 0], np.arange(at, to + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in d[begins[at:to]]]),
                    pa.array(s[begins[at:to]].astype(np.int32)),
                    pa.array((s[ends[at:to] - 1] + k).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs[:, 1])),
                ],
                ["key", "start_word", "end_word", "item_ids"],
            )
            at = to

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, chars = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                keys.append(key)
                texts.append(text)
                chars += len(text)
                if chars >= SHARD_CHARS:
                    yield from shard(keys, texts)
                    keys, texts, chars = [], [], 0
        if texts:
            yield from shard(keys, texts)

    return search


def leaked_spans(documents: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str, k: int = 12) -> DataFrame:
    """Where documents hold ``k`` or more consecutive words of an item.

    Returns ``key``, ``start_word``, ``end_word`` (exclusive, counted from 0 in words of the
    document) and ``item_ids``, the items found there. Matches that overlap or touch are one span. A
    word is a maximal run of letters or digits of the lower-cased text.

    ``documents.key`` and ``items.item_key`` are integers. Null keys and texts and items of fewer
    than ``k`` words match nothing; a document that comes twice is reported twice. Other columns are
    ignored. Documents aren't shuffled. The items of one pass, at most ``ITEMS_A_PASS`` or so, are sent
    to all tasks; more items take more passes over the documents.
    """
    spark = documents.sparkSession
    stated = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).dropna().distinct()
    passes = max(1, -(-stated.count() // ITEMS_A_PASS))
    taken = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).dropna()
    found = None
    for i in range(passes):
        rows = stated.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).orderBy("id", "text").collect()
        shared = spark.sparkContext.broadcast(_phrases([r["id"] for r in rows], [r["text"] for r in rows], k))
        one = taken.mapInArrow(_searched(shared, k), "key long, start_word int, end_word int, item_ids array<long>")
        found = one if found is None else found.unionByName(one)
    return found.withColumnRenamed("key", key)
