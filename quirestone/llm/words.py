"""Words and hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_NOT_WORD = r"[^\p{L}\p{N}]+"
# Odd 64-bit multipliers for mixing hashes.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


#: Bytes of text that are worked on at once.
SLICE_BYTES = 16_000_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in parts of at most ``SLICE_BYTES`` of text, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words(texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of the lower-cased texts in one array, and the number of the text of each.

    A word is a maximal run of letters or digits (Unicode L and N).
    """
    lowered = pa.array([t.lower() for t in texts], pa.large_string())
    lists = pc.split_pattern_regex(lowered, pattern=_NOT_WORD)
    flat, owner = lists.flatten(), np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.not_equal(pc.binary_length(flat), 0)
    return flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    coded = flat.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(each) else np.zeros(0, np.uint64)


def shingles(texts: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, the text of each, and the number of words of each text.

    Runs that a text has twice are there twice.
    """
    flat, owner = words(texts)
    counts = np.bincount(owner, minlength=len(texts))
    h, n = word_hashes(flat), len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), counts
    run = np.zeros(n, np.uint64)
    for i in range(k):
        run = mix(run * _MIX[0] + h[i : i + n])
    whole = owner[:n] == owner[k - 1 :]
    return run[whole], owner[:n][whole], counts
