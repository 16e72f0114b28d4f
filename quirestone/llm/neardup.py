"""Near-duplicate texts: an exact set-similarity join on word shingles.

Equal texts are first made one class, so that copies cost nothing. Each class is a set of shingles in
one global order, rare ones first: by the number of sets that have the shingle, counted over all of them.
Two sets can only be alike if they share a shingle in a short prefix of that order, so only prefixes are
shuffled, by shingle. Where two meet, bounds from their lengths, from the places of the shared shingle,
and from the Hamming distance of the rest discard nearly all pairs; what is left is verified once, on the
words themselves.

The counts are looked up by blocks of sets: a block asks for each shingle that it has once, the tasks
that hold a range of shingles add up what all blocks have, and answer in the order of the question. So
no table of counts is sent to all, and a shingle costs a few bytes a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestone.llm.words import mix, shingles, slices, words
from quirestone.operators.skew import hot_keys, join_spread
from quirestone.session import bucketed, written

#: Bytes of text in a block of sets, about, and with it what one task holds of the shingles.
BLOCK_BYTES = 16_000_000
#: No smaller blocks are made so as to have as many as there are shuffle partitions.
LEAST_BLOCK_BYTES = 4_000_000
#: Bits of a shingle's hash by which it is counted; the counts of shingles that share them are added up.
CODE_BITS = 48
#: Sets with one shingle in their prefixes beyond which that shingle's pairs are spread over tasks.
HOT_SETS = 20_000
#: 64-bit words of the parity sketch that goes with every place of a prefix; with 3 at most a distance fits a byte.
NARROW = 3
#: Shingles from which a set is cut into 4 parts by hash, and from 4 times as many into 16, and so on, so that such a sketch tells parts apart.
WHOLE = 128
#: Fewest cells of the sketch of a whole set, by which pairs are tested again.
LEAST_CELLS = 256
#: Pairs looked at in one numpy step, and rows of hot shingles.
_PAIRS = 1 << 20
#: Sets that one set meets in one shingle from which all pairs of several such sets are looked at as a matrix, and its cells.
_DENSE, _MATRIX = 48, 1 << 16


_CODEC = pa.Codec("zstd", 1)


def _pack(values: np.ndarray, kind: type) -> bytes:
    """Numbers as bytes, the first bytes of all, the second bytes, and so on, compressed."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T
    return _CODEC.compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(data, n * size, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _rising(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)), np.uint64)


def _risen(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64, n), dtype=np.uint64)


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    """The range of codes, of ``parts`` equal ones, in which each code lies."""
    return ((codes >> np.uint64(CODE_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _salted(run: np.ndarray, owner: np.ndarray, spaces: pa.Array) -> np.ndarray:
    """Shingles of different spaces never meet."""
    coded = spaces.dictionary_encode()
    salt = np.array([sum(s.encode()) * 0x9E3779B1 + len(s) for s in coded.dictionary.to_pylist()] or [0], np.uint64)
    return mix(run ^ mix(salt)[coded.indices.to_numpy(zero_copy_only=False)][owner]) if len(run) else run


def _sets_of(block: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each set of a block, ordered by shingle: shingle, number of the set, and sizes."""
    runs, owners, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for batch in chain.from_iterable(slices(b, "text") for b in block.to_batches()):
        run, owner, _ = shingles(batch.column("text").to_pylist(), k)
        run, owner = _salted(run, owner, batch.column("space")), owner.astype(np.int64)
        order = np.argsort(run, kind="stable")  # owners are in order already
        run, owner = run[order], owner[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
        runs.append(run[new])
        owners.append(owner[new] + before)
        before += batch.num_rows
    run, owner = np.concatenate(runs), np.concatenate(owners)
    if len(runs) > 2:
        order = np.argsort(run, kind="stable")
        run, owner = run[order], owner[order]
    return run, owner, np.bincount(owner, minlength=block.num_rows)


def _codes(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of ordered shingles, and where each begins."""
    code = run >> np.uint64(64 - CODE_BITS)
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[begins], begins


def _counted(sets: DataFrame, k: int, parts: int) -> DataFrame:
    """For every block of ``sets`` (block, rid, space, text) how many sets of all have its shingles: block, part, n, counts."""

    def ask(block: pa.Table) -> pa.Table:
        run, _, _ = _sets_of(block, k)
        code, begins = _codes(run)
        own = np.diff(np.append(begins, len(run)))
        at = np.append(np.searchsorted(_part(code, parts), np.arange(parts)), len(code))
        some = np.flatnonzero(np.diff(at)).tolist()
        return pa.table(
            [
                pa.array(some, pa.int32()),
                pa.array([block.column("block")[0].as_py()] * len(some), pa.int32()),
                pa.array([int(at[p + 1] - at[p]) for p in some], pa.int32()),
                pa.array([_rising(code[at[p] : at[p + 1]]) for p in some], pa.binary()),
                pa.array([_pack(own[at[p] : at[p + 1]], np.uint32) for p in some], pa.binary()),
            ],
            ["part", "block", "n", "codes", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        ends = np.cumsum([r["n"] for r in rows])
        code = np.concatenate([_risen(r["codes"], r["n"]) for r in rows])
        own = np.concatenate([_unpack(r["counts"], np.uint32, r["n"]) for r in rows]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        code = code[order]
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        total = np.empty(len(code), np.int64)
        total[order] = np.repeat(np.add.reduceat(own[order], begins), np.diff(np.append(begins, len(code))))
        counts = [_pack(np.minimum(total[end - r["n"] : end], 2**32 - 1), np.uint32) for r, end in zip(rows, ends.tolist())]
        whole = lambda c: pa.array([r[c] for r in rows], pa.int32())
        yield pa.RecordBatch.from_arrays([whole("block"), whole("part"), whole("n"), pa.array(counts, pa.binary())], ["block", "part", "n", "counts"])

    asked = sets.groupBy("block").applyInArrow(ask, "part int, block int, n int, codes binary, counts binary")
    return asked.repartitionById(parts, F.col("part")).mapInArrow(add, "block int, part int, n int, counts binary")


def _least_overlap(p: int, q: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fewest common shingles with which sets of sizes a and b reach the similarity p/q."""
    return -((-p * (a + b)) // (p + q))


def _cells(size: np.ndarray) -> np.ndarray:
    """Cells of the sketches of whole sets of these sizes: a power of two, 1.5 a shingle or more."""
    return np.maximum(LEAST_CELLS, 1 << np.ceil(np.log2(np.maximum(1.5 * size, 1))).astype(np.int64))


def _sketched(run: np.ndarray, owner: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each cell, ``wide[i]`` 64-bit words for set i, one after the other."""
    begin = np.concatenate([[0], np.cumsum(wide)])
    cell = (run >> np.uint64(8)).astype(np.int64) % (wide[owner] * 64)
    sketch = np.zeros(begin[-1], np.uint64)
    np.bitwise_xor.at(sketch, begin[owner] + (cell >> 6), np.uint64(1) << (cell & 63).astype(np.uint64))
    return sketch


def _level(size: np.ndarray) -> np.ndarray:
    """Sets of these sizes are cut into 4 to that power parts."""
    level, bound = np.zeros(len(size), np.int64), WHOLE
    while (over := size >= bound).any():
        level[over] += 1
        bound *= 4
    return level


def _cut(run: np.ndarray, owner: np.ndarray, often: np.ndarray, size: np.ndarray, sim: Fraction):
    """Places in the prefixes of the parts of sets: code, number of the part, place and count; and of each part its set, size and sketch.

    If two sets are alike, so are the parts of both that some share of all hashes has, for at least one share: else no share of their
    union had as much in common as it takes. Two sets meet in as many parts as the smaller one has; the larger one is
    cut in that way too. Shingles come by set, rare ones first.
    """
    p, q = sim.numerator, sim.denominator
    least, most = _level(-(-p * size // q)), _level(size)
    places, parts, before = [], [], 0
    for level in range(int(most.max(initial=0)) + 1):
        mine = ((least <= level) & (level <= most))[owner]
        r, who, n = run[mine], owner[mine], often[mine]
        code = r
        if level:
            share = (mix(r) & np.uint64(4**level - 1)).astype(np.int64)
            order = np.argsort((who << (2 * level)) | share, kind="stable")
            r, who, n, share = r[order], who[order], n[order], share[order]
            new = np.concatenate([[True], (who[1:] != who[:-1]) | (share[1:] != share[:-1])]) if len(r) else np.zeros(0, bool)
            code = mix(r ^ mix(np.array([level], np.uint64)))
        else:
            new = np.concatenate([[True], who[1:] != who[:-1]]) if len(r) else np.zeros(0, bool)
        begins, part = np.flatnonzero(new), np.cumsum(new) - 1
        length = np.diff(np.append(begins, len(r)))
        place = np.arange(len(r)) - begins[part]
        # a shingle that no other set has can't lead to a pair
        used = (place <= length[part] - -(-p * length[part] // q)) & (n > 1)
        places.append((code[used] >> np.uint64(64 - CODE_BITS), part[used] + before, place[used], n[used]))
        parts.append((who[begins], length, _sketched(r, part, np.full(len(length), NARROW)).reshape(-1, NARROW)))
        before += len(length)
    return *(np.concatenate(c) for c in zip(*places)), *(np.concatenate(c) for c in zip(*parts))


#: What a block sends on. kind 0: places of prefixes by the range of their shingles, to meet there; 1: the same of shingles
#: that may be hot; 2: sketches of whole sets.
_SENT = "kind int, part int, sets int, n int, rids binary, sizes binary, sketches binary, codes binary, owners binary, places binary"


def _prefixes(k: int, sim: Fraction, parts: int):
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _SENT.split(", ")])

    def send(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        block = block.sort_by("rid")
        number = block.column("block")[0].as_py()
        rids = block.column("rid").to_numpy().astype(np.uint64)
        run, owner, size = _sets_of(block, k)
        del block
        code, begins = _codes(run)
        answers = sorted(replies.select(["part", "n", "counts"]).to_pylist(), key=lambda r: r["part"])
        counts = np.concatenate([np.zeros(0, np.uint32), *[_unpack(r["counts"], np.uint32, r["n"]) for r in answers]])
        often = np.repeat(counts, np.diff(np.append(begins, len(run)))).astype(np.int64)
        wide = _cells(size) // 64
        whole = _sketched(run, owner, wide)
        order = np.argsort((owner << 32) | often, kind="stable")  # shingles are in order already
        code, owner, place, often, of, length, narrow = _cut(run[order], owner[order], often[order], size, sim)
        part = np.where(often > HOT_SETS, parts, _part(code, parts))
        order = np.argsort(code, kind="stable")  # parts are ranges of codes
        if (part == parts).any():
            order = np.concatenate([order[part[order] < parts], order[part[order] == parts]])
        code, owner, place, part = code[order], owner[order], place[order], part[order]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(part))
        rows = []
        for b, e in zip(at.tolist(), ends.tolist()):
            who, index = np.unique(owner[b:e], return_inverse=True)
            hot = part[b] == parts
            rows.append((int(hot), number % parts if hot else int(part[b]), len(who), e - b, _rising(rids[of[who]]), _pack(length[who], np.uint32), _pack(narrow[who].reshape(-1), np.uint64), _rising(code[b:e]), _pack(index, np.uint32), _pack(place[b:e], np.uint32)))
        some = np.flatnonzero(size)
        sent = np.repeat(size > 0, wide)
        rows.append((2, number % parts, len(some), int(sent.sum()), _rising(rids[some]), _pack(size[some], np.uint32), _pack(whole[sent], np.uint64), b"", b"", b""))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return send


def _met(run, place, rids, sizes, sketches, sim: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that share one of ``run`` and pass the filters, distinct in each result; rows are places of prefixes."""
    p, q = sim.numerator, sim.denominator
    # within a shingle by size, so that a set meets only those before it, which are no larger
    order = np.lexsort((sizes, run))
    run, place, size, sketches = run[order], place[order], sizes[order], sketches[order]
    names, who = np.unique(rids[order], return_inverse=True)
    group = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]])) if len(run) else run.astype(np.int64)
    del run, order
    # of the smaller of two sets, only a shorter prefix can hold the first shared shingle
    indexed = np.flatnonzero(place <= size - _least_overlap(p, q, size, size))
    key = (group[indexed] << 32) | size[indexed]
    low = np.searchsorted(key, (group << 32) | (-(-p * size // q)))
    # and the rest of the larger one must be long enough for both
    most = np.clip((p + q) * (size - place) // p - size, 0, size)
    high = np.minimum(np.searchsorted(indexed, np.arange(len(group))), np.searchsorted(key, (group << 32) | most, side="right"))
    many = np.maximum(high - low, 0)
    size_i, place_i, who_i, sketches_i = size[indexed], place[indexed], who[indexed], sketches[indexed]
    words_i = np.ascontiguousarray(sketches_i.T)
    # a bound of the distance as a sum of one number of each set
    share = np.minimum(-((p - q) * size // (p + q)), 64 * NARROW).astype(np.int16)
    share_i = share[indexed]

    def fit(left: np.ndarray, right: np.ndarray, apart: np.ndarray) -> np.ndarray:
        need = _least_overlap(p, q, size[left], size_i[right])
        ok = (size_i[right] - place_i[right] >= need) & (apart <= size[left] + size_i[right] - 2 * need)
        a, b = who[left[ok]], who_i[right[ok]]
        return (np.minimum(a, b) * len(names) + np.maximum(a, b))[a != b]

    def sparse() -> Iterator[np.ndarray]:
        rows = np.flatnonzero((many > 0) & (many < _DENSE))
        ends = np.cumsum(many[rows])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
            n = many[rows[at:to]]
            left = np.repeat(rows[at:to], n)
            right = np.arange(len(left)) + np.repeat(low[rows[at:to]] - np.cumsum(n) + n, n)
            apart = np.bitwise_count(sketches[left] ^ sketches_i[right]).sum(axis=1, dtype=np.int64)
            yield fit(left, right, apart)
            at = to

    def dense() -> Iterator[np.ndarray]:
        rows = np.flatnonzero(many >= _DENSE)
        ends = np.append(np.flatnonzero(np.diff(group[rows])) + 1, len(rows)) if len(rows) else rows
        at = 0
        for end in ends.tolist():
            while at < end:
                first = int(low[rows[at]])  # bounds below rise with the size
                own = rows[at : min(end, at + max(1, _MATRIX // int(many[rows[at]])))]
                for begin in range(first, stop := int(high[own].max()), _MATRIX):
                    some = slice(begin, min(begin + _MATRIX, stop))
                    apart = np.bitwise_count(sketches[own, 0][:, None] ^ words_i[0, some])
                    for i in range(1, NARROW):
                        apart += np.bitwise_count(sketches[own, i][:, None] ^ words_i[i, some])
                    near = np.flatnonzero(apart <= share[own][:, None] + share_i[some])
                    left, right = own[near // apart.shape[1]], near % apart.shape[1] + begin
                    ok = (right >= low[left]) & (right < high[left])
                    yield fit(left[ok], right[ok], apart.reshape(-1)[near[ok]].astype(np.int64))
                at += len(own)

    seen, new, n = np.zeros(0, np.int64), [], 0
    for found in chain(sparse(), dense()):
        new.append(found)
        n += len(found)
        if n > _PAIRS:
            seen, new, n = np.unique(np.concatenate([seen, *new])), [], 0
            if len(seen) > _PAIRS:
                yield names[seen // len(names)], names[seen % len(names)]
                seen = seen[:0]
    seen = np.unique(np.concatenate([seen, *new]))
    if len(seen):
        yield names[seen // len(names)], names[seen % len(names)]


#: What comes of that. kind 0: a and b are sets that may be alike; 1: a is a shingle and b a set; 2: a is a set and b its block.
_FOUND = "kind int, a long, b long, size int, place int, sketch binary"


def _words(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary of ``lengths[i]`` 64-bit words each, cut from ``values`` in order."""
    offsets = (np.concatenate([[0], np.cumsum(lengths)]) * 8).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype(np.uint64).tobytes())]).cast(pa.binary())


def _meeting(sim: Fraction):
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def rows(kind, a, b=None, size=None, place=None, sketch=None) -> pa.RecordBatch:
        column = lambda x, t: pa.nulls(len(a), t) if x is None else x if isinstance(x, pa.Array) else pa.array(x.astype(t.to_pandas_dtype()), t)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([column(x, t) for x, t in zip((np.full(len(a), kind), a, b, size, place, sketch), types)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = []
        for r in (r for batch in batches for r in batch.to_pylist()):
            rids, sizes = _risen(r["rids"], r["sets"]).astype(np.int64), _unpack(r["sizes"], np.uint32, r["sets"]).astype(np.int64)
            if r["kind"] == 2:
                yield rows(2, rids, np.full(len(rids), r["part"]), size=sizes, sketch=_words(_unpack(r["sketches"], np.uint64, r["n"]), _cells(sizes) // 64))
                continue
            owner, sketches = _unpack(r["owners"], np.uint32, r["n"]).astype(np.int64), _unpack(r["sketches"], np.uint64, r["sets"] * NARROW).reshape(-1, NARROW)
            one = (_risen(r["codes"], r["n"]), _unpack(r["places"], np.uint32, r["n"]).astype(np.int64), rids[owner], sizes[owner], sketches[owner])
            if r["kind"] == 0:
                places.append(one)
            elif r["n"]:
                yield rows(1, one[0].astype(np.int64), one[2], one[3], one[1], _words(one[4].reshape(-1), np.full(r["n"], NARROW)))
        if places:
            columns = [np.concatenate(c) for c in zip(*places)]
            del places
            for a, b in _met(*columns, sim):
                yield rows(0, a, b)

    return meet


def _meeting_in_cells(sim: Fraction):
    """The same for rows of hot shingles, which come by ``cell`` (cell, rid, size, place, sketch)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, NARROW)
            number = lambda c: table.column(c).to_numpy().astype(np.int64)
            for a, b in _met(number("cell").view(np.uint64), number("place"), number("rid"), number("size"), sketches, sim):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["x", "y"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > _PAIRS:  # all cells but the last, which may go on, are whole
                table = pa.Table.from_batches(held)
                cells = table.column("cell").to_numpy()
                whole = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if cells[0] != cells[-1] else 0
                if whole:
                    yield from pairs(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    n -= whole
        if n:
            yield from pairs(pa.Table.from_batches(held))

    return meet


def _of_hot(places: DataFrame, sim: Fraction) -> DataFrame:
    """Pairs ``x``, ``y`` that meet in shingles which very many sets have, counted in prefixes: each cell of two blocks of sets is a task's."""
    named = places.select(F.col("a").alias("code"), F.col("b").alias("rid"), "size", "place", "sketch")
    counted = named.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / HOT_SETS).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rid"), F.col("blocks")).alias("mine")
    each = join_spread(named, counted, ["code"], ["rid"]).select("*", mine, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("code", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell")
    cells = each.select(cell, "rid", "size", "place", "sketch").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_meeting_in_cells(sim), "x long, y long")


class _Sketches:
    """Sketches of sets of any size; two of them are compared in the cells of the smaller."""

    def __init__(self, words: np.ndarray, cells: np.ndarray):
        self.wide, self.matrix, self.index = cells // 64, {}, {}
        begin = np.cumsum(self.wide) - self.wide
        for wide in np.unique(self.wide)[::-1].tolist():
            rows = np.flatnonzero(self.wide == wide)
            own = words[begin[rows][:, None] + np.arange(wide)]
            index = np.full(len(cells), -1)
            if wide * 2 in self.matrix:  # a cell of the half as wide sketch is the parity of two
                larger = np.flatnonzero(self.index[wide * 2] >= 0)
                folded = self.matrix[wide * 2][self.index[wide * 2][larger]]
                rows, own = np.concatenate([rows, larger]), np.concatenate([own, folded[:, :wide] ^ folded[:, wide:]])
            index[rows] = np.arange(len(rows))
            self.matrix[wide], self.index[wide] = own, index

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Least Hamming distance of the sets of these rows."""
        both, out = np.minimum(self.wide[left], self.wide[right]), np.zeros(len(left), np.int64)
        for wide in np.unique(both).tolist():
            at = np.flatnonzero(both == wide)
            index, matrix = self.index[wide], self.matrix[wide]
            x, y = index[left[at]], index[right[at]]
            known = (x >= 0) & (y >= 0)
            out[at[known]] = np.bitwise_count(matrix[x[known]] ^ matrix[y[known]]).sum(axis=1, dtype=np.int64)
        return out


def _near_enough(sim: Fraction):
    """Pairs whose sketches of whole sets allow the similarity."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices(b, "sketch_y") for b in batches):
            n = batch.num_rows
            if not n:
                continue
            size = np.concatenate([batch.column(c).to_numpy().astype(np.int64) for c in ("size_x", "size_y")])
            sketches = np.frombuffer(b"".join(x for c in ("sketch_x", "sketch_y") for x in batch.column(c).to_pylist()), np.uint64)
            apart = _Sketches(sketches, _cells(size)).apart(np.arange(n), np.arange(n, 2 * n))
            ok = apart <= size[:n] + size[n:] - 2 * _least_overlap(sim.numerator, sim.denominator, size[:n], size[n:])
            yield batch.select(["x", "y", "block_x", "block_y"]).filter(pa.array(ok))

    return test


def _with_text(pairs: pa.Table, sets: pa.Table, side: str) -> tuple[pa.Array, pa.Array]:
    """Class and text of the set named in ``side`` of each pair, from the block that has it."""
    row = pc.index_in(pairs.column(side), value_set=sets.column("rid").combine_chunks())
    return sets.column("class_id").take(row), sets.column("text").take(row)


_FIRST = "y long, block_y int, a string, text_a string"


def _attached(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    a, text = _with_text(pairs, sets, "x")
    return pa.table([pairs.column("y"), pairs.column("block_y"), a, text], ["y", "block_y", "a", "text_a"])


def _verified(k: int, sim: Fraction):
    def sets_of(texts: list[str]) -> list[set]:
        flat, owner = words(texts)
        flat, ends = flat.to_pylist(), np.searchsorted(owner, np.arange(len(texts)), side="right").tolist()
        return [set(zip(*(flat[b + i : e - k + 1 + i] for i in range(k)))) if e - b >= k else set() for b, e in zip([0, *ends], ends)]

    def verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        b, text = _with_text(pairs, sets, "y")
        out = [pa.table([pa.array([], pa.string())] * 2 + [pa.array([], pa.int32())] * 2, ["a", "b", "common", "all"])]
        both = pa.table([pairs.column("a"), b, pairs.column("text_a"), text], ["a", "b", "text_a", "text_b"])
        for batch in chain.from_iterable(slices(x, "text_b") for x in both.to_batches(max_chunksize=10_000)):
            common, all_ = [], []
            for x, y in zip(sets_of(batch.column("text_a").to_pylist()), sets_of(batch.column("text_b").to_pylist())):
                common.append(n := len(x & y))
                all_.append(len(x) + len(y) - n)
            ok = pa.array([n * sim.denominator >= sim.numerator * m for n, m in zip(common, all_)], pa.bool_())
            out.append(pa.table([batch.column("a"), batch.column("b"), pa.array(common, pa.int32()), pa.array(all_, pa.int32())], ["a", "b", "common", "all"]).filter(ok))
        return pa.concat_tables(out)

    return verify


def _has_words(text: Column, n: int) -> Column:
    """Whether a text has ``n`` words; nothing is read behind the n-th."""
    word = r"[a-z0-9[\p{L}\p{N}]]++"
    if n > 100:
        return F.regexp_count(F.lower(text), F.lit(word)) >= n
    return F.lower(text).rlike(rf"^[^\p{{L}}\p{{N}}]*+(?:{word}[^\p{{L}}\p{{N}}]*+){{{n}}}")


def near_duplicates(records: DataFrame, *, key: str, text: str, space: str | None = None, k: int = 5, similarity: float | str = "0.8", min_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts whose shingles of ``k`` words have a Jaccard similarity of ``similarity`` or more.

    Returns two tables:

    * classes: ``space``, ``key``, ``class_id``, distinct; records of one space with equal texts
      share a class. Records with fewer than ``min_words`` words (default ``k``), or a null key or
      text, are in no class.
    * links: ``a`` < ``b`` (class ids), ``common`` and ``all``: numbers of distinct shingles that
      both or any of them have. Every pair of classes that reaches the similarity, once.

    A class id is the digest of the text and the space. Only records with the same ``space`` are compared. A record
    may come repeatedly; if a key has several texts, it is in several classes. Other columns are
    ignored. Nothing is left out: a shingle in the prefixes of more than ``HOT_SETS`` sets is
    spread over pairs of blocks of these. Blocks of sets and ranges of shingles are as many as the texts
    need, so that a task holds about as much whatever the corpus.
    """
    sim, spark = Fraction(str(similarity)), records.sparkSession
    if not 0 < sim <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    rows = records.select((F.col(space) if space else F.lit("")).cast("string").alias("space"), F.col(key).alias("key"), F.col(text).alias("text")).dropna()
    rows = rows.filter(_has_words(F.col("text"), max(min_words or k, k))).withColumn("mark", F.md5("text"))
    volume = records.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, math.ceil(volume / BLOCK_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(volume / LEAST_BLOCK_BYTES)))
    block = F.pmod(F.xxhash64("mark", "space"), F.lit(parts)).cast("int").alias("block")
    once = rows.select(block, "space", "mark", "text").repartition(parts, "block").groupBy("block", "space", "mark").agg(F.first("text").alias("text"))
    sets = bucketed(once.withColumn("rid", F.monotonically_increasing_id()), "sets", "block", parts)
    numbers = _counted(sets.select("block", "rid", "space", "text"), k, parts)
    sent = sets.select("block", "rid", "space", "text").groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(_prefixes(k, sim, parts), _SENT)
    found = written(sent.repartitionById(parts, F.col("part")).mapInArrow(_meeting(sim), _FOUND), "found")
    met, hot = found.filter("kind = 0").select(F.col("a").alias("x"), F.col("b").alias("y")), found.filter("kind = 1")
    if not hot.isEmpty():
        met = met.unionByName(_of_hot(hot, sim))
    pairs = written(met.distinct(), "pairs")
    sketch = lambda c: found.filter("kind = 2").select(F.col("a").alias(c), F.col("b").cast("int").alias(f"block_{c}"), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    tested = join_spread(join_spread(pairs, sketch("x"), ["x"], ["y"]), sketch("y"), ["y"], ["x"], hot=hot_keys(pairs, ["y"]))
    near = written(tested.mapInArrow(_near_enough(sim), "x long, y long, block_x int, block_y int"), "near")
    # pairs go to the block of the one set and then of the other; the texts stay where they are
    texts = sets.select("block", "rid", F.concat_ws(":", "mark", "space").alias("class_id"), "text").groupBy("block")
    first = near.groupBy("block_x").cogroup(texts).applyInArrow(_attached, _FIRST)
    links = first.groupBy("block_y").cogroup(texts).applyInArrow(_verified(k, sim), "a string, b string, common int, all int")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "all")
    classes = rows.select("space", "key", F.concat_ws(":", "mark", "space").alias("class_id")).distinct()
    return written(classes, "classes"), links


def pairs_of_records(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``space``, ``key_a`` < ``key_b`` of every pair of records that are alike, equal texts included.

    As many rows as there are pairs; ``classes`` and ``links`` say the same in fewer. Only a key with several texts can
    be in a pair twice, so only the pairs of such keys are compared with each other.
    """
    several = classes.groupBy("space", "key").agg(F.count(F.lit(1)).alias("several")).filter("several > 1")
    named = written(join_spread(classes, several, ["space", "key"], ["class_id"], "left").select("space", "key", "class_id", F.col("several").isNotNull().alias("several")), "named")
    copied = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    linked = links.select("a", "b").unionByName(copied)
    side = lambda c: named.select(F.col("class_id").alias(c), F.col("key").alias(f"_{c}"), F.col("several").alias(f"several_{c}"), *["space"][: c == "a"])
    some, other = written(join_spread(side("a"), linked, ["a"], ["_a"]), "some"), side("b")

    def pairs(some: DataFrame, other: DataFrame) -> DataFrame:
        both = join_spread(some, other, ["b"], ["_a", "a"]).filter((F.col("a") != F.col("b")) & (F.col("_a") != F.col("_b")) | (F.col("_a") < F.col("_b")))
        return both.select("space", F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b"))

    once = pairs(some.filter("not several_a"), other.filter("not several_b"))
    if several.isEmpty():
        return once
    again = pairs(some.filter("several_a"), other).unionByName(pairs(some.filter("not several_a"), other.filter("several_b")))
    return once.unionByName(again.distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the graph with the edges ``a``-``b``: ``node`` and ``root``.

    The root is the least node of the component. Alternates the large-star and small-star steps,
    each two joins on the node, until nothing changes; the number of rounds grows with the logarithm of the
    size of a component. A node with very many edges is reduced to its least neighbour on the map side.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_spread(both.filter("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_spread(large, least, ["u"], ["v"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = written(small, "edges")
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def groups_of_records(classes: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each record in a class: ``space``, ``key``, ``group_key``, ``links``.

    Records that are alike, directly or over others, have the same ``group_key``, the least key of the group;
    ``links`` is the number of other classes that the record's class is alike to.
    """
    links = written(links, "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    each = classes.groupBy("space", "class_id").agg(F.min("key").alias("least_key"))
    rooted = each.join(components(links).withColumnRenamed("node", "class_id"), "class_id", "left").join(degree, "class_id", "left")
    rooted = written(rooted.select("space", "class_id", "least_key", F.coalesce("root", "class_id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "roots")
    named = rooted.groupBy("root").agg(F.min("least_key").alias("group_key"))
    of_class = join_spread(rooted, named, ["root"], ["class_id"]).select("class_id", "group_key", "links")
    return join_spread(classes, of_class, ["class_id"], ["key"]).select("space", "key", "group_key", "links")
