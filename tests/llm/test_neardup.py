import random
from fractions import Fraction

import numpy as np

from quirestone.llm import neardup
from quirestone.llm.neardup import groups_of_records, near_duplicates, pairs_of_records

SCHEMA = "t string, id string, body string, space string, mark int, rid long"


def shingles(text, k):
    import re

    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(rows, k, p, q, least):
    sets = {(t, i): shingles(b, k) for t, i, b in rows if i is not None and b is not None}
    keys = sorted(sets)
    return sorted(
        (x[0], x[1], y[1])
        for n, x in enumerate(keys)
        for y in keys[n + 1 :]
        if x[0] == y[0] and sets[x][1] >= least and sets[y][1] >= least and q * len(sets[x][0] & sets[y][0]) >= p * len(sets[x][0] | sets[y][0])
    )


def data(rng, n=150):
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 30, 60, 400]))]
        rows.append((rng.choice("ab"), f"id{i}", " ".join(w)))
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "other", 1, 2) for r in rows], SCHEMA)
    return near_duplicates(df, key="id", text="body", space="t", **more)


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = data(rng)
    rows += rows[:5] + [("a", None, "x " * 30), ("a", "null", None), ("a", "blank", "   "), ("b", "marks", "!!! ...")]
    rows += [("a", "long1", " ".join(f"v{i}" for i in range(5000))), ("a", "long2", " ".join(f"v{i}" for i in range(0, 5100)))]
    for k, s, p, q in ((3, "0.6", 3, 5), (5, "0.8", 4, 5), (1, "1", 1, 1)):
        want = brute(rows, k, p, q, max(k, 10))
        assert sorted(map(tuple, pairs_of_records(*run(spark, rows, k=k, similarity=s, min_words=10)).collect())) == want
    monkeypatch.setattr(neardup, "HOT_SETS", 3)
    monkeypatch.setattr(neardup, "_PAIRS", 64)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr("quirestone.llm.words.SLICE_BYTES", 5000)
    assert sorted(map(tuple, pairs_of_records(*run(spark, rows, k=3, similarity="0.6")).collect())) == brute(rows, 3, 3, 5, 3)


def test_groups_are_components(spark):
    rows = data(random.Random(5))
    links = {}
    for t, x, y in brute(rows, 3, 3, 5, 3):
        links.setdefault((t, x), set()).add(y)
        links.setdefault((t, y), set()).add(x)

    def least(t, i):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get((t, todo.pop()), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    want = sorted((t, i, least(t, i)) for t, i, b in rows if shingles(b, 3)[1] >= 3)
    assert sorted((r.space, r.key, r.group_key) for r in groups_of_records(*run(spark, rows, k=3, similarity="0.6")).collect()) == want


def test_empty_table(spark):
    classes, links = run(spark, [])
    assert classes.count() == 0 and links.count() == 0 and pairs_of_records(classes, links).count() == 0 and groups_of_records(classes, links).count() == 0


def test_a_text_of_half_a_million_words(spark):
    rng = random.Random(9)
    w = [f"v{rng.randrange(200_000)}" for _ in range(500_000)]
    other = list(w)
    for _ in range(5000):
        other[rng.randrange(len(other))] = "edited"
    rows = [("a", "long", " ".join(w)), ("a", "edited", " ".join(other)), ("a", "copy", " ".join(w)), ("a", "half", " ".join(w[:250_000])), ("a", "short", " ".join(w[:50]))]
    pairs = sorted(map(tuple, pairs_of_records(*run(spark, rows, k=3, similarity="0.6")).collect()))
    assert pairs == [("a", "copy", "edited"), ("a", "copy", "long"), ("a", "edited", "long")]


def test_counts_are_true(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(neardup, "LEAST_BLOCK_BYTES", 1)
    rows = data(random.Random(11), 60)
    df = spark.createDataFrame([(i % 7, i, s, b) for i, (s, _, b) in enumerate(rows)], "block int, rid long, space string, text string").repartition(3)
    for parts in (1, 5):
        got = neardup._counted(df, 3, parts).collect()
        total = {}
        for s, _, b in rows:
            for x in shingles(b, 3)[0]:
                total[(s, x)] = total.get((s, x), 0) + 1
        for block in range(7):
            mine = {(s, x) for i, (s, _, b) in enumerate(rows) if i % 7 == block for x in shingles(b, 3)[0]}
            counts = [int(c) for r in got if r.block == block for c in neardup._unpack(r.counts, np.uint32, r.n)]
            assert sorted(counts) == sorted(total[m] for m in mine)


def test_a_shingle_of_very_many_sets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_SETS", 5)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(40)] = f"x{i}"
        rows.append(("a", f"id{i:02}", " ".join(w)))
    assert sorted(map(tuple, pairs_of_records(*run(spark, rows, k=3, similarity="0.6")).collect())) == brute(rows, 3, 3, 5, 3)


def test_shares_of_a_hash_add_up():
    codes = np.sort(np.random.default_rng(1).integers(0, 1 << neardup.CODE_BITS, 1000, dtype=np.uint64))
    for parts in (1, 7, 100_000):
        part = neardup._part(codes, parts)
        assert (np.diff(part) >= 0).all() and part.min() >= 0 and part.max() < parts
    assert (neardup._risen(neardup._rising(codes), 1000) == codes).all()


def test_few_pairs_are_kept_of_long_texts_that_share_a_passage(spark, monkeypatch):
    """places had sketches of 128 bits whatever the size, so nearly all pairs of long texts that met were written."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(30)]
    rows = [("a", f"id{i:03}", " ".join(passage + [f"v{rng.randrange(3000)}" for _ in range(rng.choice([300, 400, 700]))])) for i in range(90)]
    rows += [("a", f"near{i}", r[2] + " and more") for i, r in enumerate(rows[:9])]
    met = []
    plain = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name, *more: (met.append((name, done := plain(df, name, *more))), done)[1])
    got = sorted(map(tuple, pairs_of_records(*run(spark, rows, k=1, similarity="0.6")).collect()))
    assert got == brute(rows, 1, 3, 5, 1)
    pairs = {tuple(sorted(r)) for r in next(df for name, df in met if name == "pairs").collect()}
    assert len(got) >= 9 and len(pairs) < 400


def test_parts_of_sets_hold_every_pair(monkeypatch):
    """Whatever the sizes at which sets are cut, and whether pairs are looked at one by one or as a matrix, every pair that is alike meets."""
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (20, 40, 90, 200, 900)]
    sets = [np.unique(np.concatenate([b[: int(len(b) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(len(b) * rng.uniform(0, 0.2)), dtype=np.uint64)])) for b in base for _ in range(12)]
    owner, run = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    _, which, many = np.unique(run, return_inverse=True, return_counts=True)
    often = many[which]
    order = np.lexsort((run, often, owner))
    size = np.array([len(s) for s in sets])
    for p, q in ((3, 5), (1, 6), (4, 5)):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if q * (n := len(np.intersect1d(sets[i], sets[j]))) >= p * (len(sets[i]) + len(sets[j]) - n)}
        for whole, dense, matrix in ((16, 2, 8), (30, 5, 1 << 16), (10**9, 10**9, 1)):
            monkeypatch.setattr(neardup, "WHOLE", whole)
            monkeypatch.setattr(neardup, "_DENSE", dense)
            monkeypatch.setattr(neardup, "_MATRIX", matrix)
            code, part, place, _, of, length, sketches = neardup._cut(run[order], owner[order], often[order], size, Fraction(p, q))
            got = {x for a, b in neardup._met(code, place, of[part], length[part], sketches[part], Fraction(p, q)) for x in zip(a.tolist(), b.tolist())}
            assert want <= got and want


def test_keys_with_several_texts_are_in_a_pair_once(spark):
    rows = data(random.Random(31), 60)
    rows += [(t, f"id{(i * 7) % 60}", b) for i, (t, _, b) in enumerate(rows[:30])]
    texts = {}
    for t, i, b in rows:
        texts.setdefault((t, i), []).append(shingles(b, 3)[0])
    alike = lambda x, y: 5 * len(x & y) >= 3 * len(x | y)
    keys = sorted(texts)
    want = sorted((x[0], x[1], y[1]) for n, x in enumerate(keys) for y in keys[n + 1 :] if x[0] == y[0] and any(a and b and alike(a, b) for a in texts[x] for b in texts[y]))
    assert sorted(map(tuple, pairs_of_records(*run(spark, rows, k=3, similarity="0.6")).collect())) == want
    once = [r for n, r in enumerate(rows) if r[:2] not in {x[:2] for x in rows[:n]}]
    plan = pairs_of_records(*run(spark, once, k=3, similarity="0.6"))._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")
