import os
import random

import pytest

from quirestone.llm import pack
from quirestone.llm.pack import packed, token_sizes

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def run(spark, items, capacity, parts=4):
    df = spark.createDataFrame(items, "id long, n long, key string, piece string").repartition(parts)
    return [tuple(r) for r in packed(df, key="id", size="n", capacity=capacity).collect()]


def check(items, rows, capacity):
    used = {}
    pieces = {}
    for container, key, piece, start, tokens in rows:
        used[container] = used.get(container, 0) + tokens
        pieces.setdefault(key, []).append((piece, start, tokens))
    assert all(0 <= u <= capacity for u in used.values())
    for key, size, *_ in items:
        got, at = sorted(pieces.pop(key)), 0
        for i, (piece, start, tokens) in enumerate(got):
            assert (piece, start) == (i, at)
            at += tokens
        assert at == max(size or 0, 0)
        assert len(got) == max(1, -(-at // capacity))
    assert not pieces
    return used


@pytest.mark.parametrize("open_", [1, 64])
def test_all_items_are_placed_once(spark, monkeypatch, open_):
    monkeypatch.setattr(pack, "OPEN", open_)
    monkeypatch.setattr(pack, "FAN_IN", 2)
    rng = random.Random(1)
    items = [(i, rng.choice([0, 1, 7, 30, 99, 100, 101, 200, 350, None, -3, rng.randrange(100)]), "x", "y") for i in range(800)]
    check(items, run(spark, items, 100, 5), 100)


def test_little_room_is_left(spark):
    rng = random.Random(2)
    items = [(i, rng.randrange(1, 900), None, None) for i in range(6000)]
    used = check(items, run(spark, items, 2048), 2048)
    assert sum(used.values()) / (2048 * len(used)) > 0.985


def test_null_key_and_empty(spark):
    assert [r[1:] for r in run(spark, [(None, 3, None, None)], 10)] == [(None, 0, 0, 3)]
    assert run(spark, [], 10) == []
    with pytest.raises(ValueError):
        run(spark, [], 0)


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a" * 20_000)], "id long, body string")
    sizes = {r.id: r["size"] for r in token_sizes(df, key="id", text="body", ranks_file=RANKS).collect()}
    encode = pack.tokenizer(RANKS)
    assert sizes[2] == sizes[3] == 0 and sizes[1] == len(encode.encode_ordinary("Hello world")) and sizes[4] > 100
    assert encode.decode(encode.encode_ordinary("Hé 我 <|endoftext|>")) == "Hé 我 <|endoftext|>"


def test_many_empty_items(spark, monkeypatch):
    monkeypatch.setattr(pack, "MOST_EMPTY", 50)
    items = [(i, 0, "x", "y") for i in range(500)]
    rows = run(spark, items, 100)
    check(items, rows, 100)
    some = [(i, 0 if i % 10 else 60, "x", "y") for i in range(900)]
    used = check(some, run(spark, some, 100), 100)
    assert len([u for u in used.values() if u]) == 90
