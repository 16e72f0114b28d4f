import random

import pytest

from quirestone.llm.split import pieces, split_oversized


def check(text, limit, overlap):
    tokens, at, before = text.split(), 0, None
    for first, end, repeated, part in pieces(text, limit, overlap):
        assert part.split() == tokens[first:end] and part in text
        assert end - first <= limit
        assert first + repeated == at and end > at
        if before is not None:
            assert repeated == min(overlap, at)
            assert tokens[first:at] == before.split()[-repeated:] if repeated else True
        at, before = end, part
    assert at == len(tokens)


@pytest.mark.parametrize(("limit", "overlap"), [(10, 3), (7, 0), (5, 4), (500, 50)])
def test_pieces_cover_the_text(limit, overlap):
    rng = random.Random(limit)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb,", "c.", "dd!", "é;", "x" * 40]) + rng.choice([" "] * 6 + ["\n", "\n\n", "  ", " ", " ", "\r\n"]) for _ in range(rng.randrange(1, 1500)))
        check(text, limit, overlap)


def test_cuts_at_the_strongest_boundaries():
    paragraph = " ".join(["one two three."] * 3)
    parts = pieces("\n\n".join([paragraph] * 3), 12, 2)
    assert [(p[0] + p[2], p[1]) for p in parts] == [(0, 9), (9, 18), (18, 27)]
    assert [p[3].split("\n\n")[-1] for p in parts] == [paragraph] * 3


def test_without_boundaries_pieces_are_full():
    assert [(f, e) for f, e, _, _ in pieces("w " * 1000, 500, 50)] == [(0, 500), (450, 950), (900, 1000)]


def test_table(spark):
    rows = [("a", "x " * 501, 1), ("b", "x " * 500, 2), (None, "y " * 600, 3), ("c", None, 4), ("d", " \n ", 5), ("e", "z" * 200_000, 6), ("a", "x " * 501, 1)]
    df = spark.createDataFrame(rows, "id string, body string, piece int")
    got = split_oversized(df, keys=["id"], text="body").collect()
    assert sorted((str(r.id), r.piece, r.pieces, r.first_token, r.end_token, r.repeated) for r in got) == [
        ("None", 0, 2, 0, 500, 0), ("None", 1, 2, 450, 600, 50), ("a", 0, 2, 0, 500, 0), ("a", 0, 2, 0, 500, 0), ("a", 1, 2, 450, 501, 50), ("a", 1, 2, 450, 501, 50),
    ]
    assert split_oversized(df.limit(0), keys=["id"], text="body").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, keys=["id"], text="body", limit=50, overlap=50)
