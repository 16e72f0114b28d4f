import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from quirestone.functions.text import WS_CHARS, content_hash, first_tokens, has_more_tokens, is_blank, normalize_ws, token_count, trim_ws, uuid5

TEXTS = [None, "", " ", "  A\n\nB\t C   ", "one two three four", "　x y\x1cz\x85", "a" * 30_000, WS_CHARS, "é​é", " trailing  "]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    t = F.col("t")
    return sorted(df.select("i", "t", normalize_ws(t).alias("norm"), trim_ws(t).alias("trim"), token_count(t).alias("n"), is_blank(t).alias("blank"), content_hash(t).alias("hash"), has_more_tokens(t, 2).alias("more")).collect())


def test_like_python(rows):
    assert len(WS_CHARS) == 29
    for r in rows:
        if r.t is None:
            assert (r.norm, r.n, r.blank, r.hash) == (None, 0, True, None)
            continue
        assert r.norm == " ".join(r.t.split())
        assert r.trim == r.t.strip()
        assert r.n == len(r.t.split()) and r.more == (r.n > 2)
        assert r.blank == (not r.t.strip())
        assert r.hash == hashlib.sha256(" ".join(r.t.split()).encode()).hexdigest()


@pytest.mark.parametrize(("n", "want"), [(0, ""), (2, "  one  two"), (9, "  one  two\nthree")])
def test_first_tokens(spark, n, want):
    assert spark.sql("select '  one  two\nthree  ' as t").select(first_tokens(F.col("t"), F.lit(n))).first()[0] == want


def test_uuid5(spark):
    names = ["", "composition:a:b", "é我", *map(str, range(40))]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(uuid.NAMESPACE_URL, F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in df.collect())
