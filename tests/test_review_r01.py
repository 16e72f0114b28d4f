"""Results against statements of the whole job, kept apart from the registered SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quirestone.operators.index import version_changes
from quirestone.operators.planning import review_findings
from quirestone.plans.registry import ORACLE_SQL, QUERIES

FOLDERS = [Path("/root/testdata") / n for n in ("sf0.001", "sf0.01")]


def rows_of(folder, statement):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.sql(statement).fetchall()


_SECTION = "CAST(regexp_extract(path, '^sections\\[(\\d+)\\]', 1) AS INTEGER)"
_ORDER_FINDINGS = f"""UNION ALL SELECT proposal_id, section_id, 'out_of_order', CAST(a AS VARCHAR) FROM (
  SELECT proposal_id, section_id, row_number() OVER (PARTITION BY proposal_id ORDER BY has, section_id) AS a, row_number() OVER (PARTITION BY proposal_id ORDER BY needs.ord, section_id) AS b
  FROM needs JOIN (SELECT proposal_id, section_id, min({_SECTION}) AS has FROM c GROUP BY ALL) USING (proposal_id, section_id)) WHERE a <> b)
SELECT finding"""


def turned(source, target):
    """The tables with the sections of every proposal in reverse order."""
    target.mkdir()
    con = duckdb.connect()
    for p in source.glob("*.parquet"):
        at = "* REPLACE (regexp_replace(path, '^sections\\[\\d+\\]', 'sections[' || (100 - " + _SECTION + ") || ']') AS path)" if p.stem == "transport_blocks" else "*"
        con.execute(f"COPY (SELECT {at} FROM '{p}') TO '{target / p.name}' (FORMAT parquet)")
    return target


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("folder", FOLDERS, ids=lambda p: p.name)
def test_review_summary_with_order_findings(spark, tmp_path, folder, reverse):
    if not folder.exists():
        pytest.skip("no test data")
    folder = turned(folder, tmp_path / "turned") if reverse else folder
    registered = ORACLE_SQL["review_summary"]
    whole = registered if "out_of_order" in registered else registered.replace(")\nSELECT finding", "\n" + _ORDER_FINDINGS)
    assert "out_of_order" in whole
    got = QUERIES["review_summary"](spark, str(folder)).collect()
    assert Counter(map(tuple, got)) == Counter(rows_of(folder, whole))
    assert any(r.finding == "out_of_order" for r in got) == reverse


def test_order_findings_once_a_part(spark):
    plan = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 2)], "k string, part string, ord int")
    schema = "k string, part string, ord int, text string, reference_ids array<string>"
    refs = spark.createDataFrame([], "k string, reference_id string")
    moved = lambda *rows: sorted((r.part, r.detail) for r in review_findings(plan, spark.createDataFrame([("p", *r, "x", []) for r in rows], schema), refs, key="k", part="part").filter(F.col("finding") == "out_of_order").collect())
    assert moved(("a", 0), ("a", 0), ("b", 1), ("c", 2)) == []
    assert moved(("b", 0), ("b", 0), ("a", 1), ("c", 2)) == [("a", "2"), ("b", "1")]


@pytest.mark.parametrize("folder", FOLDERS, ids=lambda p: p.name)
def test_answer_support_of_all_candidates(spark, folder):
    if not folder.exists():
        pytest.skip("no test data")
    whole = ORACLE_SQL["answer_support"].replace(" AND candidate_index < 20", "")
    assert Counter(map(tuple, QUERIES["answer_support"](spark, str(folder)).collect())) == Counter(rows_of(folder, whole))


_ALL_CHANGES = """WITH s AS (SELECT source AS before, lead(source) OVER (ORDER BY source) AS after FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND title IS NOT NULL)),
t AS (SELECT source, title, list_sort(list(DISTINCT coalesce('=' || text, ''))) AS texts FROM documents WHERE source IS NOT NULL AND title IS NOT NULL GROUP BY ALL),
o AS (SELECT before, after, title, texts FROM s JOIN t ON source = before WHERE after IS NOT NULL), n AS (SELECT before, after, title, texts FROM s JOIN t ON source = after)
SELECT coalesce(o.before, n.before), coalesce(o.after, n.after), coalesce(o.title, n.title), CASE WHEN o.title IS NULL THEN 'added' WHEN n.title IS NULL THEN 'removed' ELSE 'changed' END
FROM o FULL JOIN n ON o.before = n.before AND o.title = n.title WHERE o.title IS NULL OR n.title IS NULL OR o.texts <> n.texts"""


@pytest.mark.parametrize("folder", FOLDERS, ids=lambda p: p.name)
def test_package_changes_of_all_sources(spark, folder):
    if not folder.exists():
        pytest.skip("no test data")
    assert Counter(map(tuple, QUERIES["package_changes"](spark, str(folder)).collect())) == Counter(rows_of(folder, _ALL_CHANGES))


def test_version_changes(spark):
    rows = [("1", "x", "a"), ("1", "x", "z"), ("1", "y", None), ("1", "w", "w"), ("2", "x", "b"), ("2", "x", "z"), ("2", "y", None), ("3", "x", "z"), ("3", "x", "b"), ("3", "x", "b"), ("3", "y", ""), (None, "x", "n")]
    df = spark.createDataFrame(rows, "v string, p string, t string")
    got = sorted(map(tuple, version_changes(df, version="v", part="p", content="t").collect()))
    assert got == [("1", "2", "w", "removed"), ("1", "2", "x", "changed"), ("2", "3", "y", "changed")]
