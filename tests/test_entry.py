import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quirestone.plans import pipelines
from quirestone.plans.registry import ORACLE_SQL, QUERIES
from quirestone.session import clear_written

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 50


def test_core_stands_without_the_subpackage(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules['quirestone.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p3_found' not in e.queries() and 'p3_found' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_nothing_else_imports_the_subpackage():
    own = [p for p in (ROOT / "quirestone").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert own and not [p for p in own if "quirestone.llm" in p.read_text()]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_the_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    rows = lambda rs, pick: sorted(str([plain(v) for v in pick(r)]) for r in rs)
    assert rows(df.collect(), lambda r: [r[c] for c in columns]) == rows(want.fetchall(), lambda r: [r[i] for i in at])


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_asking_end_to_end(spark):
    folder = str(DATA)
    rows = pipelines.QUERIES["ask_pipeline"](spark, folder).collect()
    assert len(rows) == 300 and all(r.rejection or r.prompt_tokens > 0 for r in rows)
    assert any(r.context_tokens for r in rows)
    assert clear_written(spark) > 0


def test_incremental_index(spark):
    from tests.test_documents import element, frames

    e, s = frames(spark, [element(0, content="one", doc="a"), element(1, content="two", doc="b")])
    first = pipelines.index(e.filter("doc_id = 'a'"), s)
    both = pipelines.index(e, s, indexed=first.select("document_fingerprint"))
    assert [r.document_id for r in both.collect()] == ["b"]
    assert pipelines.index(e.filter("doc_id = 'a'"), s).select("point_id", "vector").collect() == first.select("point_id", "vector").collect()
