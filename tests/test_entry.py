"""Every query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.verify import rows_of

AT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = [q for q in entry.queries() if not q.startswith("p") or q[1:2] in "25" and q[2:3] == "_" or not q[1:2].isdigit()]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(AT).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not Path(AT).exists(), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, AT)
    got = rows_of(df.columns, df.collect())
    if name in entry.oracle_sql():
        rel = con.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows_of(rel.columns, rel.fetchall())


@pytest.mark.skipif(not Path(AT).exists(), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["id"]


def test_core_does_not_import_llm():
    for p in Path(entry.__file__).parent.glob("arclume/**/*.py"):
        if "llm" not in p.parts:
            assert "arclume.llm" not in p.read_text(), p
