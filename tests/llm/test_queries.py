"""The queries with SQL give the rows that DuckDB gives; the others run, over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from arclume.llm import queries
from scripts.verify import rows_of

AT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(AT).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(AT).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, AT)
    got = rows_of(df.columns, df.collect())
    if name in queries.SQL:
        rel = con.sql(queries.SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows_of(rel.columns, rel.fetchall())


def test_estimates_within_error(spark, con):
    df = queries.p4_daily(spark, AT)
    assert df.filter("error > 0.01").count() == 0
    checked = queries.p4_combinations(spark, AT)
    wrong = {r["stat_id"] for r in checked.filter("wrong").collect()}
    assert wrong == {r[0] for r in con.sql(queries.SQL["p4_found"]).fetchall()}
