"""Registered queries against DuckDB."""

import pytest

from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    want = sorted(map(str, c.sql(f"select {columns} from ({queries.ORACLE[name]})").fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) == want
