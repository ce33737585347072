"""Queries against their SQL."""

import pytest
from mailframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    cursor = con.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in got.columns]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(tuple(str(r[i]) for i in order) for r in cursor.fetchall())
