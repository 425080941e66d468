"""Queries with SQL twins give the same rows."""

from collections import Counter

import duckdb
import pytest

from gridloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in found.description]
    want = Counter(found.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(order)
    assert Counter(tuple(r[c] for c in order) for r in df.collect()) == want
