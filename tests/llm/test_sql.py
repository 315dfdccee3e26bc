"""Queries of this subpackage against their SQL, over whole tables."""

import os

import duckdb
import pytest

from wirelake.llm import registry

DATA = os.environ.get("WIRELAKE_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    q = duck.sql(registry.oracle_sql()[name])
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in q.fetchall())
    kinds = {n: str(t) for n, t in zip(q.columns, q.types)}
    assert {f.name: {"bigint": "BIGINT", "string": "VARCHAR"}[f.dataType.simpleString()] for f in df.schema} == kinds
