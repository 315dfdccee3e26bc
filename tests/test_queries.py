"""Every query against its SQL, over the smallest tables."""

import decimal
import os

import duckdb
import pytest

from wirelake.plans import queries as Q

DATA = os.environ.get("WIRELAKE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(int(v))
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    q = duck.sql(Q.ORACLES[name])
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())


def test_every_query_without_sql_runs(spark):
    for name in set(Q.QUERIES) - set(Q.ORACLES):
        assert Q.QUERIES[name](spark, DATA).limit(1).collect()


def test_export_compares_packets_without_a_broadcast(spark):
    assert "BroadcastExchange" not in Q.QUERIES["pcap_export"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def both_of_users(spark, folder, name, users):
    """A query's rows and its SQL's, as text, over events of these users."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT unnest({users})::BIGINT AS user_id) TO '{folder}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df, q = Q.QUERIES[name](spark, str(folder)), c.sql(Q.ORACLES[name])
    at = [df.columns.index(x) for x in q.columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in df.collect()), sorted(tuple(plain(x) for x in r) for r in q.fetchall())


def test_numbers_above_32_bits_have_pseudonyms_of_their_own(spark, tmp_path):
    got, want = both_of_users(spark, tmp_path, "pseudonymise", [0, 1, 511, 63479, 63480, 63481, 70000, 89999])
    assert got == want


def test_places_of_all_users(spark, tmp_path):
    got, want = both_of_users(spark, tmp_path, "geo_lookup6", [0, 5, 6, 69, 255, 256, 261, 262, 1477, 65535, 65541, 65542, 89989])
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
