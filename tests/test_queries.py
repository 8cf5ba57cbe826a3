import duckdb
import pytest

from siltstone.plans import oracle, registry

TABLES = "events orders lineitem".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_its_sql(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf)
    rows = got.collect()
    assert rows or name == "kv_point_get"  # no such user here
    if name in oracle.SQL:
        r = db.sql(oracle.SQL[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(repr, (tuple(row[c] for c in columns) for row in rows))) == sorted(map(repr, r.fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
