"""Each registered query of the library's own operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from orrery.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, duck):
    df = registry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql := registry.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_addresses_of_large_keys(spark, tmp_path):
    """Keys beyond 16 bits take more groups of an address."""
    keys = [k for edge in (1 << 16, 1 << 17, 1 << 20, 1 << 32, 1 << 40) for k in range(edge - 4, edge + 4)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    name = "V17_J12_ipv6_and_networks"
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
