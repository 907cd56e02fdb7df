"""Every query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__
from keyloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    want = sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()))
    assert got == want


def test_merge_streams_in_ranges(spark, tmp_path):
    """Positions where each range of keys is a partition of its own, with negative keys and rows without one."""
    keys = "CASE WHEN range % 5000 = 7 THEN NULL ELSE range - 20000 END"
    duckdb.execute(f"COPY (SELECT {keys} AS o_orderkey, range AS o_custkey FROM range(40000)) TO '{tmp_path}/orders.parquet'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = QUERIES["merge_streams"](spark, str(tmp_path)).select("o_orderkey", "position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(ORACLES["merge_streams"]).fetchall()))


def test_without_sql(spark, data):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
