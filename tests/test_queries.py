"""Every registered query against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodeseek.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLES:
        want = db.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
        assert rows == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
