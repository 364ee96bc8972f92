"""Every registered query against its DuckDB equivalent, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cloudloom.plans.registry import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(cols).collect()]
    assert rows
    if name in SQL:
        want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})").fetchall()
        got, want = sorted(rows, key=repr), sorted(map(tuple, want), key=repr)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b, abs=2e-6) if all(isinstance(v, (int, float)) and v is not None for v in (*a, *b)) else a == b


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
