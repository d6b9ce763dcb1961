"""The registered queries run, and agree with their SQL where they have it, on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SLOW = ("op", "pipeline")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else float(x) if hasattr(x, "as_tuple") else x for x in row)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(SLOW)])
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    want = tables.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(n) for n in names]
    expected = sorted((rounded(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert sorted((rounded(r[n] for n in names) for r in df.collect()), key=repr) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
