"""Every registered query with a SQL twin is run beside it at the smallest scale, where the test tables are there."""

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(x):
    if isinstance(x, Decimal):
        return float(x) if x % 1 else int(x)
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    return tuple((k, norm(v)) for k, v in sorted(x.items())) if isinstance(x, dict) else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


CORE = [n for n, f in entry.queries().items() if n in entry.oracle_sql()]


@pytest.mark.parametrize("name", CORE)
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = Counter(tuple(norm(r[columns.index(c)]) for c in order) for r in cur.fetchall())
    got = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    assert got == want
