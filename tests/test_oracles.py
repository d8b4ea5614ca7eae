"""Every query with SQL gives the rows that the SQL gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return str(int(v)) if isinstance(v, bool | int) else str(v)


@pytest.mark.parametrize("name", sorted(k for k in SQL if not k.startswith("op") and k != "pipeline"))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    want = db.execute(SQL[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    same = lambda x: [tuple("0" if v == "0.0" else v.removesuffix(".0") for v in r) for r in x]
    assert same(a) == same(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
