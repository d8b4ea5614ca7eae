"""Encodings of tables hold for keys beyond those of the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("large_keys")
    tables = {
        "lineitem": "SELECT CAST(id % 9 AS LONG) l_orderkey, CAST(1000000 + 40 * id AS LONG) l_partkey, CAST(1 + 40 * id AS LONG) l_suppkey, CAST(id % 7 + 1 AS INT) l_linenumber, CAST(id % 50 + 1 AS DOUBLE) l_quantity FROM range(60)",
        "part": "SELECT CAST(1000000 + id AS LONG) p_partkey FROM range(2500)", "supplier": "SELECT CAST(1 + id AS LONG) s_suppkey FROM range(2500)",
    }
    for name, sql in tables.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    db = duckdb.connect()
    for name in tables:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return str(d), db


def same(spark, data, name):
    got, want = entry.queries()[name](spark, data[0]), data[1].execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(tuple, want.fetchall()))
    assert rows and sorted(tuple(r[c] for c in columns) for r in got.collect()) == rows


def test_parts_and_suppliers_are_different_objects(spark, data):
    same(spark, data, "constructor_calls")


def test_handlers_of_more_than_three_bytes(spark, data):
    same(spark, data, "exception_tables")
