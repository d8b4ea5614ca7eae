"""Dependence queries run the kernel of a code object once, however often its records are read."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["ddg_edges", "ddg_arguments"])
def test_records_are_read_from_a_table(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan
