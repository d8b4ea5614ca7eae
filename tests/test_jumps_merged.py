"""Jumps and places of instructions are not broadcast by the size of their files, which says little about their rows."""

import pytest

import __spark_entry__ as entry
from progdf.plans import package_queries


@pytest.mark.parametrize("name", ["ddg_arguments", "ddg_edges", "ddg_node_kinds", "ddg_reached"])
def test_programs_are_not_sent_through_the_driver(spark, monkeypatch, name):
    plans, real = {}, package_queries.saved

    def saved(df, table="table"):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, table)

    monkeypatch.setattr(package_queries, "saved", saved)
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert {"placed", "records"} <= set(plans)
    for table in ("placed", "records"):
        assert "SortMergeJoin" in plans[table] and "Broadcast" not in plans[table]
