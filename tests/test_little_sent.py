"""Rounds of the call graph send no table through the driver that grows with the program."""

import pytest

from progdf.functions import parts
from progdf.operators import callgraph, pta

FIRST, ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_rounds_broadcast_small_tables_only(spark, monkeypatch):
    seen, plans, real = [], [], pta.saved

    def saved(df, name="table"):
        seen.append((spark.conf.get(FIRST), spark.conf.get(ADAPTIVE, None)))
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(pta, "saved", saved)
    monkeypatch.setattr(callgraph, "saved", saved)
    n = 60000  # function f calls f + 1, all reached from the first of each ten
    calls = real(spark.range(n).where("id % 10 <> 9").selectExpr("id AS site", "id AS caller", "id * 10 + 1 AS callee"), "calls")
    empty = lambda s: spark.createDataFrame([], s)
    edges, _ = callgraph.on_the_fly(
        pta.Constraints(spark, {"address": calls.selectExpr("callee AS value", "caller + 1 AS object")}), calls, spark.range(n).selectExpr("id AS object", "id AS code"), empty("body long, pos int, value long"),
        empty("body long, value long"), empty("site long, pos int, value long"), empty("site long, value long"), spark.range(0, n, 10).selectExpr("id AS code"),
    )
    assert edges.count() == n * 9 // 10 and edges.where("target = caller + 1").count() == n * 9 // 10
    assert seen and {x for x, _ in seen} == {f"{parts.SENT}b"} and {y for _, y in seen} == {None}
    assert spark.conf.get(FIRST) == "10485760b" and spark.conf.get(ADAPTIVE, None) is None
    # sites and facts are larger than that, and joined by a shuffle
    assert any("SortMergeJoin" in p for p in plans)


def test_limits_of_the_session_come_back(spark):
    try:
        for text, within in (("-1", "-1"), ("1k", "1k"), ("1m", f"{parts.SENT}b")):
            spark.conf.set(FIRST, text)
            spark.conf.set(ADAPTIVE, text)
            with pytest.raises(KeyError), parts.little_sent(spark):
                assert spark.conf.get(FIRST) == spark.conf.get(ADAPTIVE) == within
                raise KeyError
            assert spark.conf.get(FIRST) == spark.conf.get(ADAPTIVE) == text
    finally:
        spark.conf.unset(FIRST)
        spark.conf.unset(ADAPTIVE)
