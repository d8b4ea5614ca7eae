"""Rows are not multiplied to count what is distinct."""

from progdf.operators import classes


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_merge_without_rows_for_distinct_counts(spark):
    rows = [(1, 1, "DynamicCall", ["a"], None), (1, 2, "Length", ["b", "a"], "e"), (2, 1, "DynamicCall", ["a"], "e"), (2, 2, "DynamicCall", ["c"], "f"), (3, 1, "Length", [], "e"), (3, 2, "Iteration", ["d"], "e"), (4, 1, None, ["d"], None)]
    out = classes.merged_groups(spark.createDataFrame(rows, "site long, place int, operation string, methods array<string>, external string"))
    assert "Expand" not in _plan(out)
    want = [(1, "Length", ["a", "b"], "e"), (2, "DynamicCall", ["a", "c"], None), (3, "DynamicProtocol", ["d"], "e"), (4, "DynamicCall", ["d"], None)]
    assert sorted(tuple(r) for r in out.collect()) == want
