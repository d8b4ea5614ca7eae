"""Facts of receivers come from their classes, not from pairs of receivers and functions."""

from progdf.operators import classes


def test_functions_of_a_class_are_looked_at_once(spark):
    made = lambda schema, rows: spark.createDataFrame(rows, schema).coalesce(1)
    pointed = made("object long, class long", [(o, c) for o in range(300) for c in ((0, 1) if o % 3 == 0 else (o % 2,))])
    fields = made("class long, method string, function long", [(f % 2, f"m{f % 4}", f) for f in range(400)])
    methods = made("function long, may_defer boolean", [(f, f % 4 == 1) for f in range(400) if f != 7])
    out = classes.receiver_facts(pointed, fields, methods)
    want = {(o, f"m{m}", True, m in (1, 3)) for o in range(300) for m in range(4) if o % 3 == 0 or m % 2 == o % 2}
    assert set(map(tuple, out.collect())) == want
    # the plan groups functions by class and method below the join with receivers
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") >= 2
