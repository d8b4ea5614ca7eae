"""Small graphs are gone through at once, large ones by rounds, with the same rows."""

import random

from progdf.functions import scratch
from progdf.operators import reach


def test_small_and_large_graphs_have_the_same_rows(spark):
    rng = random.Random(5)
    edges = [(g, rng.randrange(9 + g), rng.randrange(9 + g)) for g in range(12) for _ in range(14 + g)] + [(None, 1, 2), (1, None, 2), (1, 2, None)]
    labels = lambda k: [(g, f"l{n % k}", n) for g in range(13) for n in range(9 + g)] + [(None, "x", 1), (3, "x", None), (3, None, 2)]
    e = spark.createDataFrame(edges, "graph long, src long, dst long")
    s, t = (spark.createDataFrame(labels(k), "graph long, label string, node long") for k in (3, 4))
    s = s.where("label IS NOT NULL")
    rows = lambda small: sorted(map(str, reach.reached(e, s, t, small=small).collect()))
    assert rows(0) == rows(45) == rows(10_000) and len(rows(0)) > 40


def test_rounds_of_small_graphs_write_no_tables(spark, monkeypatch):
    """A table for each round, before, of a way of 60 edges."""
    written = []
    write = lambda df, name="table": written.append(name) or scratch.saved(df, name)
    monkeypatch.setattr(reach, "saved", write)
    e = spark.range(60).selectExpr("7L AS graph", "id AS src", "id + 1 AS dst")
    ends = lambda n: spark.createDataFrame([(7, n, n)], "graph long, label long, node long")
    assert reach.reached(e, ends(0), ends(60)).collect() == [(7, 0, 60, 60)]
    assert len(written) == 2
