"""Members by levels are those by rounds; circles go by rounds."""

import random

from progdf.functions.scratch import Grown
from progdf.operators import callgraph


def _rows(df):
    return sorted((r["class"], r["name"], r["owner"]) for r in df.collect())


def test_levels_give_the_members_of_rounds(spark, monkeypatch):
    rng = random.Random(3)
    bases = [(c, b, place) for c in range(1, 30) for place, b in enumerate(rng.sample(range(c), min(c, rng.randint(0, 3))))] + [(5, 5, 9), (None, 1, 0), (7, None, 8)]
    own = [(c, f"m{rng.randrange(9)}") for c in range(30) for _ in range(2)] + [(99, "alone")]
    classes, own = spark.createDataFrame([b for b in bases if b[0] is not None], "class long, base long, place int"), spark.createDataFrame(own, "class long, name string")
    want = _rows(callgraph._inherited_by_rounds(classes, own))
    read, times = Grown.read, []
    monkeypatch.setattr(Grown, "read", lambda self: times.append(self.name) or read(self))
    assert _rows(callgraph.inherited(classes, own)) == want and len(want) > 100
    assert times.count("members") == 1  # what was found before is not read in every round


def test_circles_end(spark):
    classes = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 1, 0), (4, 4, 0)], "class long, base long, place int")
    own = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "class long, name string")
    assert _rows(callgraph.inherited(classes, own)) == [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2), (3, "a", 1), (3, "b", 2), (4, "d", 4)]
