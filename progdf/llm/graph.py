"""Connected components of a links table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): each node's least neighbour or itself; partial minima are made before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is the least node reachable.

    edges: rows of two long columns; self-links, repeats, nulls and either direction are allowed.
    Each round groups by node with mergeable minima and joins back, so a node with a great many links never
    becomes one list. Rounds grow with the logarithm of the number of nodes.
    """
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND lo < hi")
    now = saved(pairs.distinct(), "links")
    nodes = now.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    before = None
    for _ in range(most):
        state = tuple(now.agg(F.count("*"), F.sum("lo"), F.sum("hi"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = now.selectExpr("lo AS u", "hi AS v").unionByName(now.selectExpr("hi AS u", "lo AS v"))
        # large-star: greater neighbours move to the least neighbour
        large = both.join(_least(both), "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # small-star: lesser neighbours and the node itself move to the least of them
        down = large.selectExpr("hi AS u", "lo AS v")
        small = down.join(_least(down), "u").select(F.col("m").alias("lo"), F.explode(F.array("v", "u")).alias("hi")).where("lo < hi").distinct()
        new = saved(small, "links")
        forget(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    # every node is linked to its root now; roots stand for themselves
    return now.selectExpr("hi AS node", "lo AS component").unionByName(now.selectExpr("lo AS node", "lo AS component").distinct())


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of comp, as components() gives it, after further links (a, b).

    Only the links between components are followed, so rounds go over them and not over all earlier links again. Joins keep the
    table of many rows to a key on their left, where a hot key can be split.
    """
    side = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    pairs = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    roots = saved(components(pairs.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))), "roots")
    moved = comp.join(roots.toDF("component", "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return moved.unionByName(roots.join(comp.select(F.col("component").alias("node")).distinct(), "node", "left_anti"))
