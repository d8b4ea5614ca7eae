"""Which candidates reach which: small graphs at once, each by itself, large ones by frontiers of (source label, node) pairs, and checks of whole paths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from progdf.functions.scratch import Grown, saved

from .graphs import labels_reached

#: Most rows of edges, sources and targets of a graph that one task looks at as a whole.
SMALL = 4096


def reached(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = 10_000, small: int = SMALL) -> DataFrame:
    """(graph, source, target, steps): labels whose nodes have a path of an edge or more between them, and the fewest edges of one.

    edges (graph, src, dst); sources, targets (graph, label, node), where a label may have several nodes. A node without edges reaches
    nothing; null graphs and nodes take no part. Every round follows one edge from the pairs of label and node found in the round before, so a
    pair is looked at once however many paths lead to it, and cycles end. Graphs of at most `small` rows go through all their rounds in one
    task each; the rounds of larger ones are joins over all of them.
    """
    step = edges.select("graph", F.col("src").alias("node"), F.col("dst").alias("next")).where("graph IS NOT NULL AND node IS NOT NULL AND next IS NOT NULL")
    start = sources.select("graph", F.col("label").alias("source"), "node").where("graph IS NOT NULL AND node IS NOT NULL")
    end = targets.select("graph", F.col("label").alias("target"), "node").where("graph IS NOT NULL AND node IS NOT NULL")
    rows = saved(step.unionByName(start, allowMissingColumns=True).unionByName(end.withColumn("end", F.lit(True)), allowMissingColumns=True), "labelled")
    large = saved(rows.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > small).select("graph"), "large")
    some = not large.isEmpty()
    at_once = _at_once(rows.join(large, "graph", "left_anti") if some else rows, most)
    return at_once.unionByName(_by_rounds(rows.join(large, "graph", "left_semi"), most)) if some else at_once


def _at_once(rows: DataFrame, most: int) -> DataFrame:
    """reached() of graphs that are small, a graph at a time."""
    kind = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([*(StructField(c, kind[c]) for c in ("graph", "source", "target")), StructField("steps", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(t):
        after, start, end = {}, [], {}
        for node, next_, source, target, is_end in zip(*(t[c].to_pylist() for c in ("node", "next", "source", "target", "end")), strict=True):
            if next_ is not None:
                after.setdefault(node, []).append(next_)
            elif is_end:
                end.setdefault(node, []).append(target)
            else:
                start.append((source, node))
        source, target, steps = labels_reached(after, start, end, most)
        graph = pa.array(t["graph"].to_pylist()[:1] * len(steps), arrow.field(0).type)
        return pa.Table.from_arrays([graph, *(pa.array(x, arrow.field(k).type) for k, x in ((1, source), (2, target), (3, steps)))], arrow.names)

    return rows.groupBy("graph").applyInArrow(run, schema)


def _by_rounds(rows: DataFrame, most: int) -> DataFrame:
    """reached() of graphs that are large, a round over all of them at a time."""
    step = saved(rows.where("next IS NOT NULL").select("graph", "node", "next").distinct(), "steps")
    now = rows.where("next IS NULL AND end IS NULL").select("graph", F.col("source").alias("label"), "node").distinct()
    found = None
    for steps in range(1, most + 1):
        new = now.join(step, ["graph", "node"]).select("graph", "label", F.col("next").alias("node")).distinct()
        if found is not None:
            new = new.join(found.read(), ["graph", "label", "node"], "left_anti")
        new = saved(new.withColumn("steps", F.lit(steps)), "reached")
        if found is None:
            found = Grown(new, "reached")
        elif new.isEmpty():
            break
        else:
            found.add(new)
        now = new.select("graph", "label", "node")
    else:
        raise RuntimeError(f"paths of more than {most} edges")
    hit = found.read().withColumnRenamed("label", "source").join(rows.where("end").select("graph", "node", "target").distinct(), ["graph", "node"])
    return hit.groupBy("graph", "source", "target").agg(F.min("steps").alias("steps"))


def paths_hold(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(graph, path, holds, missing): is there a way through all nodes of a path (graph, path, place, node) in their order? missing: the first place that can't be reached from the one before, null if none.

    A path of one node holds. Nodes are places of one path each time they come, so a path may pass a node twice.
    """
    paths = saved(paths.select("graph", "path", "place", "node"), "paths")
    after = paths.select("graph", "path", (F.col("place") + 1).alias("place"), F.col("node").alias("before"))
    legs = saved(paths.join(after, ["graph", "path", "place"]).select("graph", "path", "place", "before", "node"), "legs")
    ways = reached(edges, legs.select("graph", F.col("before").alias("label"), F.col("before").alias("node")), legs.select("graph", F.col("node").alias("label"), "node"))
    ways = ways.select("graph", F.col("source").alias("before"), F.col("target").alias("node"), F.lit(True).alias("there"))
    bad = legs.join(ways, ["graph", "before", "node"], "left").where("there IS NULL").groupBy("graph", "path").agg(F.min("place").alias("missing"))
    return paths.select("graph", "path").distinct().join(bad, ["graph", "path"], "left").select("graph", "path", F.col("missing").isNull().alias("holds"), "missing")
