"""Queries of labelled reachability over control dependence, data dependence and control flow of encoded programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from progdf.functions.scratch import saved
from progdf.operators import cfg, reach

from . import flow_queries, package_queries


def cdg_reached(spark, d):
    """Which groups of blocks, by number modulo 3, control which, by number modulo 4, directly or not."""
    e = flow_queries.cdg_edges(spark, d).select(F.col("code_id").alias("graph"), F.col("controller").alias("src"), F.col("dependent").alias("dst"))
    e = saved(e, "dependence")  # edges and both kinds of labels are made of it
    nodes = e.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
    group = lambda k: nodes.select("graph", (F.col("node") % k).alias("label"), "node")
    return reach.reached(e, group(3), group(4)).select(F.col("graph").alias("code_id"), "source", "target")


def ddg_reached(spark, d):
    """Which inputs of a program reach what it returns, its calls and its branches."""
    e = package_queries.ddg_edges(spark, d).select(F.col("code_id").alias("graph"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind")
    targets = e.where("kind IN ('ReturnValue', 'Callee', 'Operand')").select("graph", F.col("kind").alias("label"), F.col("dst").alias("node"))
    sources = e.where("src LIKE 'input %'").select("graph", F.col("src").alias("label"), F.col("src").alias("node"))
    return reach.reached(e, sources, targets).select(F.col("graph").alias("code_id"), "source", "target")


def cfg_paths_hold(spark, d):
    """Ways through blocks: the first, the middle and the last one, and the last, the first and the second one."""
    placed, edges = flow_queries.kept(spark, d)
    n = cfg.blocks(placed).groupBy("code_id").agg(F.max("block_id").cast("long").alias("n"))
    one = F.lit(1).cast("long")
    ways = n.select("code_id", F.explode(F.array(F.struct(F.lit("down").alias("path"), F.array(one, F.expr("n div 2 + 1"), "n").alias("nodes")), F.struct(F.lit("back").alias("path"), F.array(F.col("n"), one, F.least(F.lit(2).cast("long"), "n")).alias("nodes")))).alias("w"))
    paths = ways.select(F.col("code_id").alias("graph"), "w.path", F.posexplode("w.nodes").alias("place", "node"))
    e = edges.select(F.col("code_id").alias("graph"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return reach.paths_hold(e, paths).select(F.col("graph").alias("code_id"), "path", "holds", F.coalesce("missing", F.lit(-1)).alias("missing"))


QUERIES = {f.__name__: f for f in (cdg_reached, ddg_reached, cfg_paths_hold)}

_WALK = """walk AS (SELECT s.graph, s.label, e.dst AS node FROM sources s JOIN e ON e.graph = s.graph AND e.src = s.node UNION SELECT w.graph, w.label, e.dst FROM walk w JOIN e ON e.graph = w.graph AND e.src = w.node)"""
ORACLES = {
    "cdg_reached": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT code_id AS graph, controller AS src, dependent AS dst FROM ({flow_queries.ORACLES["cdg_edges"]})),
nodes AS (SELECT graph, src AS node FROM e UNION SELECT graph, dst FROM e), sources AS (SELECT graph, node % 3 AS label, node FROM nodes), {_WALK}
SELECT DISTINCT graph AS code_id, label AS source, node % 4 AS target FROM walk""",
    "ddg_reached": f"""WITH RECURSIVE k AS MATERIALIZED (SELECT code_id AS graph, src::VARCHAR AS src, dst::VARCHAR AS dst, kind FROM ({package_queries.ORACLES["ddg_edges"]})), e AS MATERIALIZED (SELECT DISTINCT graph, src, dst FROM k),
sources AS (SELECT DISTINCT graph, src AS label, src AS node FROM e WHERE src LIKE 'input %'), {_WALK}
SELECT DISTINCT w.graph AS code_id, w.label AS source, k.kind AS target FROM walk w JOIN k ON k.graph = w.graph AND k.dst = w.node AND k.kind IN ('ReturnValue', 'Callee', 'Operand')""",
    "cfg_paths_hold": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT code_id AS graph, src, dst FROM ({flow_queries.ORACLES["cfg_edges"]})),
n AS (SELECT code_id AS graph, max(block_id)::BIGINT AS n FROM (WITH {flow_queries.PLAIN} SELECT code_id, block_id FROM blocks) GROUP BY 1),
legs AS (SELECT graph, 'down' AS path, 1 AS place, 1 AS label, n // 2 + 1 AS node FROM n UNION ALL SELECT graph, 'down', 2, n // 2 + 1, n FROM n UNION ALL SELECT graph, 'back', 1, n, 1 FROM n UNION ALL SELECT graph, 'back', 2, 1, least(2, n) FROM n),
sources AS (SELECT DISTINCT graph, label, label AS node FROM legs), {_WALK}
SELECT graph AS code_id, path, count(*) FILTER (WHERE w IS NULL) = 0 AS holds, coalesce(min(place) FILTER (WHERE w IS NULL), -1) AS missing
FROM (SELECT l.*, w.graph AS w FROM legs l LEFT JOIN walk w ON w.graph = l.graph AND w.label = l.label AND w.node = l.node) GROUP BY 1, 2""",
}
