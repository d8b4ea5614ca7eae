"""Post-dominance and control dependence of control-flow graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdf.functions.opcodes import outcome

from .graphs import adjacency, dominators


def _tree(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dominators of the reversed graph of blocks 0 to n - 1 from a synthetic exit n.

    The exit follows every block without successor and every block that reaches none.
    """
    ends = np.ones(n, bool)
    ends[src] = False
    first, before = adjacency(n, dst, src)
    safe, todo = ends.copy(), np.flatnonzero(ends).tolist()
    while todo:
        v = todo.pop()
        for w in before[first[v] : first[v + 1]]:
            if not safe[w]:
                safe[w] = True
                todo.append(w)
    exits = np.flatnonzero(ends | ~safe)
    return dominators(n + 1, n, np.concatenate([dst, np.full(len(exits), n)]), np.concatenate([src, exits]))


def post_dominance(blocks: DataFrame, cfg: DataFrame) -> DataFrame:
    """(code_id, block_id, ipdom, enter, leave): the post-dominator tree, whose root is the synthetic exit 0 and has no row.

    c post-dominates b if c's interval [enter, leave) holds b's enter. One code object takes memory by its blocks and edges.
    """
    edge = cfg.select("code_id", F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.lit(1).alias("edge"))
    node = blocks.select("code_id", F.col("block_id").cast("long").alias("a"), F.col("block_id").cast("long").alias("b"), F.lit(0).alias("edge"))

    def run(t):
        a, b, edge = (t[c].to_numpy() for c in ("a", "b", "edge"))
        order = np.lexsort((b, a))  # intervals of two evaluations are compared, so they must not depend on the order of rows
        a, b, edge = a[order], b[order], edge[order]
        n = int(max(a.max(), b.max()))
        idom, enter, leave = (x[:n] for x in _tree(n, a[edge == 1] - 1, b[edge == 1] - 1))
        return pa.table({"code_id": pa.array(np.full(n, t["code_id"][0].as_py(), np.int64)), "block_id": np.arange(1, n + 1), "ipdom": np.where(idom == n, 0, idom + 1), "enter": enter, "leave": leave})

    return edge.unionByName(node).groupBy("code_id").applyInArrow(run, "code_id long, block_id long, ipdom long, enter long, leave long")


def immediate(tree: DataFrame) -> DataFrame:
    """(code_id, block_id, ipdom): the nearest strict post-dominator; 0 is the exit."""
    return tree.select("code_id", "block_id", "ipdom")


def postdominates(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (code_id, pdom, block_id) rows with holds: does pdom post-dominate block_id? The exit does for every block."""
    low = tree.select("code_id", "block_id", F.col("enter").alias("_at"))
    high = tree.select("code_id", F.col("block_id").alias("pdom"), F.col("enter").alias("_from"), F.col("leave").alias("_to"))
    holds = (F.col("_at").isNotNull() & (F.col("pdom") == 0)) | ((F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to")))
    return wanted.join(low, ["code_id", "block_id"], "left").join(high, ["code_id", "pdom"], "left").withColumn("holds", F.coalesce(holds, F.lit(False))).drop("_at", "_from", "_to")


def postdominator_sets(tree: DataFrame) -> DataFrame:
    """(code_id, block_id, postdominators): sorted, itself included, without the exit."""
    high = tree.select(F.col("code_id").alias("code"), F.col("block_id").alias("pdom"), F.col("enter").alias("from"), F.col("leave").alias("to"))
    pairs = tree.join(high, F.expr("code_id = code AND enter >= from AND enter < to")).select("code_id", "block_id", "pdom")
    return pairs.groupBy("code_id", "block_id").agg(F.array_sort(F.collect_list("pdom")).alias("postdominators"))


def tree_violations(tree: DataFrame) -> DataFrame:
    """Blocks whose immediate post-dominator is missing, themselves or not above them in the tree."""
    high = tree.select("code_id", F.col("block_id").alias("ipdom"), F.col("enter").alias("_from"), F.col("leave").alias("_to"))
    x = tree.join(high, ["code_id", "ipdom"], "left")
    below = (F.col("_from") < F.col("enter")) & (F.col("leave") <= F.col("_to"))
    return x.where((F.coalesce("ipdom", F.lit(-1)) != 0) & ~F.coalesce(below, F.lit(False))).select("code_id", "block_id")


def control_dependence(cfg: DataFrame, tree: DataFrame) -> DataFrame:
    """(code_id, controller, dependent, outcome), each once.

    For an edge b -> t of a block with several successors whose target does not post-dominate it, the dependents are t and what
    is above it in the post-dominator tree, up to b's immediate post-dominator.
    """
    forks = cfg.groupBy("code_id", "src").agg(F.countDistinct("dst").alias("n")).where("n > 1").drop("n")
    edge = cfg.join(forks, ["code_id", "src"]).select("code_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), outcome(F.col("kind")).alias("outcome")).where("src <> dst").distinct()

    def run(edges, tree):
        above = dict(zip(tree["block_id"].to_pylist(), tree["ipdom"].to_pylist(), strict=True))
        rows, seen = [], {}
        for src, dst, how in zip(*(edges[c].to_pylist() for c in ("src", "dst", "outcome")), strict=True):
            done = seen.setdefault((src, how), set())
            while dst not in (0, above[src]) and dst not in done:
                done.add(dst)
                rows.append((src, dst, how))
                dst = above[dst]
        a, b, o = zip(*rows, strict=True) if rows else ((), (), ())
        code = edges["code_id"][0].as_py() if rows else 0
        return pa.table({"code_id": pa.array([code] * len(rows), pa.int64()), "controller": pa.array(a, pa.int64()), "dependent": pa.array(b, pa.int64()), "outcome": pa.array(o, pa.string())})

    return edge.groupBy("code_id").cogroup(tree.select("code_id", "block_id", "ipdom").groupBy("code_id")).applyInArrow(run, "code_id long, controller long, dependent long, outcome string")


def dependents(cdg: DataFrame) -> DataFrame:
    """(code_id, block_id, controllers, dependents): distinct and sorted."""
    none = F.array().cast("array<long>")
    out = cdg.groupBy("code_id", F.col("controller").alias("block_id")).agg(F.array_sort(F.collect_set("dependent")).alias("dependents"))
    into = cdg.groupBy("code_id", F.col("dependent").alias("block_id")).agg(F.array_sort(F.collect_set("controller")).alias("controllers"))
    return out.join(into, ["code_id", "block_id"], "full_outer").select("code_id", "block_id", F.coalesce("controllers", none).alias("controllers"), F.coalesce("dependents", none).alias("dependents"))


def has_edge(cdg: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (code_id, controller, dependent) rows with found."""
    known = cdg.select("code_id", "controller", "dependent").distinct().withColumn("found", F.lit(True))
    return wanted.join(known, ["code_id", "controller", "dependent"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
