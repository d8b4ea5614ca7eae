"""Control-flow and control-dependence queries over encoded programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progdf.functions.scratch import saved
from progdf.operators import cdg, cfg

from . import encodings as X


def _placed(spark: SparkSession, d: str, with_regions: bool = False, endless: bool = False):
    instr = X.instructions(spark, d, endless)
    regions = X.regions(instr) if with_regions else None
    placed = cfg.with_blocks(instr, regions)
    return placed, cfg.edges(placed, regions), regions


def cfg_branch_fanout(spark, d) -> DataFrame:
    """Blocks, edges and branching blocks of each program."""
    placed, edges, _ = _placed(spark, d)
    out = edges.groupBy("code_id", "src").agg(F.count("*").alias("k"))
    per = out.groupBy("code_id").agg(F.sum("k").alias("n_edges"), F.count(F.when(F.col("k") > 1, 1)).alias("n_branching"))
    return placed.groupBy("code_id").agg(F.max("block_id").alias("n_blocks")).join(per, "code_id", "left").select("code_id", "n_blocks", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_branching", F.lit(0)).alias("n_branching"))


def program_violations(spark, d) -> DataFrame:
    """Faults planted by taking instructions out: jumps to nowhere, by problem."""
    instr = X.instructions(spark, d).where("idx % 7 <> 3 OR idx = n - 1")
    return cfg.violations(instr).groupBy("problem").agg(F.count("*").alias("n"))


def cfg_leaders(spark, d):
    instr = X.instructions(spark, d)
    return cfg.leaders(instr, X.regions(instr))


def cfg_blocks(spark, d):
    return cfg.blocks(_placed(spark, d, True)[0])


def cfg_edges(spark, d):
    return _placed(spark, d)[1].select("code_id", "src", "dst", "kind")


def cfg_edges_exceptions(spark, d):
    return _placed(spark, d, True)[1].select("code_id", "src", "dst", "kind", "exc_items")


def cfg_graph_violations(spark, d):
    placed, edges, _ = _placed(spark, d, True)
    return cfg.graph_violations(placed, edges)


def cfg_neighbours(spark, d):
    n = cfg.neighbours(_placed(spark, d)[1])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return n.select("code_id", "block_id", text("predecessors").alias("predecessors"), text("successors").alias("successors"))


def cfg_block_lookup(spark, d):
    """Blocks at every fifth offset, odd ones included."""
    placed, _, _ = _placed(spark, d)
    wanted = placed.where("idx % 5 = 0").select("code_id", F.explode(F.array(F.col("off"), F.col("off") + 1)).alias("off"))
    return cfg.block_at_offset(placed, wanted).na.fill(0, ["block_id"])  # 0: no instruction starts there


def cfg_instruction_lookup(spark, d):
    placed, _, _ = _placed(spark, d)
    return cfg.block_for_instruction(placed, placed.where("idx % 4 = 1").select("code_id", (F.col("idx") + 2).alias("idx"))).na.fill(0, ["block_id"])


def cfg_outgoing(spark, d):
    _, edges, _ = _placed(spark, d, True)
    return cfg.outgoing(edges, edges.where("dst % 3 = 0").select("code_id", F.col("dst").alias("block_id")).distinct()).select("code_id", "src", "dst", "kind")


def cfg_refined(spark, d):
    """Exception edges that stay after definite assignment, all locals unassigned at the start but v0."""
    placed, edges, _ = _placed(spark, d, True)
    params = placed.select("code_id").distinct().withColumn("symbol", F.lit("v0"))
    return cfg.refined(placed, edges, params).select("code_id", "src", "dst", "kind")


def cfg_reach_counts(spark, d):
    return cfg.reach_counts(_placed(spark, d)[1])


def cfg_cyclic_blocks(spark, d):
    return cfg.cyclic_blocks(_placed(spark, d)[1])


def cfg_reaches(spark, d):
    """For every block: does it reach the block after it, and does that reach it?"""
    placed, edges, _ = _placed(spark, d)
    b = cfg.blocks(placed).select("code_id", F.col("block_id").cast("long").alias("src"), (F.col("block_id") + 1).cast("long").alias("dst"))
    return cfg.reaches(edges, b.unionByName(b.select("code_id", F.col("dst").alias("src"), F.col("src").alias("dst"))))


def kept(spark, d, with_regions=False, endless=False):
    """(placed, edges), each written once, for what reads them several times."""
    instr = X.instructions(spark, d, endless)
    regions = X.regions(instr) if with_regions else None
    placed = saved(cfg.with_blocks(instr, regions), "placed")
    return placed, saved(cfg.edges(placed, regions), "edges")


def _pdom(spark, d, with_regions=False, endless=False):
    placed, edges = kept(spark, d, with_regions, endless)
    return edges, cdg.post_dominance(cfg.blocks(placed), edges)


def cdg_ipdom(spark, d):
    return cdg.immediate(_pdom(spark, d)[1])


def cdg_ipdom_endless(spark, d):
    """Immediate post-dominators where some loops never end."""
    return cdg.immediate(_pdom(spark, d, endless=True)[1])


def cdg_postdominators(spark, d):
    p = cdg.postdominator_sets(_pdom(spark, d)[1])
    return p.select("code_id", "block_id", F.array_join(F.col("postdominators").cast("array<string>"), ",").alias("postdominators"))


def cdg_postdominates(spark, d):
    """Does each edge's target post-dominate its source?"""
    edges, pdom = _pdom(spark, d)
    wanted = edges.select("code_id", F.col("dst").cast("long").alias("pdom"), F.col("src").cast("long").alias("block_id")).distinct()
    return cdg.postdominates(pdom, wanted).groupBy("code_id").agg(F.count(F.when(F.col("holds"), 1)).alias("n_hold"), F.count("*").alias("n"))


def cdg_tree_violations(spark, d):
    return cdg.tree_violations(_pdom(spark, d, endless=True)[1])


def cdg_edges(spark, d):
    return cdg.control_dependence(*_pdom(spark, d))


def cdg_edges_exceptions(spark, d):
    return cdg.control_dependence(*_pdom(spark, d, True))


def cdg_edges_endless(spark, d):
    return cdg.control_dependence(*_pdom(spark, d, endless=True))


def cdg_neighbours(spark, d):
    n = cdg.dependents(cdg.control_dependence(*_pdom(spark, d)))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return n.select("code_id", "block_id", text("controllers").alias("controllers"), text("dependents").alias("dependents"))


def cdg_has_edge(spark, d):
    """For every block and the one after it: does it control that?"""
    placed, edges, _ = _placed(spark, d)
    c = cdg.control_dependence(edges, cdg.post_dominance(cfg.blocks(placed), edges))
    return cdg.has_edge(c, cfg.blocks(placed).select("code_id", F.col("block_id").alias("controller"), (F.col("block_id") + 1).alias("dependent")))


QUERIES = {f.__name__: f for f in (
    cfg_branch_fanout, program_violations, cfg_leaders, cfg_blocks, cfg_edges, cfg_edges_exceptions, cfg_graph_violations, cfg_neighbours, cfg_block_lookup, cfg_instruction_lookup,
    cfg_outgoing, cfg_refined, cfg_reach_counts, cfg_cyclic_blocks, cfg_reaches, cdg_ipdom, cdg_ipdom_endless, cdg_postdominators, cdg_postdominates, cdg_tree_violations, cdg_edges,
    cdg_edges_exceptions, cdg_edges_endless, cdg_neighbours, cdg_has_edge,
)}

PLAIN, CAUGHT, ENDLESS = X.cfg_sql(), X.cfg_sql(True), X.cfg_sql(False, True)
_R = "WITH RECURSIVE "
ORACLES = {
    "cfg_branch_fanout": f"""WITH {PLAIN} SELECT b.code_id, b.n_blocks, coalesce(n_edges, 0)::BIGINT AS n_edges, coalesce(n_branching, 0) AS n_branching
FROM (SELECT code_id, max(block_id) AS n_blocks FROM placed GROUP BY code_id) b LEFT JOIN (SELECT code_id, sum(k) AS n_edges, count(*) FILTER (WHERE k > 1) AS n_branching
FROM (SELECT code_id, src, count(*) AS k FROM edges GROUP BY code_id, src) GROUP BY code_id) e USING (code_id)""",
    "program_violations": f"""WITH {X.instructions_sql()}, thin AS (SELECT * FROM instr WHERE idx % 7 <> 3 OR idx = n - 1)
SELECT 'jump target is no instruction' AS problem, count(*) AS n FROM thin t WHERE jump_target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM thin x WHERE x.code_id = t.code_id AND x.off = t.jump_target) HAVING count(*) > 0""",
    "cfg_leaders": f"WITH {CAUGHT} SELECT code_id, idx FROM leads",
    "cfg_blocks": f"WITH {CAUGHT} SELECT * FROM blocks",
    "cfg_edges": f"WITH {PLAIN} SELECT code_id, src, dst, kind FROM edges",
    "cfg_edges_exceptions": f"WITH {CAUGHT} SELECT code_id, src, dst, kind, exc_items FROM edges",
    "cfg_graph_violations": f"WITH {CAUGHT} SELECT code_id, 'block ids are not 1 to n' AS problem FROM placed GROUP BY code_id HAVING count(DISTINCT block_id) <> max(block_id)",
    "cfg_neighbours": f"""WITH {PLAIN}, o AS (SELECT code_id, src AS block_id, string_agg(dst, ',' ORDER BY dst) AS s FROM edges GROUP BY ALL), i AS (SELECT code_id, dst AS block_id, string_agg(src, ',' ORDER BY src) AS p FROM edges GROUP BY ALL)
SELECT code_id, block_id, coalesce(p, '') AS predecessors, coalesce(s, '') AS successors FROM o FULL JOIN i USING (code_id, block_id)""",
    "cfg_block_lookup": f"""WITH {PLAIN}, w AS (SELECT code_id, off FROM instr WHERE idx % 5 = 0 UNION ALL SELECT code_id, off + 1 FROM instr WHERE idx % 5 = 0) SELECT w.code_id, w.off, coalesce(p.block_id, 0) AS block_id FROM w LEFT JOIN placed p ON p.code_id = w.code_id AND p.off = w.off""",
    "cfg_instruction_lookup": f"""WITH {PLAIN} SELECT w.code_id, w.idx + 2 AS idx, coalesce(p.block_id, 0) AS block_id FROM instr w LEFT JOIN placed p ON p.code_id = w.code_id AND p.idx = w.idx + 2 WHERE w.idx % 4 = 1""",
    "cfg_outgoing": f"""WITH {CAUGHT} SELECT code_id, src, dst, kind FROM edges e WHERE src % 3 = 0 AND EXISTS (SELECT 1 FROM edges x WHERE x.code_id = e.code_id AND x.dst = e.src)""",
    # a local may be unassigned where some path comes without a store: reachability over instructions, entry or unreached blocks first
    "cfg_refined": f"""{_R}{CAUGHT}, nm AS (SELECT DISTINCT code_id, symbol FROM instr WHERE opcode IN ('LoadLocal', 'StoreLocal')), una AS (
  SELECT b.code_id, b.block_id, nm.symbol FROM blocks b JOIN nm USING (code_id) WHERE (b.block_id = 1 AND nm.symbol <> 'v0') OR (b.block_id <> 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.code_id = b.code_id AND e.dst = b.block_id))
  UNION SELECT u.code_id, e.dst, u.symbol FROM una u JOIN edges e ON e.code_id = u.code_id AND e.src = u.block_id AND e.dst <> 1
  WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.code_id = u.code_id AND p.block_id = u.block_id AND p.opcode = 'StoreLocal' AND p.symbol = u.symbol)
)
SELECT e.code_id, e.src, e.dst, e.kind FROM edges e JOIN placed l ON l.code_id = e.code_id AND l.block_id = e.src AND l.is_last WHERE e.kind <> 'Exception' OR l.opcode <> 'LoadLocal'
  OR (EXISTS (SELECT 1 FROM una u WHERE u.code_id = e.code_id AND u.block_id = e.src AND u.symbol = l.symbol)
    AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.code_id = e.code_id AND p.block_id = e.src AND p.opcode = 'StoreLocal' AND p.symbol = l.symbol))""",
    "cfg_reach_counts": f"{_R}{PLAIN}{X.REACH_SQL} SELECT code_id, src, count(*) AS n_reached FROM reach GROUP BY code_id, src",
    "cfg_cyclic_blocks": f"{_R}{PLAIN}{X.REACH_SQL} SELECT code_id, src AS block_id FROM reach WHERE src = dst",
    "cfg_reaches": f"""{_R}{PLAIN}{X.REACH_SQL}, w AS (SELECT code_id, block_id AS src, block_id + 1 AS dst FROM blocks UNION SELECT code_id, block_id + 1, block_id FROM blocks)
SELECT w.code_id, w.src, w.dst, r.src IS NOT NULL AS holds FROM w LEFT JOIN reach r ON r.code_id = w.code_id AND r.src = w.src AND r.dst = w.dst""",
    "cdg_ipdom": f"{_R}{PLAIN}{X.PDOM_SQL} SELECT * FROM ipdom",
    "cdg_ipdom_endless": f"{_R}{ENDLESS}{X.PDOM_SQL} SELECT * FROM ipdom",
    "cdg_postdominators": f"{_R}{PLAIN}{X.PDOM_SQL} SELECT code_id, block_id, string_agg(pdom, ',' ORDER BY pdom) AS postdominators FROM pdom WHERE pdom <> 0 GROUP BY code_id, block_id",
    "cdg_postdominates": f"""{_R}{PLAIN}{X.PDOM_SQL} SELECT s.code_id, count(p.pdom) AS n_hold, count(*) AS n FROM step s LEFT JOIN pdom p ON p.code_id = s.code_id AND p.block_id = s.src AND p.pdom = s.dst GROUP BY s.code_id""",
    "cdg_tree_violations": f"{_R}{ENDLESS}{X.PDOM_SQL} SELECT i.code_id, i.block_id FROM ipdom i JOIN pdom p ON p.code_id = i.code_id AND p.block_id = i.ipdom AND p.pdom = i.block_id",
    "cdg_edges": f"{_R}{PLAIN}{X.CDG_SQL} SELECT * FROM cdg",
    "cdg_edges_exceptions": f"{_R}{CAUGHT}{X.CDG_SQL} SELECT * FROM cdg",
    "cdg_edges_endless": f"{_R}{ENDLESS}{X.CDG_SQL} SELECT * FROM cdg",
    "cdg_neighbours": f"""{_R}{PLAIN}{X.CDG_SQL}, o AS (SELECT code_id, controller AS block_id, string_agg(DISTINCT dependent, ',' ORDER BY dependent) AS d FROM cdg GROUP BY ALL), i AS (SELECT code_id, dependent AS block_id, string_agg(DISTINCT controller, ',' ORDER BY controller) AS c FROM cdg GROUP BY ALL)
SELECT code_id, block_id, coalesce(c, '') AS controllers, coalesce(d, '') AS dependents FROM o FULL JOIN i USING (code_id, block_id)""",
    "cdg_has_edge": f"""{_R}{PLAIN}{X.CDG_SQL} SELECT b.code_id, b.block_id AS controller, b.block_id + 1 AS dependent, EXISTS (SELECT 1 FROM cdg c WHERE c.code_id = b.code_id AND c.controller = b.block_id AND c.dependent = b.block_id + 1) AS found FROM blocks b""",
}
