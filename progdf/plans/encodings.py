"""Program relations encoded from ordinary tables, so that the operators can be checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instructions(spark: SparkSession, sf_dir: str, endless: bool = False) -> DataFrame:
    """Each user's events as a program: the event's type is the operation, its number k the symbol and the jump distance.

    endless: some unconditional jumps go back, so that not every block reaches an end.
    """
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(F.col("user_id").alias("code_id"), (F.row_number().over(w) - 1).alias("idx"), "event_type", k.alias("k"), F.count("*").over(Window.partitionBy("user_id")).cast("int").alias("n"))
    op = (
        F.when(F.col("idx") == F.col("n") - 1, "Return").when(F.col("event_type") == "view", "LoadLocal").when(F.col("event_type") == "click", "StoreLocal")
        .when(F.col("event_type") == "signup", "LoadConst").when(F.col("event_type") == "error", "Branch").otherwise("ConditionalBranch")
    )
    back, ahead = F.greatest(F.lit(0), F.col("idx") - F.col("k") % 9), F.least(F.col("n") - 1, F.col("idx") + 1 + F.col("k") % 9)
    jump = F.when(op == "ConditionalBranch", F.when(F.col("k") % 5 == 0, back).otherwise(ahead)).when(op == "Branch", F.when((F.col("k") % 11 == 0) & F.lit(endless), back).otherwise(ahead))
    return e.select("code_id", "idx", (F.col("idx") * 2).alias("off"), op.alias("opcode"), F.concat(F.lit("v"), F.col("k") % 4).alias("symbol"), (jump * 2).alias("jump_target"), F.when(op == "ConditionalBranch", F.col("k") % 2 == 0).alias("jump_on_true"), "k", "n")


def regions(instr: DataFrame) -> DataFrame:
    """One exception region for each code of 8 or more instructions: its second quarter, handled by the last but one."""
    n = instr.groupBy("code_id").agg(F.max("n").alias("n")).where("n >= 8")
    return n.selectExpr("code_id", "2 * (n DIV 4) AS start_off", "2 * (n DIV 2) AS end_off", "2 * (n - 2) AS handler_off", "0 AS stack_depth", "1 AS exc_items", "false AS push_lasti").selectExpr("code_id", *[f"CAST({c} AS INT) {c}" for c in ("start_off", "end_off", "handler_off", "stack_depth", "exc_items")], "push_lasti")


def instructions_sql(endless: bool = False) -> str:
    return f"""
ev AS (
  SELECT user_id AS code_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CAST(count(*) OVER (PARTITION BY user_id) AS INT) AS n FROM events
), ops AS (
  SELECT *, CASE WHEN idx = n - 1 THEN 'Return' WHEN event_type = 'view' THEN 'LoadLocal' WHEN event_type = 'click' THEN 'StoreLocal' WHEN event_type = 'signup' THEN 'LoadConst'
    WHEN event_type = 'error' THEN 'Branch' ELSE 'ConditionalBranch' END AS opcode FROM ev
), instr AS (
  SELECT code_id, idx, idx * 2 AS off, opcode, 'v' || (k % 4) AS symbol, k, n,
    2 * CASE WHEN opcode = 'ConditionalBranch' AND k % 5 = 0 OR opcode = 'Branch' AND k % 11 = 0 AND {endless} THEN greatest(0, idx - k % 9)
      WHEN opcode IN ('Branch', 'ConditionalBranch') THEN least(n - 1, idx + 1 + k % 9) END AS jump_target, CASE WHEN opcode = 'ConditionalBranch' THEN k % 2 = 0 END AS jump_on_true
  FROM ops
), regions AS (
  SELECT code_id, 2 * (max(n) // 4) AS start_off, 2 * (max(n) // 2) AS end_off, 2 * (max(n) - 2) AS handler_off FROM instr GROUP BY code_id HAVING max(n) >= 8
)"""


def cfg_sql(with_regions: bool = False, endless: bool = False) -> str:
    """CTEs up to placed (instructions with block_id and is_last), blocks and edges."""
    region_leaders = """
  UNION SELECT i.code_id, i.idx FROM instr i JOIN regions r ON i.code_id = r.code_id AND i.off IN (r.start_off, r.end_off, r.handler_off)
  UNION SELECT i.code_id, i.idx + 1 FROM instr i JOIN regions r ON i.code_id = r.code_id AND i.off >= r.start_off AND i.off < r.end_off WHERE i.opcode NOT IN ('LoadConst', 'Branch', 'Return') AND i.idx < i.n - 1"""
    region_edges = """
  UNION SELECT p.code_id, p.block_id, h.block_id, 'Exception', 1 FROM placed p JOIN regions r ON p.code_id = r.code_id AND p.off >= r.start_off AND p.off < r.end_off
    JOIN placed h ON h.code_id = r.code_id AND h.off = r.handler_off WHERE p.is_last AND p.opcode NOT IN ('LoadConst', 'Branch', 'Return')"""
    return (
        instructions_sql(endless)
        + f""", leads AS (
  SELECT code_id, 0 AS idx FROM instr WHERE idx = 0
  UNION SELECT code_id, jump_target // 2 FROM instr WHERE jump_target IS NOT NULL
  UNION SELECT code_id, idx + 1 FROM instr WHERE opcode IN ('Branch', 'ConditionalBranch', 'Return') AND idx < n - 1{region_leaders if with_regions else ""}
), placed AS (
  SELECT i.*, count(l.idx) OVER (PARTITION BY i.code_id ORDER BY i.idx) AS block_id, coalesce(lead(l.idx) OVER (PARTITION BY i.code_id ORDER BY i.idx) IS NOT NULL, true) OR i.idx = n - 1 AS is_last
  FROM instr i LEFT JOIN leads l ON l.code_id = i.code_id AND l.idx = i.idx
), blocks AS (
  SELECT code_id, block_id, min(off) AS start_off, min(idx) AS first_idx, max(idx) AS last_idx FROM placed GROUP BY code_id, block_id
), edges AS (
  SELECT p.code_id, p.block_id AS src, t.block_id AS dst, CASE WHEN p.opcode = 'Branch' THEN 'Jump' WHEN p.jump_on_true THEN 'BranchTrue' ELSE 'BranchFalse' END AS kind, 0 AS exc_items
  FROM placed p JOIN placed t ON t.code_id = p.code_id AND t.off = p.jump_target WHERE p.is_last AND p.jump_target IS NOT NULL
  UNION SELECT code_id, block_id, block_id + 1, CASE WHEN opcode <> 'ConditionalBranch' THEN 'Fallthrough' WHEN jump_on_true THEN 'BranchFalse' ELSE 'BranchTrue' END, 0
  FROM placed WHERE is_last AND idx < n - 1 AND opcode NOT IN ('Branch', 'Return'){region_edges if with_regions else ""}
)"""
    )


#: CTEs after cfg_sql: reach (pairs with a path of an edge or more) and pdom (with 0 for the exit), by reachability without a block.
REACH_SQL = """, step AS (SELECT DISTINCT code_id, src, dst FROM edges), reach AS (
  SELECT code_id, src, dst FROM step UNION SELECT r.code_id, r.src, s.dst FROM reach r JOIN step s ON s.code_id = r.code_id AND s.src = r.dst
)"""
PDOM_SQL = (
    REACH_SQL
    + """, ends AS (
  SELECT code_id, block_id FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM step s WHERE s.code_id = b.code_id AND s.src = b.block_id)
), exits AS (
  SELECT * FROM ends UNION SELECT code_id, block_id FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.code_id = b.code_id AND (e.block_id = b.block_id
    OR EXISTS (SELECT 1 FROM reach r WHERE r.code_id = b.code_id AND r.src = b.block_id AND r.dst = e.block_id)))
), avoid AS (
  SELECT b.code_id, x.block_id AS without, e.block_id AS node FROM exits e JOIN blocks b ON b.code_id = e.code_id AND b.block_id = e.block_id JOIN blocks x ON x.code_id = e.code_id AND x.block_id <> e.block_id
  UNION SELECT a.code_id, a.without, s.src FROM avoid a JOIN step s ON s.code_id = a.code_id AND s.dst = a.node AND s.src <> a.without
), pdom AS (
  SELECT b.code_id, b.block_id, c.block_id AS pdom FROM blocks b JOIN blocks c ON c.code_id = b.code_id
  WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.code_id = b.code_id AND a.without = c.block_id AND a.node = b.block_id)
  UNION ALL SELECT code_id, block_id, 0 FROM blocks
), height AS (SELECT code_id, block_id, count(*) AS h FROM pdom GROUP BY code_id, block_id
), ipdom AS (
  SELECT p.code_id, p.block_id, max_by(p.pdom, coalesce(h.h, 0)) AS ipdom FROM pdom p LEFT JOIN height h ON h.code_id = p.code_id AND h.block_id = p.pdom WHERE p.pdom <> p.block_id GROUP BY p.code_id, p.block_id
)"""
)
CDG_SQL = (
    PDOM_SQL
    + """, forks AS (SELECT code_id, src FROM edges GROUP BY code_id, src HAVING count(DISTINCT dst) > 1), cdg AS (
  SELECT DISTINCT e.code_id, e.src AS controller, d.pdom AS dependent, CASE e.kind WHEN 'BranchTrue' THEN 'True' WHEN 'BranchFalse' THEN 'False' WHEN 'Exception' THEN 'Exception' WHEN 'Resume' THEN 'Resume' ELSE 'Normal' END AS outcome
  FROM edges e JOIN forks USING (code_id, src) JOIN pdom d ON d.code_id = e.code_id AND d.block_id = e.dst AND d.pdom <> 0
  WHERE NOT EXISTS (SELECT 1 FROM pdom p WHERE p.code_id = e.code_id AND p.block_id = e.src AND p.pdom = e.dst)
    AND NOT EXISTS (SELECT 1 FROM pdom p WHERE p.code_id = e.code_id AND p.block_id = e.src AND p.pdom = d.pdom AND p.pdom <> e.src)
)"""
)
