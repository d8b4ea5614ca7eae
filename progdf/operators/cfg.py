"""Control flow: leaders, blocks, edges, look-ups, validation, refinement, reachability.

Instructions are rows (code_id, idx, off, opcode, symbol, jump_target, jump_on_true) and exception regions rows (code_id, start_off,
end_off, handler_off, stack_depth, exc_items, push_lasti). Everything is keyed by code_id, so all steps are joins and windows on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from progdf.functions.opcodes import is_suspension, is_terminator, may_raise

from .graphs import BLOCK, Condensed

REGION_SCHEMA = "code_id long, start_off int, end_off int, handler_off int, stack_depth int, exc_items int, push_lasti boolean"
EDGE_COLUMNS = ("code_id", "src", "dst", "kind", "stack_depth", "exc_items", "push_lasti")


def _order() -> Window:
    return Window.partitionBy("code_id").orderBy("idx")


def no_regions(instr: DataFrame) -> DataFrame:
    return instr.sparkSession.createDataFrame([], REGION_SCHEMA)


def violations(instr: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(code_id, off, problem): what a well-formed program must not have. Empty for a valid program."""
    regions = no_regions(instr) if regions is None else regions
    branch = F.col("opcode").isin("Branch", "ConditionalBranch")
    near = instr.withColumns({"before": F.lag("off").over(_order()), "after": F.lead("off").over(_order())})
    checks = [
        (F.col("before") >= F.col("off"), "offsets do not increase"),
        (branch & F.col("jump_target").isNull(), "branch without target"),
        (~branch & F.col("jump_target").isNotNull(), "target without branch"),
        (F.coalesce("jump_on_true", F.lit(False)) & (F.col("opcode") != "ConditionalBranch"), "true-branch flag without condition"),
        ((F.col("opcode") == "ConditionalBranch") & F.col("after").isNull(), "condition without fallthrough"),
    ]
    found = near.select("code_id", "off", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in checks]))).alias("problem"))
    places = instr.select("code_id", F.col("off").alias("place"))
    lost = instr.where("jump_target IS NOT NULL").join(places, (instr.code_id == places.code_id) & (F.col("jump_target") == F.col("place")), "left_anti")
    found = found.unionByName(lost.select("code_id", "off", F.lit("jump target is no instruction").alias("problem")))
    size = instr.groupBy("code_id").agg(F.count("*").alias("n"), F.max("off").alias("last"))
    r = regions.join(size, "code_id")
    for c, p in (
        ((F.col("start_off") >= F.col("end_off")) | (F.col("exc_items") == 0), "invalid region"),
        ((F.col("stack_depth") > F.col("n")) | (F.col("exc_items") > 8), "implausible region stack"),
    ):
        found = found.unionByName(r.where(c).select("code_id", F.col("start_off").alias("off"), F.lit(p).alias("problem")))
    for c in ("start_off", "handler_off", "end_off"):
        x = r if c != "end_off" else r.where("end_off <= last")
        bad = x.join(places, (x.code_id == places.code_id) & (x[c] == F.col("place")), "left_anti")
        found = found.unionByName(bad.select("code_id", F.col(c).alias("off"), F.lit("region boundary is no instruction").alias("problem")))
    return found


def leaders(instr: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(code_id, idx): the first instruction of every block."""
    # tables of jumps and places look a hundred times smaller by their files' size than their rows are, so they are merged, never broadcast
    places = instr.select("code_id", F.col("off").alias("place"), F.col("idx").alias("at")).hint("merge")

    def at(df: DataFrame, column: str) -> DataFrame:
        x = df.select("code_id", F.col(column).alias("place"))
        return x.join(places, ["code_id", "place"]).select("code_id", F.col("at").alias("idx"))

    last = F.max("idx").over(Window.partitionBy("code_id"))
    ends = instr.withColumn("last", last).where(is_terminator(F.col("opcode")) & (F.col("idx") < F.col("last")))
    found = instr.groupBy("code_id").agg(F.min("idx").alias("idx")).unionByName(at(instr.where("jump_target IS NOT NULL"), "jump_target"))
    found = found.unionByName(ends.select("code_id", (F.col("idx") + 1).alias("idx")))
    if regions is not None:
        for c in ("start_off", "handler_off", "end_off"):
            found = found.unionByName(at(regions, c))
        inside = instr.withColumn("last", last).where(may_raise(F.col("opcode")) & (F.col("idx") < F.col("last"))).join(regions.select("code_id", "start_off", "end_off"), "code_id")
        inside = inside.where("off >= start_off AND off < end_off")
        found = found.unionByName(inside.select("code_id", (F.col("idx") + 1).alias("idx")))
    return found.distinct()


def with_blocks(instr: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """instr with block_id, dense from 1 in each code, and is_last, true on a block's last instruction."""
    marked = instr.join(leaders(instr, regions).withColumn("leads", F.lit(1)), ["code_id", "idx"], "left")
    marked = marked.withColumn("block_id", F.sum(F.coalesce("leads", F.lit(0))).over(_order()))
    return marked.withColumn("is_last", F.coalesce(F.lead("leads").over(_order()) == 1, F.lead("idx").over(_order()).isNull())).drop("leads")


def blocks(placed: DataFrame) -> DataFrame:
    """(code_id, block_id, start_off, first_idx, last_idx) of instructions with blocks."""
    return placed.groupBy("code_id", "block_id").agg(F.min("off").alias("start_off"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def edges(placed: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(code_id, src, dst, kind, stack_depth, exc_items, push_lasti), each once; the last three are 0 and false but on exception edges."""
    top = F.max("block_id").over(Window.partitionBy("code_id"))
    last = placed.withColumn("top", top).where("is_last")
    has_next, op, on_true = F.col("block_id") < F.col("top"), F.col("opcode"), F.coalesce("jump_on_true", F.lit(False))
    kind = (
        F.when(op == "ConditionalBranch", F.when(on_true, "BranchFalse").otherwise("BranchTrue")).when(is_suspension(op), "Resume")
        .when(op.isin("Branch", "Return", "Raise"), F.lit(None)).otherwise("Fallthrough")
    )
    after = last.where(has_next).select("code_id", F.col("block_id").alias("src"), (F.col("block_id") + 1).alias("dst"), kind.alias("kind")).where("kind IS NOT NULL")
    # merged, as in leaders()
    starts = placed.select("code_id", F.col("off").alias("jump_target"), F.col("block_id").alias("dst")).hint("merge")
    jumps = last.where("jump_target IS NOT NULL").withColumn("kind", F.when(op == "Branch", "Jump").when(on_true, "BranchTrue").otherwise("BranchFalse"))
    jumps = jumps.join(starts, ["code_id", "jump_target"]).select("code_id", F.col("block_id").alias("src"), "dst", "kind")
    plain = after.unionByName(jumps).withColumns({"stack_depth": F.lit(0), "exc_items": F.lit(0), "push_lasti": F.lit(False)})
    if regions is not None:
        thrown = last.where(may_raise(op)).select("code_id", "off", F.col("block_id").alias("src")).join(regions, "code_id").where("off >= start_off AND off < end_off")
        thrown = thrown.join(starts.withColumnRenamed("jump_target", "handler_off"), ["code_id", "handler_off"])
        plain = plain.unionByName(thrown.select("code_id", "src", "dst", F.lit("Exception").alias("kind"), "stack_depth", "exc_items", "push_lasti"))
    return plain.select(*EDGE_COLUMNS).distinct()


def graph_violations(placed: DataFrame, cfg: DataFrame) -> DataFrame:
    """(code_id, problem): block ids that are not dense, edges to no block, exception metadata on other edges."""
    per = placed.groupBy("code_id").agg(F.countDistinct("block_id").alias("n"), F.max("block_id").alias("top"), F.min("block_id").alias("low"))
    bad = per.where("n <> top OR low <> 1").select("code_id", F.lit("block ids are not 1 to n").alias("problem"))
    out = cfg.join(per, "code_id").where("src < 1 OR dst < 1 OR src > top OR dst > top").select("code_id", F.lit("edge to no block").alias("problem"))
    odd = cfg.where("kind <> 'Exception' AND (stack_depth <> 0 OR exc_items <> 0 OR push_lasti)").select("code_id", F.lit("exception metadata on a plain edge").alias("problem"))
    return bad.unionByName(out).unionByName(odd).distinct()


def block_for_instruction(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code_id, idx, block_id) of wanted (code_id, idx) rows; block_id is null where there is no such instruction."""
    return wanted.join(placed.select("code_id", "idx", "block_id"), ["code_id", "idx"], "left")


def block_at_offset(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code_id, off, block_id) of wanted (code_id, off) rows."""
    return wanted.join(placed.select("code_id", "off", "block_id"), ["code_id", "off"], "left")


def neighbours(cfg: DataFrame) -> DataFrame:
    """(code_id, block_id, predecessors, successors): sorted, one entry for each edge."""
    out = cfg.groupBy("code_id", F.col("src").alias("block_id")).agg(F.array_sort(F.collect_list("dst")).alias("successors"))
    into = cfg.groupBy("code_id", F.col("dst").alias("block_id")).agg(F.array_sort(F.collect_list("src")).alias("predecessors"))
    none = F.array().cast("array<long>")
    both = into.join(out, ["code_id", "block_id"], "full_outer")
    return both.select("code_id", "block_id", F.coalesce(F.col("predecessors").cast("array<long>"), none).alias("predecessors"), F.coalesce(F.col("successors").cast("array<long>"), none).alias("successors"))


def outgoing(cfg: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges that leave wanted (code_id, block_id) rows."""
    return cfg.join(wanted.select("code_id", F.col("block_id").alias("src")), ["code_id", "src"], "left_semi")


def _ends(cfg: DataFrame) -> DataFrame:
    return cfg.select("code_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def _condensed(t: pa.Table) -> Condensed:
    src, dst = t["src"].to_numpy() - 1, t["dst"].to_numpy() - 1
    return Condensed(int(max(src.max(), dst.max())) + 1, src, dst)


def _codes(t: pa.Table, n: int) -> pa.Array:
    return pa.array(np.full(n, t["code_id"][0].as_py(), np.int64))


def reachability(placed: DataFrame, cfg: DataFrame) -> DataFrame:
    """(code_id, src, dst): block dst can be reached from src by at least one edge. All pairs; reaches(), reach_counts() and cyclic_blocks() do without them."""

    def run(t):
        g, a, b = _condensed(t), [], []
        for low, bits in g.reached():
            wide = [np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(BLOCK // 8, "little"), np.uint8), bitorder="little")) + low for x in bits]
            for v, c in enumerate(g.comp.tolist()):
                a.append(np.full(len(wide[c]), v))
                b.append(wide[c])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"code_id": _codes(t, len(a)), "src": a + 1, "dst": b + 1})

    del placed
    return _ends(cfg).groupBy("code_id").applyInArrow(run, "code_id long, src long, dst long")


def reach_counts(cfg: DataFrame) -> DataFrame:
    """(code_id, src, n_reached) of the blocks with successors, without making the pairs."""

    def run(t):
        g = _condensed(t)
        n = np.zeros(g.count, np.int64)
        for _, bits in g.reached():
            n += np.array([x.bit_count() for x in bits])
        src = np.unique(t["src"].to_numpy())
        return pa.table({"code_id": _codes(t, len(src)), "src": src, "n_reached": n[g.comp[src - 1]]})

    return _ends(cfg).groupBy("code_id").applyInArrow(run, "code_id long, src long, n_reached long")


def reaches(cfg: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (code_id, src, dst) rows, once each, with holds: is there a way from src to dst of one edge or more?"""

    def run(edges, asked):
        src, dst = asked["from"].to_numpy(), asked["to"].to_numpy()
        holds = np.zeros(len(src), bool)
        if edges.num_rows:
            g = _condensed(edges)
            known = np.flatnonzero((np.minimum(src, dst) >= 1) & (np.maximum(src, dst) <= g.n))
            for low, bits in g.reached():
                for i in known[(dst[known] > low) & (dst[known] <= low + BLOCK)].tolist():
                    holds[i] = bits[g.comp[src[i] - 1]] >> int(dst[i] - 1 - low) & 1
        return asked.append_column("holds", pa.array(holds)).rename_columns(["code_id", "src", "dst", "holds"])

    asked = _ends(wanted).where("code_id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").distinct()
    asked = asked.select(F.col("code_id").alias("code"), F.col("src").alias("from"), F.col("dst").alias("to"))
    return _ends(cfg).groupBy("code_id").cogroup(asked.groupBy("code")).applyInArrow(run, "code_id long, src long, dst long, holds boolean")


def cyclic_blocks(cfg: DataFrame) -> DataFrame:
    """(code_id, block_id) of blocks on a cycle."""

    def run(t):
        g = _condensed(t)
        on = np.flatnonzero(g.cyclic[g.comp])
        return pa.table({"code_id": _codes(t, len(on)), "block_id": on + 1})

    return _ends(cfg).groupBy("code_id").applyInArrow(run, "code_id long, block_id long")


def unassigned_edges(placed: DataFrame, cfg: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """The exception edges that definite assignment refutes: their last instruction only loads a local that surely has a value.

    parameters: (code_id, symbol), assigned from the start. Solved for each code as the complement: which locals may be
    unassigned at a block's entry is a least fixed point over its edges, but for edges into the first block.
    """
    spark = placed.sparkSession
    params = parameters if parameters is not None else spark.createDataFrame([], "code_id long, symbol string")
    local = ("LoadLocal", "StoreLocal", "DeleteLocal", "StoreLoadLocal", "StoreLocalPair")
    clears = F.col("clears") if "clears" in placed.columns else F.lit(False)
    second = F.col("secondary_symbol") if "secondary_symbol" in placed.columns else F.lit(None).cast("string")
    rows = placed.withColumns({"clears": clears, "second": second}).select("code_id", "idx", F.col("block_id").cast("long").alias("block_id"), "opcode", "symbol", "second", "clears")
    rows = rows.withColumns({"src": F.lit(None).cast("long"), "dst": F.lit(None).cast("long"), "kind": F.lit(None).cast("string")})
    flow = cfg.select("code_id", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("long").alias("block_id"), F.lit(None).cast("string").alias("opcode"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("second"), F.lit(False).alias("clears"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "kind").distinct()
    own = params.select("code_id", F.lit(-1).alias("idx"), F.lit(None).cast("long").alias("block_id"), F.lit("Parameter").alias("opcode"), "symbol", F.lit(None).cast("string").alias("second"), F.lit(False).alias("clears"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("string").alias("kind"))

    def run(t: pa.Table) -> pa.Table:
        code, program, flow, given, names = t["code_id"][0].as_py(), {}, [], set(), set()
        for r in sorted(t.to_pylist(), key=lambda r: -2 if r["idx"] is None else r["idx"]):
            if r["src"] is not None:
                flow.append((r["src"], r["dst"], r["kind"]))
            elif r["opcode"] == "Parameter":
                given.add(r["symbol"])
            else:
                program.setdefault(r["block_id"], []).append(r)
                if r["opcode"] in local:
                    names |= {r["symbol"]} | ({r["second"]} if r["opcode"] == "StoreLocalPair" else set())

        def after(state: set, r: dict) -> set:
            if r["opcode"] in ("StoreLocal", "StoreLoadLocal"):
                return state - {r["symbol"]}
            if r["opcode"] == "StoreLocalPair":
                return state - {r["symbol"], r["second"]}
            if r["opcode"] == "DeleteLocal" or (r["opcode"] == "LoadLocal" and r["clears"]):
                return state | {r["symbol"]}
            return state

        into = {d for _, d, _ in flow}
        entry = {b: set(names - given if b == 1 else names if b not in into else ()) for b in program}
        todo = list(program)
        while todo:
            b = todo.pop()
            state = entry[b]
            for r in program[b]:
                state = after(state, r)
            for s, d, _ in flow:
                if s == b and d != 1 and not state <= entry[d]:
                    entry[d] |= state
                    todo.append(d)
        gone = []
        for s, d, kind in flow:
            if kind == "Exception":
                *body, last = program[s]
                state = entry[s]
                for r in body:
                    state = after(state, r)
                if last["opcode"] == "LoadLocal" and not last["clears"] and last["symbol"] not in state:
                    gone.append((code, s, d))
        return pa.table({"code_id": pa.array([g[0] for g in gone], pa.int64()), "src": pa.array([g[1] for g in gone], pa.int64()), "dst": pa.array([g[2] for g in gone], pa.int64())})

    return rows.unionByName(flow).unionByName(own).groupBy("code_id").applyInArrow(run, "code_id long, src long, dst long")


def refined(placed: DataFrame, cfg: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """Edges without the refuted exception edges."""
    gone = unassigned_edges(placed, cfg, parameters).withColumn("kind", F.lit("Exception"))
    return cfg.join(gone, ["code_id", "src", "dst", "kind"], "left_anti").select(*EDGE_COLUMNS)
