"""Control flow and control dependence on small programs with known results."""

import numpy as np
import pytest

from progdf.operators import cdg, cfg
from progdf.operators import graphs as kernels

I = "code_id long, idx int, off int, opcode string, symbol string, jump_target int, jump_on_true boolean"  # noqa: E741


def program(spark, rows):
    return spark.createDataFrame([(1, i, 2 * i, op, s, t, None if op != "ConditionalBranch" else False) for i, (op, s, t) in enumerate(rows)], I)


DIAMOND = [("LoadLocal", "x", None), ("ConditionalBranch", None, 8), ("LoadConst", None, None), ("Branch", None, 10), ("LoadConst", None, None), ("Return", None, None)]
LOOP = [("LoadLocal", "x", None), ("ConditionalBranch", None, 8), ("LoadConst", None, None), ("Branch", None, 0), ("Return", None, None)]


def graphs(spark, rows, regions=None):
    p = cfg.with_blocks(program(spark, rows), regions)
    e = cfg.edges(p, regions)
    d = cdg.post_dominance(cfg.blocks(p), e)
    return p, e, d


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_diamond(spark):
    p, e, d = graphs(spark, DIAMOND)
    assert rows(cfg.blocks(p), "block_id", "start_off") == [(1, 0), (2, 4), (3, 8), (4, 10)]
    assert rows(cdg.immediate(d), "block_id", "ipdom") == [(1, 4), (2, 4), (3, 4), (4, 0)]
    assert rows(cdg.control_dependence(e, d), "controller", "dependent", "outcome") == [(1, 2, "True"), (1, 3, "False")]


def test_loop_header_controls_itself(spark):
    _, e, d = graphs(spark, LOOP)
    assert (2, 1) in rows(cdg.immediate(d), "block_id", "ipdom")
    assert rows(cdg.control_dependence(e, d), "controller", "dependent", "outcome") == [(1, 1, "True"), (1, 2, "True")]


def test_endless_loop_has_no_dependence(spark):
    _, e, d = graphs(spark, [("Branch", None, 0)])
    assert rows(cdg.immediate(d), "block_id", "ipdom") == [(1, 0)]
    assert cdg.control_dependence(e, d).isEmpty()


def test_exception_edge_and_refinement(spark):
    region = spark.createDataFrame([(1, 0, 4, 6, 0, 1, False)], cfg.REGION_SCHEMA)
    body = [("LoadLocal", "x", None), ("StoreLocal", "y", None), ("Return", None, None), ("Return", None, None)]
    p, e, d = graphs(spark, body, region)
    assert (1, 4, "Exception") in rows(e, "src", "dst", "kind") or (1, 3, "Exception") in rows(e, "src", "dst", "kind")
    params = spark.createDataFrame([(1, "x")], "code_id long, symbol string")
    assert cfg.refined(p, e, params).where("kind = 'Exception' AND src = 1").isEmpty()
    assert not cfg.refined(p, e).where("kind = 'Exception' AND src = 1").isEmpty()


@pytest.mark.parametrize(("rows_", "problem"), [
    ([("Branch", None, 3)], "jump target is no instruction"), ([("Branch", None, None)], "branch without target"), ([("Pop", None, 0)], "target without branch"),
    ([("ConditionalBranch", None, 0)], "condition without fallthrough"),
])
def test_violations(spark, rows_, problem):
    assert problem in [r.problem for r in cfg.violations(program(spark, rows_)).collect()]


def test_valid_program_has_no_violations(spark):
    assert cfg.violations(program(spark, DIAMOND)).isEmpty()


def _walks(n, pairs, without=None):
    """Nodes that each node reaches by an edge or more, never through `without`."""
    out = {}
    for v in range(n):
        seen, todo = set(), [v]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b != without and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[v] = seen
    return out


@pytest.mark.parametrize("seed", range(40))
def test_graph_kernels_against_all_walks(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 14))
    m = int(rng.integers(0, 3 * n))
    src, dst = rng.integers(0, n, m), rng.integers(0, n, m)
    pairs = set(zip(src.tolist(), dst.tolist(), strict=True))
    walks = _walks(n, pairs)
    monkeypatch.setattr(kernels, "BLOCK", 5)
    g = kernels.Condensed(n, src, dst)
    got = {v: set() for v in range(n)}
    for low, bits in g.reached():
        for v in range(n):
            got[v] |= {low + i for i in range(5) if bits[g.comp[v]] >> i & 1}
    assert got == walks
    assert [bool(g.cyclic[c]) for c in g.comp] == [v in walks[v] for v in range(n)]
    idom, enter, leave = kernels.dominators(n, 0, src, dst)
    live = walks[0] | {0}
    for v in range(n):
        if v not in live:
            assert (idom[v], enter[v]) == (-1, -1)
            continue
        strict = {d for d in live if d != v and (d == 0 or v not in _walks(n, pairs, d)[0])} if v else set()
        assert {d for d in live if d != v and enter[d] <= enter[v] < leave[d]} == strict
        assert idom[v] == max(strict, key=lambda d: enter[d], default=-1)


def test_a_code_object_of_100_000_blocks(spark):
    """A ladder with a loop over all of it: the tree, cycles and single questions need no pairs of blocks."""
    n = 100_000
    step = spark.range(1, n).selectExpr("1L AS code_id", "CAST(id AS INT) AS src", "CAST(id + 1 AS INT) AS dst", "IF(id % 2 = 0, 'BranchTrue', 'Fallthrough') AS kind")
    skip = spark.range(2, n - 1, 2).selectExpr("1L AS code_id", "CAST(id AS INT) AS src", "CAST(id + 2 AS INT) AS dst", "'BranchFalse' AS kind")
    back = spark.createDataFrame([(1, n - 1, 2, "BranchFalse")], "code_id long, src int, dst int, kind string")
    edges = step.unionByName(skip).unionByName(back)
    blocks = spark.range(1, n + 1).selectExpr("1L AS code_id", "id AS block_id")
    tree = cdg.post_dominance(blocks, edges)
    got = tree.selectExpr("count(*)", "count_if(ipdom = block_id + IF(block_id % 2 = 0 AND block_id <= 99998, 2, 1))", "max(leave)").first()
    assert tuple(got) == (n, n - 1, n + 1)
    assert cfg.cyclic_blocks(edges).count() == n - 2
    asked = spark.createDataFrame([(1, 1, n), (1, n, 1), (1, 7, 6), (1, 2, 1), (2, 1, 1), (1, 5, n + 9)], "code_id long, src long, dst long")
    assert rows(cfg.reaches(edges, asked).where("holds"), "code_id", "src", "dst") == [(1, 1, n), (1, 7, 6)]
    assert cdg.postdominates(tree, spark.createDataFrame([(1, 0, 5), (1, n, 1), (1, 3, 2), (1, 4, 2)], "code_id long, pdom long, block_id long")).where("holds").count() == 3
