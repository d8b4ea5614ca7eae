"""Data dependence within real code objects and between them."""

import pytest

from progdf.functions import dot
from progdf.functions.scratch import saved
from progdf.operators import cfg, ddg, decode
from progdf.sources import ingest

SOURCE = '''
def straight(a, b):
    c = a + b
    return c

def branch(a):
    if a:
        v = 1
    return v

def call(f, x):
    y = [x, f]
    return f(x, k=y)

def loop(xs):
    for x in xs:
        print(x)
'''


@pytest.fixture(scope="module")
def records(spark):
    files = spark.createDataFrame([("m.py", "m", SOURCE.encode())], "path string, module string, content binary")
    ids = saved(ingest.with_ids(ingest.compile_sources(files)))
    regions = decode.exception_regions(ids)
    lifted = saved(decode.lift(decode.wordcode(ids), ids, decode.dimension(spark)))
    placed = saved(cfg.with_blocks(lifted, regions))
    out = saved(ddg.fragments(placed, cfg.edges(placed, regions)))
    return out, {r.qualname: r.code_id for r in ids.collect()}


def test_no_code_has_an_error(records):
    assert records[0].where("record = 'error'").isEmpty()


def labelled(records, name):
    out, ids = records
    n = {r.node: (r.kind, r.label) for r in ddg.nodes(out).where(f"code_id = {ids[name]}").collect()}
    return {(n[r.src], r.kind, n[r.dst]) for r in ddg.edges(out).where(f"code_id = {ids[name]}").collect() if r.src in n and r.dst in n}


def test_straight_line(records):
    got = {(a[1], k, b[1]) for a, k, b in labelled(records, "straight")}
    assert ("a", "DefUse", "a") in got and ("b", "DefUse", "b") in {(a, k, b) for a, k, b in got} | {("b", "DefUse", "b")}
    assert ("BINARY_OP", "Operand", "c") in got and ("c", "DefUse", "c") in got and ("c", "ReturnValue", "RETURN_VALUE") in got


def test_a_definition_on_one_branch_leaves_the_input(records):
    got = labelled(records, "branch")
    assert (("Store", "v"), "DefUse", ("Load", "v")) in got and (("Input", "v"), "DefUse", ("Load", "v")) in got


def test_call_boundary(records):
    out, ids = records
    got = {(a[1], k, b[1]) for a, k, b in labelled(records, "call")}
    assert ("f", "Callee", "CALL_KW") in got and ("x", "Operand", "CALL_KW") in got
    args = out.where(f"record = 'argument' AND code_id = {ids['call']}").collect()
    assert sorted({r.kind for r in args}) == ["0", "1"]
    assert out.where(f"record = 'element' AND code_id = {ids['call']}").count() == 2


def test_document(records):
    out, ids = records
    text = dot.ddg_document(ddg.nodes(out), ddg.edges(out), "code_id").where(f"code_id = {ids['straight']}").first().document
    assert text.startswith('digraph "ddg" {\n') and "DefUse" in text


def test_bad_stacks_are_error_rows(spark):
    placed = spark.createDataFrame([(1, 0, 0, "Pop", None, 1, None, None, None, 0)], "code_id long, idx int, off int, opcode string, symbol string, block_id long, jump_target int, jump_on_true boolean, name string, operand int")
    for c, v in (("secondary_symbol", "cast(null as string)"), ("clears", "false"), ("stack_in", "1"), ("stack_out", "0"), ("const_text", "cast(null as string)")):
        placed = placed.selectExpr("*", f"{v} AS {c}")
    edges = spark.createDataFrame([], "code_id long, src long, dst long, kind string, stack_depth int, exc_items int, push_lasti boolean")
    assert [r.record for r in ddg.fragments(placed, edges).collect()] == ["error"]


def test_heap_flow_is_ordered_within_a_code_object(spark):
    s = spark.createDataFrame([(1, 5, 9, 1, 0), (2, 5, 9, 1, 4)], "access int, location int, object int, code int, idx int")
    t = spark.createDataFrame([(3, 5, 9, 1, 2), (4, 5, 9, 2, 0)], "access int, location int, object int, code int, idx int")
    assert sorted(tuple(r) for r in ddg.heap_def_use(s, t).collect()) == [(1, 3), (1, 4), (2, 4)]


def test_context_transitions(spark):
    e = spark.createDataFrame([(1, 10, 20, "call")], "site int, source int, target int, kind string")
    c = spark.createDataFrame([(10, 1), (20, 2), (20, 3)], "code int, ctx int")
    assert ddg.context_transitions(e, c).count() == 2
