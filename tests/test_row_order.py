"""What grouped kernels number does not depend on the order in which rows come."""

from progdf.operators import cdg, ddg


def test_inputs_have_the_same_numbers_in_any_order(spark):
    row = lambda idx, block, opcode, name, symbol, sin, sout: {
        "idx": idx, "off": 2 * idx, "block_id": block, "name": name, "opcode": opcode, "operand": 0, "symbol": symbol, "secondary_symbol": None, "clears": False, "stack_in": sin,
        "stack_out": sout, "const_text": None, "src": None, "dst": None, "kind": None, "stack_depth": None, "exc_items": None}
    flow = lambda src, dst: {**dict.fromkeys(row(0, 0, "", "", None, 0, 0)), "src": src, "dst": dst, "kind": "Jump"}
    rows = [row(0, 1, "Branch", "JUMP", None, 0, 0)]
    for k in (2, 3):
        rows += [row(2 * k, k, "LoadLocal", "LOAD_FAST", f"v{k}", 0, 1), row(2 * k + 1, k, "Pop", "POP_TOP", None, 1, 0)]
    one, other = ddg._Code([*rows, flow(1, 2), flow(1, 3)]).solve(), ddg._Code([*rows, flow(1, 3), flow(1, 2)]).solve()
    assert one == other and sum(r[3] == "Input" for r in one) == 2


def test_intervals_of_the_tree_are_the_same_in_any_order(spark):
    ways = [(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4), (1, 4, 5), (1, 4, 6), (1, 5, 7), (1, 6, 7)]
    blocks = spark.createDataFrame([(1, b) for b in range(1, 8)], "code_id long, block_id long").coalesce(1)
    made = lambda x: spark.createDataFrame(x, "code_id long, src long, dst long").coalesce(1)
    one, other = (sorted(map(tuple, cdg.post_dominance(blocks, made(x)).collect())) for x in (ways, ways[::-1]))
    assert one == other
