"""Python 3.10: regions and operands of hand-made wordcode."""

from progdf.operators import cfg, decode, legacy

CODES = "code_id long, code binary, names array<string>, locals array<string>, derefs array<string>, cells array<string>, frees array<string>, const_kinds array<string>, const_texts array<string>"


def lifted(spark, *programs):
    n = {k: v[0] for k, v in legacy.OPCODES_310.items()} | {"EXTENDED_ARG": legacy.EXTENDED_ARG}
    rows = [(i, bytes(b for name, arg in p for b in (n[name], arg)), ["a", "b"], ["x", "y"], ["x", "y", "c", "f"], ["y", "c"], ["f"], ["int", "strings"], ["1", "p"]) for i, p in enumerate(programs, 1)]
    codes = spark.createDataFrame(rows, CODES)
    return legacy.lifted(decode.wordcode(codes, False, legacy.EXTENDED_ARG), codes)


def regions(spark, *programs):
    out = legacy.exception_regions(lifted(spark, *programs)).select("code_id", "start_off", "end_off", "handler_off", "stack_depth", "exc_items", "push_lasti")
    return sorted(tuple(r) for r in out.collect())


RETURN = [("LOAD_CONST", 0), ("RETURN_VALUE", 0)]


def test_depths_below_regions(spark):
    # try in a loop over an iterator; with below one value; async with does not count what it stores; a try that nothing reaches
    loop = [("LOAD_FAST", 0), ("GET_ITER", 0), ("FOR_ITER", 6), ("STORE_FAST", 1), ("SETUP_FINALLY", 2), ("POP_BLOCK", 0), ("JUMP_ABSOLUTE", 2), ("POP_EXCEPT", 0), ("JUMP_ABSOLUTE", 2), *RETURN]
    managed = [("LOAD_FAST", 0), ("LOAD_FAST", 1), ("SETUP_WITH", 2), ("POP_TOP", 0), ("POP_BLOCK", 0), ("WITH_EXCEPT_START", 0), *RETURN]
    awaited = [("LOAD_FAST", 0), ("BEFORE_ASYNC_WITH", 0), ("SETUP_ASYNC_WITH", 1), ("POP_TOP", 0), ("NOP", 0), *RETURN]
    dead = [*RETURN, ("SETUP_FINALLY", 1), ("NOP", 0), ("NOP", 0)]
    assert regions(spark, loop, managed, awaited, dead) == [(1, 10, 14, 14, 1, 6, False), (2, 6, 10, 10, 2, 6, False), (3, 6, 8, 8, 1, 6, False), (4, 6, 8, 8, 0, 6, False)]


def test_first_visit_wins(spark):
    # the handler comes to the inner try with six values before the long way comes with one; nested regions take theirs from the inside
    early = [("SETUP_FINALLY", 4), ("NOP", 0), ("NOP", 0), ("NOP", 0), ("LOAD_FAST", 0), ("SETUP_FINALLY", 1), ("NOP", 0), ("NOP", 0), *RETURN]
    nested = [("LOAD_FAST", 0), ("SETUP_FINALLY", 6), ("LOAD_FAST", 0), ("SETUP_FINALLY", 2), ("NOP", 0), ("POP_BLOCK", 0), ("NOP", 0), ("POP_TOP", 0), *RETURN]
    assert regions(spark, early, nested) == [(1, 2, 10, 10, 0, 6, False), (1, 12, 14, 14, 6, 6, False), (2, 4, 16, 16, 1, 6, False), (2, 8, 12, 12, 2, 6, False)]


def test_prefixes_short_stacks_and_ends(spark):
    wide = [("EXTENDED_ARG", 0), ("SETUP_FINALLY", 1), ("NOP", 0), ("NOP", 0), *RETURN]
    short = [("POP_TOP", 0), ("LOAD_FAST", 0), ("SETUP_FINALLY", 1), ("NOP", 0), ("NOP", 0), *RETURN]
    open_ = [("NOP", 0), ("SETUP_FINALLY", 9)]
    assert regions(spark, wide, short, open_) == [(1, 4, 6, 6, 0, 6, False), (2, 6, 8, 8, 0, 6, False)]
    assert [tuple(r) for r in legacy.unprotected(lifted(spark, wide, open_)).collect()] == [(2, 2, "setup without protected instruction")]


def test_operands(spark):
    p = [("ROT_TWO", 0), ("ROT_FOUR", 0), ("DUP_TOP", 0), ("ROT_N", 5), ("LOAD_GLOBAL", 1), ("LOAD_DEREF", 0), ("LOAD_CLOSURE", 2), ("CALL_FUNCTION", 2), ("MAKE_FUNCTION", 9), ("CALL_FUNCTION_EX", 1), ("LOAD_CONST", 1), ("CALL_FUNCTION_KW", 1),
         ("JUMP_IF_TRUE_OR_POP", 3), ("JUMP_FORWARD", 0), *RETURN]
    r = lifted(spark, p).orderBy("idx").collect()
    assert [x.operand for x in r[:4]] == [2, 4, 1, 5]
    assert [(x.symbol, x.stack_out) for x in r[4:7]] == [("b", 1), ("y", 1), ("f", 1)]
    assert [x.stack_in for x in r[7:10]] == [3, 4, 3] and r[11].keyword_names == ["p"]
    assert [(x.jump_target, x.jump_on_true) for x in r[12:14]] == [(6, True), (28, None)]
    assert not any(x.opcode == "Unsupported" for x in r)


def test_regions_make_a_valid_program(spark):
    i = lifted(spark, [("LOAD_FAST", 0), ("SETUP_FINALLY", 3), ("CALL_FUNCTION", 0), ("POP_BLOCK", 0), ("RETURN_VALUE", 0), ("POP_EXCEPT", 0), *RETURN])
    r = legacy.exception_regions(i)
    assert cfg.violations(i, r).isEmpty()
    assert not cfg.edges(cfg.with_blocks(i, r), r).where("kind = 'Exception' AND exc_items = 6").isEmpty()
