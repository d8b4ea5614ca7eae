"""Python 3.10: its opcodes, and exception regions from SETUP instructions, which it has in place of exception tables."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cfg import REGION_SCHEMA
from .decode import CALL, CALL_310, CONST_MAP, COUNT, DIMENSION_SCHEMA, EX_CALL_310, FORMAT, MAKE_310, MAP, UNPACK, UNPACK_EX, lift

#: Fixed values of Python 3.10: name -> (number, semantic operation, operand kind, stack in, stack out).
EXTENDED_ARG = 144
OPCODES_310 = {
    "POP_TOP": (1, "Pop", "none", 1, 0), "ROT_TWO": (2, "StackRotate", "none", 0, 0), "ROT_THREE": (3, "StackRotate", "none", 0, 0), "DUP_TOP": (4, "StackCopy", "none", 0, 1), "DUP_TOP_TWO": (5, "Generic", "none", 0, 2), "ROT_FOUR": (6, "StackRotate", "none", 0, 0), "NOP": (9, "Nop", "none", 0, 0),
    "UNARY_POSITIVE": (10, "Generic", "none", 1, 1), "UNARY_NEGATIVE": (11, "Generic", "none", 1, 1), "UNARY_NOT": (12, "Generic", "none", 1, 1), "UNARY_INVERT": (15, "Generic", "none", 1, 1),
    "BINARY_MATRIX_MULTIPLY": (16, "Generic", "none", 2, 1), "INPLACE_MATRIX_MULTIPLY": (17, "Generic", "none", 2, 1), "BINARY_POWER": (19, "Generic", "none", 2, 1), "BINARY_MULTIPLY": (20, "Generic", "none", 2, 1), "BINARY_MODULO": (22, "Generic", "none", 2, 1), "BINARY_ADD": (23, "Generic", "none", 2, 1),
    "BINARY_SUBTRACT": (24, "Generic", "none", 2, 1), "BINARY_SUBSCR": (25, "LoadElement", "none", 2, 1), "BINARY_FLOOR_DIVIDE": (26, "Generic", "none", 2, 1), "BINARY_TRUE_DIVIDE": (27, "Generic", "none", 2, 1), "INPLACE_FLOOR_DIVIDE": (28, "Generic", "none", 2, 1), "INPLACE_TRUE_DIVIDE": (29, "Generic", "none", 2, 1),
    "GET_LEN": (30, "Generic", "none", 0, 1), "MATCH_MAPPING": (31, "Generic", "none", 0, 1), "MATCH_SEQUENCE": (32, "Generic", "none", 0, 1), "MATCH_KEYS": (33, "Generic", "none", 0, 2), "COPY_DICT_WITHOUT_KEYS": (34, "Generic", "none", 2, 2),
    "WITH_EXCEPT_START": (49, "Generic", "none", 0, 1), "GET_AITER": (50, "Generic", "none", 1, 1), "GET_ANEXT": (51, "Generic", "none", 0, 1), "BEFORE_ASYNC_WITH": (52, "Generic", "none", 1, 2), "END_ASYNC_FOR": (54, "Generic", "none", 7, 0),
    "INPLACE_ADD": (55, "Generic", "none", 2, 1), "INPLACE_SUBTRACT": (56, "Generic", "none", 2, 1), "INPLACE_MULTIPLY": (57, "Generic", "none", 2, 1), "INPLACE_MODULO": (59, "Generic", "none", 2, 1), "STORE_SUBSCR": (60, "StoreElement", "none", 3, 0), "DELETE_SUBSCR": (61, "DeleteElement", "none", 2, 0),
    "BINARY_LSHIFT": (62, "Generic", "none", 2, 1), "BINARY_RSHIFT": (63, "Generic", "none", 2, 1), "BINARY_AND": (64, "Generic", "none", 2, 1), "BINARY_XOR": (65, "Generic", "none", 2, 1), "BINARY_OR": (66, "Generic", "none", 2, 1), "INPLACE_POWER": (67, "Generic", "none", 2, 1),
    "GET_ITER": (68, "Generic", "none", 1, 1), "GET_YIELD_FROM_ITER": (69, "Generic", "none", 1, 1), "PRINT_EXPR": (70, "Generic", "none", 1, 0), "LOAD_BUILD_CLASS": (71, "Generic", "none", 0, 1), "YIELD_FROM": (72, "Yield", "none", 2, 1), "GET_AWAITABLE": (73, "Generic", "none", 1, 1), "LOAD_ASSERTION_ERROR": (74, "LoadLiteral", "none", 0, 1),
    "INPLACE_LSHIFT": (75, "Generic", "none", 2, 1), "INPLACE_RSHIFT": (76, "Generic", "none", 2, 1), "INPLACE_AND": (77, "Generic", "none", 2, 1), "INPLACE_XOR": (78, "Generic", "none", 2, 1), "INPLACE_OR": (79, "Generic", "none", 2, 1), "LIST_TO_TUPLE": (82, "Generic", "none", 1, 1),
    "RETURN_VALUE": (83, "Return", "none", 1, 0), "IMPORT_STAR": (84, "Generic", "none", 1, 0), "SETUP_ANNOTATIONS": (85, "Nop", "none", 0, 0), "YIELD_VALUE": (86, "Yield", "none", 1, 1), "POP_BLOCK": (87, "Nop", "none", 0, 0), "POP_EXCEPT": (89, "Generic", "none", 3, 0),
    "STORE_NAME": (90, "StoreGlobal", "name", 1, 0), "DELETE_NAME": (91, "DeleteGlobal", "name", 0, 0), "UNPACK_SEQUENCE": (92, "UnpackCollection", "count", 1, UNPACK), "FOR_ITER": (93, "ConditionalBranch", "jump", 0, 1), "UNPACK_EX": (94, "UnpackCollection", "count", 1, UNPACK_EX),
    "STORE_ATTR": (95, "StoreAttribute", "name", 2, 0), "DELETE_ATTR": (96, "Generic", "name", 1, 0), "STORE_GLOBAL": (97, "StoreGlobal", "name", 1, 0), "DELETE_GLOBAL": (98, "DeleteGlobal", "name", 0, 0), "ROT_N": (99, "StackRotate", "count", 0, 0),
    "LOAD_CONST": (100, "LoadConst", "const", 0, 1), "LOAD_NAME": (101, "LoadGlobal", "name", 0, 1), "BUILD_TUPLE": (102, "BuildCollection", "count", COUNT, 1), "BUILD_LIST": (103, "BuildCollection", "count", COUNT, 1), "BUILD_SET": (104, "BuildCollection", "count", COUNT, 1), "BUILD_MAP": (105, "BuildCollection", "count", MAP, 1),
    "LOAD_ATTR": (106, "LoadAttribute", "name", 1, 1), "COMPARE_OP": (107, "Generic", "count", 2, 1), "IMPORT_NAME": (108, "ImportModule", "name", 2, 1), "IMPORT_FROM": (109, "ImportAttribute", "name", 0, 1), "JUMP_FORWARD": (110, "Branch", "jump", 0, 0),
    "JUMP_IF_FALSE_OR_POP": (111, "ConditionalBranch", "abs", 1, 0), "JUMP_IF_TRUE_OR_POP": (112, "ConditionalBranch", "abs", 1, 0), "JUMP_ABSOLUTE": (113, "Branch", "abs", 0, 0), "POP_JUMP_IF_FALSE": (114, "ConditionalBranch", "abs", 1, 0), "POP_JUMP_IF_TRUE": (115, "ConditionalBranch", "abs", 1, 0),
    "LOAD_GLOBAL": (116, "LoadGlobal", "name", 0, 1), "IS_OP": (117, "Generic", "count", 2, 1), "CONTAINS_OP": (118, "Generic", "count", 2, 1), "RERAISE": (119, "Raise", "none", 3, 0), "JUMP_IF_NOT_EXC_MATCH": (121, "ConditionalBranch", "abs", 2, 0), "SETUP_FINALLY": (122, "Nop", "setup", 0, 0),
    "LOAD_FAST": (124, "LoadLocal", "local", 0, 1), "STORE_FAST": (125, "StoreLocal", "local", 1, 0), "DELETE_FAST": (126, "DeleteLocal", "local", 0, 0), "GEN_START": (129, "Nop", "none", 0, 0), "RAISE_VARARGS": (130, "Raise", "count", COUNT, 0),
    "CALL_FUNCTION": (131, "Call", "count", CALL_310, 1), "MAKE_FUNCTION": (132, "CreateFunction", "count", MAKE_310, 1), "BUILD_SLICE": (133, "Generic", "count", COUNT, 1), "LOAD_CLOSURE": (135, "LoadLocal", "cell", 0, 1), "LOAD_DEREF": (136, "LoadLocal", "cell", 0, 1), "STORE_DEREF": (137, "StoreLocal", "cell", 1, 0), "DELETE_DEREF": (138, "DeleteLocal", "cell", 0, 0),
    "CALL_FUNCTION_KW": (141, "Call", "count", CALL, 1), "CALL_FUNCTION_EX": (142, "Call", "count", EX_CALL_310, 1), "SETUP_WITH": (143, "EnterContext", "setup", 1, 2), "LIST_APPEND": (145, "StoreCollectionElement", "count", 1, 0), "SET_ADD": (146, "StoreCollectionElement", "count", 1, 0), "MAP_ADD": (147, "StoreCollectionElement", "count", 2, 0),
    "LOAD_CLASSDEREF": (148, "LoadLocal", "cell", 0, 1), "MATCH_CLASS": (152, "Generic", "count", 3, 2), "SETUP_ASYNC_WITH": (154, "Nop", "setup", 0, 0), "FORMAT_VALUE": (155, "Generic", "count", FORMAT, 1), "BUILD_CONST_KEY_MAP": (156, "BuildCollection", "count", CONST_MAP, 1), "BUILD_STRING": (157, "Generic", "count", COUNT, 1),
    "LOAD_METHOD": (160, "LoadAttribute", "name", 1, 2), "CALL_METHOD": (161, "Call", "count", CALL, 1), "LIST_EXTEND": (162, "Generic", "count", 1, 0), "SET_UPDATE": (163, "Generic", "count", 1, 0), "DICT_MERGE": (164, "Generic", "count", 1, 0), "DICT_UPDATE": (165, "Generic", "count", 1, 0),
}
#: Arguments that the opcode itself implies, and what conditional jumps take off the stack if they jump, where that differs.
IMPLIED = {"ROT_TWO": 2, "ROT_THREE": 3, "ROT_FOUR": 4, "DUP_TOP": 1}
JUMPING = {"FOR_ITER": 1, "JUMP_IF_FALSE_OR_POP": 0, "JUMP_IF_TRUE_OR_POP": 0}
#: Values that an exception puts on the stack.
EXCEPTION_ITEMS = 6


def dimension(spark: SparkSession) -> DataFrame:
    """The opcode dimension of 3.10."""
    return spark.createDataFrame([("3.10", number, name, *spec, 0) for name, (number, *spec) in OPCODES_310.items()], DIMENSION_SCHEMA)


def lifted(raw: DataFrame, codes: DataFrame) -> DataFrame:
    """Semantic instructions of 3.10 wordcode, decode.wordcode(codes, False, EXTENDED_ARG); rotations and copies have their implied operand."""
    out = lift(raw, codes, dimension(raw.sparkSession))
    implied = F.coalesce(*[F.when(F.col("name") == n, F.lit(v)) for n, v in IMPLIED.items()], F.col("operand"))
    return out.withColumn("operand", implied)


def unprotected(instr: DataFrame) -> DataFrame:
    """(code_id, off, problem): SETUP instructions that nothing follows; they make no region."""
    last = instr.groupBy("code_id").agg(F.max("off").alias("off"))
    return instr.join(last, ["code_id", "off"], "left_semi").where("handler IS NOT NULL").select("code_id", "off", F.lit("setup without protected instruction").alias("problem"))


def exception_regions(instr: DataFrame) -> DataFrame:
    """Regions of lifted 3.10 instructions, each from behind a SETUP instruction to its handler.

    stack_depth is the depth at the first visit of the SETUP instruction in a breadth-first walk from the start, in which
    an instruction leads to the handlers around it, its jump target and the next one, in this order; 0 if none reaches it.
    SETUP_ASYNC_WITH does not count the value that is stored next. A walk ends where the stack does not suffice and at
    unknown opcodes. One code object in one task, with a row for each instruction.
    """
    cols = ("code_id", "idx", "off", "name", "opcode", "jump_target", "handler", "stack_in", "stack_out")

    def run(t):
        t = t.sort_by("idx")
        offs, names, ops, jumps, handlers, takes, gives = (t[c].to_pylist() for c in cols[2:])
        n, place = len(offs), {o: i for i, o in enumerate(offs)}
        setups = [i for i in range(n - 1) if handlers[i] is not None]
        around: list[list[int]] = [[] for _ in range(n)]
        for s in setups:
            for i in range(s + 1, bisect_left(offs, handlers[s])):
                around[i].append(s)
        depth, below, todo = {0: 0}, dict.fromkeys(setups, 0), deque([0])

        def visit(i, d):
            if i is not None and i < n and i not in depth and d >= 0:
                depth[i] = d
                todo.append(i)

        while todo:
            i = todo.popleft()
            d = depth[i]
            if i in below:
                below[i] = max(d - 1, 0) if names[i] == "SETUP_ASYNC_WITH" else d
            for s in around[i]:
                visit(place.get(handlers[s]), below[s] + EXCEPTION_ITEMS)
            if ops[i] in ("Return", "Raise", "Unsupported"):
                continue
            if jumps[i] is not None:
                off = JUMPING.get(names[i], takes[i])
                visit(place.get(jumps[i]), d - off)
            if ops[i] != "Branch" and d >= takes[i]:
                visit(i + 1, d - takes[i] + gives[i])
        k, code = len(setups), t["code_id"][0].as_py()
        ends = [handlers[s] for s in setups]
        return pa.table([pa.array([code] * k, pa.int64()), *[pa.array(x, pa.int32()) for x in ([offs[s + 1] for s in setups], ends, ends, [below[s] for s in setups], [EXCEPTION_ITEMS] * k)], pa.array([False] * k, pa.bool_())],
                        ["code_id", "start_off", "end_off", "handler_off", "stack_depth", "exc_items", "push_lasti"])

    return instr.select(*cols).groupBy("code_id").applyInArrow(run, REGION_SCHEMA)
