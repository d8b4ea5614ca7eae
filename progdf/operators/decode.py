"""Wordcode to semantic instructions, by joins with the opcode dimension of a version.

Raw instructions are (code_id, off, opcode, arg, prefix_size); lifted ones have the columns that control flow and data dependence need.
"""

from __future__ import annotations

import opcode as own

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENDED_ARG, CACHE = own.opmap["EXTENDED_ARG"], own.opmap["CACHE"]

#: Python 3.13: name -> (semantic operation, operand kind, stack in, stack out). Negative stack numbers are rules of effect().
N, COUNT, MAP, CONST_MAP, UNPACK, UNPACK_EX, FORMAT, EX_CALL, CALL, CALL_310, EX_CALL_310, MAKE_310 = 0, -1, -2, -3, -4, -5, -6, -7, -8, -9, -10, -11
DIMENSION_SCHEMA = "version string, opcode int, name string, op string, operand string, stack_in_rule int, stack_out_rule int, extra int"
OPCODES_313 = {
    **{n: ("Nop", "none", 0, 0) for n in ("NOP", "RESUME", "COPY_FREE_VARS", "SETUP_ANNOTATIONS", "MAKE_CELL")},
    "LOAD_CONST": ("LoadConst", "const", 0, 1), "LOAD_ASSERTION_ERROR": ("LoadLiteral", "none", 0, 1), "RETURN_GENERATOR": ("LoadLiteral", "none", 0, 1),
    **{n: ("LoadLocal", "local", 0, 1) for n in ("LOAD_FAST", "LOAD_FAST_CHECK", "LOAD_FAST_AND_CLEAR", "LOAD_DEREF")}, **{n: ("StoreLocal", "local", 1, 0) for n in ("STORE_FAST", "STORE_DEREF")}, **{n: ("DeleteLocal", "local", 0, 0) for n in ("DELETE_FAST", "DELETE_DEREF")},
    "LOAD_GLOBAL": ("LoadGlobal", "name1", 0, 1), "LOAD_NAME": ("LoadGlobal", "name", 0, 1), "LOAD_FROM_DICT_OR_GLOBALS": ("LoadGlobal", "name", 1, 1), "STORE_GLOBAL": ("StoreGlobal", "name", 1, 0), "STORE_NAME": ("StoreGlobal", "name", 1, 0), "DELETE_GLOBAL": ("DeleteGlobal", "name", 0, 0), "DELETE_NAME": ("DeleteGlobal", "name", 0, 0),
    "LOAD_FAST_LOAD_FAST": ("LoadLocalPair", "pair", 0, 2), "STORE_FAST_STORE_FAST": ("StoreLocalPair", "pair", 2, 0), "STORE_FAST_LOAD_FAST": ("StoreLoadLocal", "pair", 1, 1),
    "LOAD_ATTR": ("LoadAttribute", "name1", 1, 1), "LOAD_SUPER_ATTR": ("LoadAttribute", "name2", 3, 1), "STORE_ATTR": ("StoreAttribute", "name", 2, 0), "BINARY_SUBSCR": ("LoadElement", "none", 2, 1), "STORE_SUBSCR": ("StoreElement", "none", 3, 0), "DELETE_SUBSCR": ("DeleteElement", "none", 2, 0),
    "LIST_APPEND": ("StoreCollectionElement", "count", 1, 0), "SET_ADD": ("StoreCollectionElement", "count", 1, 0), "MAP_ADD": ("StoreCollectionElement", "count", 2, 0),
    **{n: ("BuildCollection", "count", COUNT, 1) for n in ("BUILD_LIST", "BUILD_TUPLE", "BUILD_SET")}, "BUILD_MAP": ("BuildCollection", "count", MAP, 1), "BUILD_CONST_KEY_MAP": ("BuildCollection", "count", CONST_MAP, 1),
    "UNPACK_SEQUENCE": ("UnpackCollection", "count", 1, UNPACK), "UNPACK_EX": ("UnpackCollection", "count", 1, UNPACK_EX), "IMPORT_NAME": ("ImportModule", "name", 2, 1), "IMPORT_FROM": ("ImportAttribute", "name", 0, 1),
    "MAKE_FUNCTION": ("CreateFunction", "none", 1, 1), "SET_FUNCTION_ATTRIBUTE": ("SetFunctionAttribute", "count", 2, 1), "CALL": ("Call", "count", CALL, 1), "CALL_KW": ("Call", "count", CALL, 1), "CALL_FUNCTION_EX": ("Call", "count", EX_CALL, 1), "PUSH_NULL": ("Marker", "none", 0, 1), "BEFORE_WITH": ("EnterContext", "none", 1, 2),
    "POP_TOP": ("Pop", "none", 1, 0), "COPY": ("StackCopy", "count", 0, 1), "SWAP": ("StackSwap", "count", 0, 0), "JUMP_FORWARD": ("Branch", "jump", 0, 0), "JUMP_BACKWARD": ("Branch", "back", 0, 0), "JUMP_BACKWARD_NO_INTERRUPT": ("Branch", "back", 0, 0),
    **{n: ("ConditionalBranch", "jump", 1, 0) for n in ("POP_JUMP_IF_TRUE", "POP_JUMP_IF_FALSE", "POP_JUMP_IF_NONE", "POP_JUMP_IF_NOT_NONE")}, "FOR_ITER": ("ConditionalBranch", "jump", 0, 1), "SEND": ("ConditionalBranch", "jump", 1, 1),
    "RETURN_VALUE": ("Return", "none", 1, 0), "RETURN_CONST": ("Return", "const", 0, 0), "RAISE_VARARGS": ("Raise", "count", COUNT, 0), "RERAISE": ("Raise", "none", 1, 0), "YIELD_VALUE": ("Yield", "none", 1, 1),
    **{n: ("Generic", "count", 2, 1) for n in ("BINARY_OP", "COMPARE_OP", "CONTAINS_OP", "IS_OP", "CALL_INTRINSIC_2", "CLEANUP_THROW")},
    **{n: ("Generic", "count", 1, 1) for n in ("UNARY_NEGATIVE", "UNARY_INVERT", "UNARY_NOT", "GET_ITER", "GET_AITER", "GET_AWAITABLE", "GET_YIELD_FROM_ITER", "FORMAT_SIMPLE", "TO_BOOL", "CONVERT_VALUE", "CALL_INTRINSIC_1", "LOAD_FROM_DICT_OR_DEREF")},
    "FORMAT_WITH_SPEC": ("Generic", "none", 2, 1), "GET_ANEXT": ("Generic", "none", 0, 1), "GET_LEN": ("Generic", "none", 0, 1), "DELETE_ATTR": ("Generic", "name", 1, 0), "BEFORE_ASYNC_WITH": ("Generic", "none", 1, 2), "BINARY_SLICE": ("Generic", "none", 3, 1), "STORE_SLICE": ("Generic", "none", 4, 0),
    "BUILD_SLICE": ("Generic", "count", COUNT, 1), "BUILD_STRING": ("Generic", "count", COUNT, 1), "LOAD_BUILD_CLASS": ("Generic", "none", 0, 1), "LOAD_LOCALS": ("Generic", "none", 0, 1), "CHECK_EXC_MATCH": ("Generic", "none", 2, 2), "CHECK_EG_MATCH": ("Generic", "none", 2, 2),
    "END_FOR": ("Generic", "none", 1, 0), "END_SEND": ("Generic", "none", 2, 1), "END_ASYNC_FOR": ("Generic", "none", 2, 0), "POP_EXCEPT": ("Generic", "none", 1, 0), "PUSH_EXC_INFO": ("Generic", "none", 1, 2), "WITH_EXCEPT_START": ("Generic", "none", 0, 1), "MATCH_KEYS": ("Generic", "none", 0, 1),
    "MATCH_MAPPING": ("Generic", "none", 0, 1), "MATCH_SEQUENCE": ("Generic", "none", 0, 1), "MATCH_CLASS": ("Generic", "none", 3, 1), **{n: ("Generic", "count", 1, 0) for n in ("LIST_EXTEND", "SET_UPDATE", "DICT_MERGE", "DICT_UPDATE")},
}
#: Opcodes whose jumps count from after one cache entry.
CACHED_JUMPS = ("JUMP_BACKWARD", "POP_JUMP_IF_TRUE", "POP_JUMP_IF_FALSE", "POP_JUMP_IF_NONE", "POP_JUMP_IF_NOT_NONE", "FOR_ITER", "SEND")


def dimension(spark: SparkSession, version: str = "3.13") -> DataFrame:
    """(version, opcode, name, op, operand, stack_in_rule, stack_out_rule, extra): a row for each opcode."""
    rows = [(version, own.opmap[n], n, *spec, 2 if n in CACHED_JUMPS else 0) for n, spec in OPCODES_313.items() if n in own.opmap]
    return spark.createDataFrame(rows, DIMENSION_SCHEMA)


def byte(code: Column, i: Column) -> Column:
    """Unsigned byte at place i, from 0."""
    return F.conv(F.hex(F.substring(code, i + 1, F.lit(1))), 16, 10).cast("int")


def violations(codes: DataFrame) -> DataFrame:
    """(code_id, problem): an odd number of bytes, or a prefix without an instruction."""
    n = F.length("code")
    odd = codes.where(n % 2 == 1).select("code_id", F.lit("odd wordcode").alias("problem"))
    return odd.unionByName(codes.where((n % 2 == 0) & (n > 0)).where(byte(F.col("code"), n - 2) == EXTENDED_ARG).select("code_id", F.lit("prefix without instruction").alias("problem")))


def wordcode(codes: DataFrame, omit_caches: bool = True, extended_arg: int = EXTENDED_ARG) -> DataFrame:
    """(code_id, off, opcode, arg, prefix_size) of (code_id, code) rows.

    Units run in islands of prefixes and the instruction that they extend; off is the island's first byte.
    """
    unit = codes.where("length(code) > 1").select("code_id", "code", F.explode(F.sequence(F.lit(0), (F.length("code") / 2).cast("int") - 1)).alias("u"))
    unit = unit.select("code_id", "u", byte(F.col("code"), F.col("u") * 2).alias("opcode"), byte(F.col("code"), F.col("u") * 2 + 1).cast("long").alias("value"))
    w = Window.partitionBy("code_id").orderBy("u")
    ends = (F.col("opcode") != extended_arg).cast("int")
    unit = unit.withColumn("island", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = F.max("u").over(Window.partitionBy("code_id", "island"))
    unit = unit.withColumn("place", top - F.col("u"))
    arg = F.sum(F.col("value") * F.pow(F.lit(256), F.col("place")).cast("long"))
    out = unit.groupBy("code_id", "island").agg((F.min("u") * 2).alias("off"), F.max_by("opcode", "u").alias("opcode"), arg.alias("arg"), (F.count("*").cast("int") - 1).alias("prefix_size"))
    return (out.where(F.col("opcode") != CACHE) if omit_caches else out).select("code_id", F.col("off").cast("int").alias("off"), "opcode", "arg", "prefix_size")


def effect(rule: Column, arg: Column) -> Column:
    """Stack count of a rule and an argument."""
    return (
        F.when(rule >= 0, rule).when(rule == COUNT, arg).when(rule == MAP, 2 * arg).when(rule == CONST_MAP, arg + 1).when(rule == UNPACK, arg)
        .when(rule == UNPACK_EX, F.expr("(arg & 255) + (arg >> 8) + 1")).when(rule == FORMAT, 1 + F.shiftright(arg, 2).bitwiseAND(F.lit(1))).when(rule == EX_CALL, 3 + arg % 2).when(rule == CALL, arg + 2)
        .when(rule == CALL_310, arg + 1).when(rule == EX_CALL_310, 2 + arg % 2).when(rule == MAKE_310, 2 + F.bit_count(arg.bitwiseAND(F.lit(15))))
    ).cast("long")


def lift(raw: DataFrame, codes: DataFrame, dim: DataFrame) -> DataFrame:
    """Semantic instructions: opcode, symbol and secondary symbol, jump target, stack counts, keyword names and import level. Unknown opcodes are Unsupported.

    codes: code_id, names, locals, derefs, const_kinds, const_texts.
    """
    x = raw.withColumnRenamed("opcode", "number").join(F.broadcast(dim.withColumnRenamed("opcode", "number")), "number", "left")
    cells = F.concat("cells", "frees") if {"cells", "frees"} <= set(codes.columns) else F.slice("derefs", F.size("locals") + 1, F.size("derefs"))
    x = x.join(codes.select("code_id", "names", "locals", "derefs", "const_kinds", "const_texts", cells.alias("cells")), "code_id")
    w = Window.partitionBy("code_id").orderBy("off")
    i = F.col("arg")  # four prefixes and more go beyond an int
    at = lambda c, k: F.get(F.col(c), F.when(k < F.size(c), k).cast("int"))
    kind = F.col("operand")
    symbol = (
        F.when(kind == "name", at("names", i)).when(kind == "name1", at("names", F.shiftright(i, 1))).when(kind == "name2", at("names", F.shiftright(i, 2))).when(kind == "local", at("derefs", i))
        .when(kind == "pair", at("derefs", F.shiftright(i, 4))).when(kind == "cell", at("cells", i))
    )
    after = F.col("off") + F.col("prefix_size") * 2 + 2 + F.col("extra")
    jump = F.when(kind == "jump", after + 2 * i).when(kind == "back", after - 2 * i).when(kind == "abs", 2 * i)
    marker = F.when(kind.isin("name1", "name2"), i % 2).otherwise(0)
    x = x.withColumns({"idx": F.row_number().over(w) - 1, "opcode": F.coalesce("op", F.lit("Unsupported")), "symbol": symbol, "secondary_symbol": F.when(kind == "pair", at("derefs", i % 16)), "jump_target": jump, "handler": F.when(kind == "setup", after + 2 * i)})
    x = x.withColumns({
        "jump_on_true": F.when(F.col("opcode") == "ConditionalBranch", F.col("name").isin("POP_JUMP_IF_TRUE", "POP_JUMP_IF_NONE", "JUMP_IF_TRUE_OR_POP")), "clears": F.coalesce(F.col("name") == "LOAD_FAST_AND_CLEAR", F.lit(False)),
        "stack_in": effect(F.col("stack_in_rule"), F.col("arg")) + F.when(F.col("name") == "CALL_KW", 1).otherwise(0), "stack_out": effect(F.col("stack_out_rule"), F.col("arg")) + marker,
        "const_kind": F.when(kind == "const", at("const_kinds", i)), "const_text": F.when(kind == "const", at("const_texts", i)),
    })
    x = x.withColumns({
        "keyword_names": F.when(F.col("name").isin("CALL_KW", "CALL_FUNCTION_KW"), F.split(F.lag("const_text").over(w), "\x1f")), "import_level": F.when(F.col("opcode") == "ImportModule", F.lag("const_text", 2).over(w).cast("int")),
        "has_fromlist": F.when(F.col("opcode") == "ImportModule", F.lag("const_kind", 1).over(w) == "strings"),
    })
    return x.select("code_id", "idx", "off", "name", "opcode", i.alias("operand"), "symbol", "secondary_symbol", "jump_target", "jump_on_true", "clears", "stack_in", "stack_out", "const_kind", "const_text", "keyword_names", "import_level", "has_fromlist", "handler")


def exception_regions(codes: DataFrame) -> DataFrame:
    """Regions of (code_id, exception_table): entries of four big-endian numbers of six bits a byte: start, size, handler in units, depth and lasti."""
    n = F.length("exception_table")
    b = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: byte(F.col("exception_table"), i))
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("now"))
    numbers = F.aggregate(b, start, lambda s, x: F.struct(
        F.when(x.bitwiseAND(F.lit(64)) == 0, F.concat(s["done"], F.array(s["now"] * 64 + x.bitwiseAND(F.lit(63))))).otherwise(s["done"]).alias("done"),
        F.when(x.bitwiseAND(F.lit(64)) == 0, 0).otherwise(s["now"] * 64 + x.bitwiseAND(F.lit(63))).alias("now")), lambda s: s["done"])
    rows = codes.where(n > 0).select("code_id", numbers.alias("v")).withColumn("k", F.explode(F.sequence(F.lit(0), (F.size("v") / 4).cast("int") - 1)))
    v = lambda j: F.get("v", F.col("k") * 4 + j)
    return rows.select("code_id", (v(0) * 2).alias("start_off"), ((v(0) + v(1)) * 2).alias("end_off"), (v(2) * 2).alias("handler_off"), F.shiftright(v(3), 1).alias("stack_depth"), (1 + v(3) % 2).alias("exc_items"), (v(3) % 2 == 1).alias("push_lasti"))
