"""Arguments of many prefixes go beyond an int."""

import opcode

from progdf.operators import decode


def test_an_argument_of_five_prefixes_is_whole(spark):
    code = bytes([decode.EXTENDED_ARG, 1] * 5 + [opcode.opmap["JUMP_FORWARD"], 2, opcode.opmap["LOAD_CONST"], 0])
    rows = [(1, bytearray(code), ["n"], ["l"], ["l"], ["int"], ["7"])]
    codes = spark.createDataFrame(rows, "code_id long, code binary, names array<string>, locals array<string>, derefs array<string>, const_kinds array<string>, const_texts array<string>")
    out = decode.lift(decode.wordcode(codes), codes, decode.dimension(spark)).orderBy("idx").collect()
    arg = sum(256**k for k in range(1, 6)) + 2
    assert [(r.operand, r.jump_target, r.const_text) for r in out] == [(arg, 12 + 2 * arg, None), (0, None, "7")]
