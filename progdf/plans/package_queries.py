"""Package-level queries over encoded tables: dependence kernels, calls found on the fly, classes and dispatch, names, sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from progdf.functions.scratch import saved
from progdf.operators import binding as B
from progdf.operators import callgraph as G
from progdf.operators import cfg, classes, ddg, decode, evaluate, pta
from progdf.sources import ingest

from . import encodings as X
from .encodings import table

# --- points-to


def _parts(spark, d):
    """(s, p): suppliers and the parts that they deliver."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()


def _held(spark, d) -> dict:
    """Suppliers' objects hold parts in fields by the part's number modulo 7."""
    x = _parts(spark, d)
    return {"address": x.select((F.col("s") * 10 + 1).alias("value"), (F.col("s") + 1).alias("object")).distinct(), "field_address": x.select((F.col("s") + 1).alias("base"), (F.col("p") % 7 + 1).alias("field"), (F.col("p") + 1000000).alias("object"))}


def _loaded(solution):
    return solution.per_value(F.count("*").alias("n"), F.sum("object").alias("total")).where("value % 10 = 3")


def pta_field_addresses(spark, d):
    """Parts whose addresses stand in fields, read by one field, or by any for every fourth supplier."""
    load = _parts(spark, d).select((F.col("s") * 10 + 1).alias("base"), F.when(F.col("s") % 4 == 0, 0).otherwise(F.col("s") % 7 + 1).alias("field"), (F.col("s") * 10 + 3).alias("dst")).distinct()
    return _loaded(pta.solution(pta.Constraints(spark, {**_held(spark, d), "field_load": load}), widen=False))


def pta_keyed_loads(spark, d):
    """The same, read by keys: six of nine keys name a field, the others read any, and every thirteenth supplier has no key."""
    held, s = _held(spark, d), _parts(spark, d).select("s").distinct()
    key = s.where("s % 13 <> 0").select((F.col("s") * 10 + 2).alias("value"), (F.col("s") % 9 + 9000000).alias("object"))
    load = s.select((F.col("s") * 10 + 1).alias("base"), (F.col("s") * 10 + 2).alias("key"), (F.col("s") * 10 + 3).alias("dst"))
    fields = spark.range(6).select((F.col("id") + 9000000).alias("object"), (F.col("id") + 1).alias("field"))
    return _loaded(pta.solution(pta.Constraints(spark, {**held, "address": held["address"].unionByName(key), "keyed_load": load, "key_field": fields}), widen=False))


# --- calls


def cg_on_the_fly(spark, d):
    """Customers are functions, orders their call sites: most call a customer by its number, those of number 1 modulo 25 what the function was given.

    Fewer than one in a function on the average, so that what functions are given does not grow to all functions.
    """
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n = c.agg(F.max("c_custkey").alias("top"))
    o = o.select("o_orderkey", "o_custkey").crossJoin(F.broadcast(n))
    direct = F.col("o_orderkey") % 25 != 1
    callee, actual = (F.col("o_orderkey") * 7) % F.col("top") + 1, (F.col("o_orderkey") * 13) % F.col("top") + 1
    v = lambda col, k: F.col(col) * 10 + k
    address = o.where(direct).select(v("o_orderkey", 1).alias("value"), callee.alias("object")).unionByName(o.select(v("o_orderkey", 2).alias("value"), actual.alias("object")))
    sites = o.select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("caller"), F.when(direct, v("o_orderkey", 1)).otherwise(v("o_custkey", 5)).alias("callee"))
    none = lambda s: spark.createDataFrame([], s)
    edges, _ = G.on_the_fly(
        pta.Constraints(spark, {"address": address}), sites, c.select(F.col("c_custkey").alias("object"), F.col("c_custkey").alias("code")), c.select(F.col("c_custkey").alias("body"), F.lit(0).alias("pos"), v("c_custkey", 5).alias("value")),
        none("body long, value long"), o.select(F.col("o_orderkey").alias("site"), F.lit(0).alias("pos"), v("o_orderkey", 2).alias("value")), none("site long, value long"), c.where("c_custkey IN (1, 4, 7)").select(F.col("c_custkey").alias("code")),
    )
    return edges.select("site", "caller", F.coalesce("target", F.lit(0)).alias("target"))


def cg_contexts(spark, d):
    """Call strings of order lines, two sites deep."""
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), "l_suppkey", "l_partkey").distinct()
    return x.select("site", "l_suppkey", "l_partkey", F.array_join(G.contexts(F.col("site"), F.array("l_suppkey", "l_partkey")).cast("array<string>"), ">").alias("context"))


def cg_path_variants(spark, d):
    """Decisions on a customer's guards, none to five of them on three locals."""
    k = F.col("c_custkey") % 6
    guards = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), lambda i: F.concat(F.lit("v"), ((F.col("c_custkey") * i) % 3).cast("string"))))
    out = G.path_variants(table(spark, d, "customer").select(F.col("c_custkey").alias("code_id"), guards.alias("guards")))
    return out.select("code_id", "variant", F.array_join(F.transform("decision", lambda x: F.coalesce(x.cast("string"), F.lit("?"))), ",").alias("decision"))


def _registered(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_suppkey").alias("code"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("place"))


def cg_conflicts(spark, d):
    return G.callable_conflicts(_registered(spark, d))


def cg_assigned(spark, d):
    return G.assigned(_registered(spark, d), "place")


def star_imports(spark, d):
    """Nations import all of their region, regions all of the next one; suppliers name what is defined."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    r = lambda c: F.concat(F.lit("r"), c.cast("string"))
    pairs = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("module"), r(F.col("n_regionkey")).alias("source")).unionByName(n.select(r(F.col("n_regionkey")).alias("module"), r((F.col("n_regionkey") + 1) % 5).alias("source")).distinct())
    name = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "_").otherwise(""), F.lit("m"), (F.col("s_suppkey") % 17).cast("string"))
    module = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).otherwise(r(F.col("s_nationkey") % 5))
    return G.star_imports(pairs, s.select(module.alias("module"), name.alias("name")).distinct())


def unresolved_globals(spark, d):
    i = X.instructions(spark, d).select((F.col("code_id") % 40).alias("module"), F.concat("symbol", (F.col("idx") % 9).cast("string")).alias("name"), "opcode")
    return G.unresolved_globals(i.where("opcode = 'LoadLocal'").select("module", "name").distinct(), i.where("opcode = 'StoreLocal' AND module % 3 <> 0"))


def qualified_names(spark, d):
    """Customers within the customer before, 48 deep, then by thirds; every fifth is a lambda and every seventh an implicit frame."""
    k = F.col("c_custkey")
    parent = F.when(k == 1, 0).when(k <= 48, k - 1).otherwise(F.floor(k / 3))
    name = F.when(k % 5 == 0, "<lambda>").when(k % 7 == 0, "<listcomp>").otherwise(F.concat(F.lit("f"), k.cast("string")))
    return G.qualified_names(table(spark, d, "customer").where("c_custkey > 0").select(k.alias("code_id"), parent.cast("long").alias("parent_id"), name.alias("name"), k.alias("place")))


def inherited_deep(spark, d):
    """Customers as classes in chains of 36; their orders name members."""
    k = F.col("c_custkey")
    cls = table(spark, d, "customer").where(k % 36 != 0).select(k.alias("class"), (k - 1).alias("base"), F.lit(0).alias("place"))  # the first of a chain has no base
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("class"), F.concat(F.lit("m"), (F.col("o_orderkey") % 101).cast("string")).alias("name")).distinct()
    return G.inherited(cls, own)


# --- classes and dispatch


def _construction(spark, d):
    """Order lines as arguments of classes (orders): suppliers point to classes by number, a keyword now and then."""
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    args = line.select(F.col("l_orderkey").alias("class"), F.col("l_linenumber").alias("pos"), F.when((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 4 == 0), "metaclass").alias("keyword"), F.col("l_suppkey").alias("value"))
    points = line.select(F.col("l_suppkey").alias("value"), (F.col("l_suppkey") * 3 + F.col("l_linenumber") % 2).alias("object")).distinct()
    return args, points, o.select(F.col("o_orderkey").alias("object"), F.col("o_orderkey").alias("class"))


def class_bases(spark, d):
    return classes.class_bases(*_construction(spark, d))


def class_metaclasses(spark, d):
    return classes.metaclasses(*_construction(spark, d))


def _members(spark, d):
    """Classes are parts; their bases the parts of half and third the number; members by supplier."""
    p = table(spark, d, "part")
    bases = p.select(F.col("p_partkey").alias("class"), F.posexplode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3))).alias("place", "base")).where("base > 0 AND base <> class")
    members = _parts(spark, d).select(F.col("p").alias("class"), F.concat(F.lit("m"), (F.col("s") % 6).cast("string")).alias("name"), F.col("p").alias("owner")).distinct()
    return bases, members


def super_members(spark, d):
    return classes.super_members(*_members(spark, d))


def constructor_calls(spark, d):
    """Calls of order lines: parts as classes, suppliers as instances of parts."""
    line = table(spark, d, "lineitem")
    site = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site")
    of_part, of_supplier = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    sites = line.select(site, of_part("l_partkey").alias("object")).unionByName(line.select(site, of_supplier("l_suppkey").alias("object"))).distinct()
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    members = p.select(F.col("p_partkey").alias("class"), F.when(F.col("p_partkey") % 3 == 0, "__call__").otherwise("__init__").alias("name"), (F.col("p_partkey") % 7).alias("owner"))
    metas = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("class"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("meta"))
    instances = s.select(of_supplier("s_suppkey").alias("object"), (F.col("s_suppkey") * 2).alias("class"))
    return classes.constructor_calls(sites, p.select(of_part("p_partkey").alias("object"), F.col("p_partkey").alias("class")), instances, members, metas)


def constructor_receivers(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), F.col("l_partkey").alias("class"), F.array("l_suppkey").alias("context"))
    return classes.receivers(x).select("site", "class", "object")


def _decorations(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "getter").when(F.col("l_returnflag") == "N", "setter").otherwise("deleter")
    place = F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("class"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("name"), kind.alias("kind"), F.col("l_partkey").alias("function"), place.alias("place"))


def property_models(spark, d):
    return classes.properties(_decorations(spark, d))


def property_calls(spark, d):
    o = table(spark, d, "orders")
    n = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("top"))
    access = F.when(F.col("o_orderkey") % 3 == 0, "load").when(F.col("o_orderkey") % 3 == 1, "store").otherwise("delete")
    a = o.crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("site"), (F.col("o_orderkey") % F.col("top") + 1).alias("class"), F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("name"), access.alias("access"))
    return classes.property_calls(a, classes.properties(_decorations(spark, d)))


def _receiver_facts(spark, d):
    """Suppliers are receivers of the class of their nation; parts are functions, those of even number may give up."""
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    pointed = s.select(F.col("s_suppkey").alias("object"), F.col("s_nationkey").alias("class"))
    method = F.element_at(F.array(*[F.lit(m) for m in ("add", "radd", "iadd", "eq", "bool", "len")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    fields = p.where("p_size % 3 = 0").select((F.col("p_partkey") % 25).alias("class"), method.alias("method"), F.col("p_partkey").alias("function"))
    return pointed, classes.receiver_facts(pointed, fields, p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("function"), (F.col("p_partkey") % 2 == 0).alias("may_defer")))


def receiver_facts(spark, d):
    return _receiver_facts(spark, d)[1]


def protocol_targets(spark, d):
    """Order lines add suppliers in place, or test them."""
    pointed, facts = _receiver_facts(spark, d)
    line = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), F.col("l_suppkey").alias("value")).distinct()
    even = F.col("site") % 2 == 0
    sites = line.select("site", "value", F.when(even, "inplace").otherwise("truth").alias("kind"), F.when(even, F.array(F.lit("iadd"), F.lit("add"), F.lit("radd"))).otherwise(F.array(F.lit("bool"), F.lit("len"))).alias("wanted"))
    out = classes.dispatched(sites, pointed.select(F.col("object").alias("value"), "object"), facts)
    return out.select("site", "object", F.array_join("methods", ",").alias("methods"), F.array_join("unresolved", ",").alias("unresolved"))


def call_fallbacks(spark, d):
    p = table(spark, d, "part")
    x = p.select(F.col("p_partkey").alias("site"), (F.col("p_size") % 7 == 0).alias("is_class"), (F.col("p_size") % 5 == 0).alias("is_super"), (F.col("p_size") % 3 == 0).alias("is_decorator"), (F.col("p_size") % 2 == 0).alias("is_property"), F.when(F.col("p_size") % 11 == 0, F.lit("len")).alias("external"))
    return classes.fallbacks(x)


def external_attributes(spark, d):
    line = table(spark, d, "lineitem")
    demand = line.select(F.concat(F.lit("m"), (F.col("l_suppkey") % 9).cast("string")).alias("module"), F.concat(F.lit("a"), (F.col("l_partkey") % 50).cast("string")).alias("name"))
    return classes.external_attributes(demand, table(spark, d, "region").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("module")))


def closure_captures(spark, d):
    """Suppliers are closures over parts; the callees point to every third."""
    x = _parts(spark, d)
    closures = x.select(F.col("s").alias("object"), (F.col("s") % 10).alias("body"), (F.col("p") % 4).alias("slot"), (F.col("p") + 5000).alias("value"))
    points = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("value"), F.col("s_suppkey").alias("object"))
    cells = spark.range(40).select((F.col("id") % 10).alias("body"), F.floor(F.col("id") / 10).cast("long").alias("slot"), (F.col("id") + 900).alias("cell")).where("slot < 3")
    return classes.captures(closures, points, cells)


def merged_groups(spark, d):
    """Groups of an order's lines."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    op = F.when(F.col("s") % 3 == 0, "DynamicCall").when(F.col("p") % 5 == 0, "Iteration").otherwise("Length")
    methods = F.array(F.concat(F.lit("m"), (F.col("s") % 13).cast("string")), F.concat(F.lit("m"), (F.col("p") % 13).cast("string")))
    out = classes.merged_groups(line.select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("place"), op.alias("operation"), methods.alias("methods"), F.when(F.col("s") % 4 == 0, F.concat(F.lit("e"), (F.col("p") % 2).cast("string"))).alias("external")))
    return out.select("site", "operation", F.array_join("methods", ",").alias("methods"), "external")


def _returns(spark, d):
    i = X.instructions(spark, d)
    op = F.when((F.col("opcode") == "Branch") & (F.col("k") % 10 == 0), "Raise").when((F.col("opcode") == "StoreLocal") & (F.col("k") % 12 == 0), "Call").otherwise(F.col("opcode"))
    return i.where("code_id % 7 <> 3 OR idx < n - 1").select("code_id", "idx", op.alias("opcode"), F.when((F.col("opcode") == "LoadConst") & (F.col("k") % 3 == 0), "NotImplemented").alias("const_text"), (F.col("k") % 24 == 0).alias("is_default"))


def may_defer(spark, d):
    return classes.may_defer(_returns(spark, d))


def may_miss(spark, d):
    return classes.may_miss(_returns(spark, d))


def _chosen(spark, d):
    return table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("code"), (F.col("o_orderkey") % 2 == 0).alias("flow"), (F.col("o_orderkey") % 3 == 0).alias("context"), (F.col("o_orderkey") % 7 == 0).alias("path"))


def sensitivity(spark, d):
    one = _chosen(spark, d).groupBy("code").agg(*[F.max(k).alias(k) for k in classes.SENSITIVITIES])
    return classes.sensitivity(table(spark, d, "customer").select(F.col("c_custkey").alias("code")), "selective", one)


def sensitivity_violations(spark, d):
    return classes.sensitivity_violations(table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("code")), _chosen(spark, d)).groupBy("problem").agg(F.count("*").alias("n"))


def entry_functions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.concat(F.lit("f"), (F.col("c_custkey") % 97).cast("string")).alias("name"), F.lit(1).alias("parent"), (F.col("c_custkey") % 9 == 0).alias("parent_is_module"))
    return classes.entry_functions(c, table(spark, d, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 120).cast("string")).alias("name")))


# --- binding and protocol rules


def bound_receivers(spark, d):
    line = table(spark, d, "lineitem")
    bound = line.select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") - 1).alias("formal_pos")).distinct()
    return B.adjust_receiver(bound, bound.select("site").distinct().withColumn("bound_method", F.col("site") % 3 == 0))


def builtin_dispatch(spark, d):
    names = ("len", "str", "range", "iter", "bool", "open", "hash", "next", "eval", "print", "float")
    x = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")).alias("name"))
    op, methods = B.builtin(F.col("name"))
    return x.select("p_partkey", "name", F.coalesce(op, F.lit("-")).alias("operation"), F.coalesce(F.array_join(methods, ","), F.lit("")).alias("methods"))


def attribute_methods(spark, d):
    s = F.col("p_size")
    pick = lambda c, m: F.when(c, F.array(F.lit(m))).otherwise(F.array().cast("array<string>"))
    there = F.concat(pick(s % 2 == 0, "getattribute"), pick(s % 3 == 0, "get"), pick(s % 5 == 0, "getattr"), pick(s % 7 < 3, "setattr"), pick(s % 7 > 3, "set"))
    p = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.array_join(B.attribute_methods(p % 2 == 0, p % 3 == 0, p % 5 < 2, p % 7 > 0, there), ",").alias("methods"))


def method_sets(spark, d):
    m = lambda k: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("m"), ((F.col("p_partkey") * i + k) % 9).cast("string")))
    return table(spark, d, "part").select("p_partkey", F.array_join(B.without(B.method_set(m(0), m(4)), F.lit("m3")), ",").alias("methods"))


# --- decoding

#: Opcodes of the encoded programs, one of each kind of operand, stack rule and jump.
LIFTED = (
    "NOP", "LOAD_CONST", "LOAD_FAST", "LOAD_FAST_AND_CLEAR", "STORE_FAST", "LOAD_GLOBAL", "LOAD_NAME", "LOAD_FAST_LOAD_FAST", "STORE_FAST_LOAD_FAST", "LOAD_ATTR", "LOAD_SUPER_ATTR", "BUILD_LIST", "BUILD_MAP", "BUILD_CONST_KEY_MAP", "UNPACK_SEQUENCE",
    "UNPACK_EX", "IMPORT_NAME", "CALL", "CALL_KW", "CALL_FUNCTION_EX", "JUMP_FORWARD", "JUMP_BACKWARD", "POP_JUMP_IF_TRUE", "POP_JUMP_IF_FALSE", "FOR_ITER", "RETURN_CONST", "RAISE_VARARGS", "COMPARE_OP",
)


def lifted(spark, d):
    """Each user's events as wordcode of 3.13, an opcode and its argument from k, some with a prefix, some of an unknown opcode."""
    import opcode

    i = X.instructions(spark, d)
    numbers = F.array(*[F.lit(opcode.opmap[n]) for n in LIFTED])
    op = F.when(F.col("k") % 17 == 0, decode.EXTENDED_ARG).when(F.col("k") % 19 == 0, 254).otherwise(F.element_at(numbers, (F.col("k") % len(LIFTED) + 1).cast("int")))
    op = F.when(F.col("idx") == F.col("n") - 1, opcode.opmap["RETURN_CONST"]).otherwise(op)
    pair = F.concat(F.lpad(F.hex(op), 2, "0"), F.lpad(F.hex((F.col("k") * 7) % 23), 2, "0"))
    codes = i.groupBy("code_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", pair.alias("h")))), lambda s: s["h"]), "")).alias("code"))
    names = lambda p, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.concat(F.lit(p), x.cast("string")))
    kinds = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: F.element_at(F.array(F.lit("int"), F.lit("str"), F.lit("strings")), (x % 3 + 1).cast("int")))
    codes = codes.withColumns({"names": names("n", 9), "locals": names("l", 8), "derefs": names("l", 12), "const_kinds": kinds, "const_texts": names("", 20)})
    out = decode.lift(decode.wordcode(codes), codes, decode.dimension(spark))
    return out.select("code_id", "idx", "off", "opcode", "operand", "symbol", "secondary_symbol", "jump_target", "jump_on_true", "clears", "stack_in", "stack_out", "const_kind", "const_text", F.array_join("keyword_names", ",").alias("keywords"), "has_fromlist")


def exception_tables(spark, d):
    """Order lines as entries of exception tables, coded in six bits a byte and decoded again."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("code_id"), "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), "l_partkey").distinct()

    def coded(v, first):
        """A number in bytes of six bits, the most significant first; bit 6 tells of a further byte, bit 7 of an entry's first."""
        at = lambda k: F.shiftright(v, 6 * k).bitwiseAND(F.lit(63))
        one = lambda k: at(k) + F.lit(64 if k else 0) + F.lit(0)
        mark = F.lit(128 if first else 0)
        h = lambda c: F.lpad(F.hex(c), 2, "0")
        # as many bytes as the number needs; an int has six at most
        long = lambda k: F.concat(h(one(k) + mark), *[h(one(j)) for j in range(k - 1, -1, -1)])
        out = long(0)
        for k in range(1, 6):
            out = F.when(v >= 64**k, long(k)).otherwise(out)
        return out

    start, size = (F.col("l_linenumber") * 700 + F.col("q")).cast("int"), (F.col("l_suppkey") % 90 + 1).cast("int")
    handler, flags = (F.col("l_partkey") * 3).cast("int"), (F.col("q") % 12).cast("int")
    entry = F.concat(coded(start, True), coded(size, False), coded(handler, False), coded(flags, False))
    rows = line.groupBy("code_id").agg(F.unhex(F.array_join(F.array_sort(F.collect_set(entry)), "")).alias("exception_table"))
    return decode.exception_regions(rows)


# --- dependence


def _programs(spark, d):
    """Each user's events as statements of two to five instructions that leave the stack empty; jumps lead to statements."""
    i = X.instructions(spark, d)
    call = F.col("opcode").isin("ConditionalBranch") & (F.col("k") % 4 == 3)
    kind = F.when(call, "call").when(F.col("opcode") == "ConditionalBranch", "cond").when(F.col("opcode") == "LoadLocal", "view").when(F.col("opcode") == "StoreLocal", "store").when(F.col("opcode") == "LoadConst", "unpack").when(F.col("opcode") == "Branch", "jump").otherwise("end")
    one = lambda op, name=None, sin=0, sout=0, operand=0, symbol=None, jump=False: F.struct(F.lit(op).alias("opcode"), F.lit(name or op).alias("name"), F.lit(sin).alias("stack_in"), F.lit(sout).alias("stack_out"), F.lit(operand).alias("operand"), (F.lit(None).cast("string") if symbol is None else symbol).alias("symbol"), F.lit(jump).alias("jumps"))
    v, g = F.col("symbol"), F.concat(F.lit("g"), (F.col("k") % 3).cast("string"))
    const, pop, load = one("LoadConst", None, 0, 1), one("Pop", "POP_TOP", 1), one("LoadLocal", None, 0, 1, symbol=v)
    body = (
        F.when(F.col("kind") == "view", F.array(load, pop)).when(F.col("kind") == "store", F.array(const, one("StoreLocal", None, 1, 0, symbol=v))).when(F.col("kind") == "unpack", F.array(const, one("UnpackCollection", None, 1, 2, 2), pop, pop))
        .when(F.col("kind") == "jump", F.array(one("Branch", jump=True))).when(F.col("kind") == "cond", F.array(load, one("ConditionalBranch", None, 1, 0, jump=True)))
        .when(F.col("kind") == "call", F.array(one("LoadGlobal", None, 0, 1, symbol=g), one("Marker", None, 0, 1), load, one("Call", "CALL", 3, 1, 1), pop)).otherwise(F.array(const, one("Return", None, 1)))
    )
    x = i.withColumn("kind", kind).select("code_id", F.col("idx").alias("event"), "jump_target", "jump_on_true", F.posexplode(body).alias("slot", "s"))
    w = Window.partitionBy("code_id").orderBy("event", "slot")
    return x.select(
        "code_id", (F.row_number().over(w) - 1).alias("idx"), (F.col("event") * 20 + F.col("slot") * 2).alias("off"), "s.opcode", "s.name", "s.operand", "s.symbol", F.lit(None).cast("string").alias("secondary_symbol"), F.lit(False).alias("clears"),
        "s.stack_in", "s.stack_out", F.lit(None).cast("string").alias("const_text"), F.when(F.col("s.jumps"), F.col("jump_target") * 10).alias("jump_target"), F.when(F.col("s.opcode") == "ConditionalBranch", F.col("jump_on_true")).alias("jump_on_true"),
    )


def _records(spark, d):
    placed = saved(cfg.with_blocks(_programs(spark, d)), "placed")
    return saved(ddg.fragments(placed, cfg.edges(placed)), "records")  # read more than once


def _named(records, column):
    """Inputs by name, other definitions by number."""
    n = ddg.nodes(records).where("kind = 'Input'").select("code_id", F.col("node").alias(column), F.concat(F.lit("input "), "label").alias("_name"))
    return lambda df: df.join(n, ["code_id", column], "left").withColumn(column, F.coalesce("_name", F.col(column).cast("string"))).drop("_name")


def ddg_edges(spark, d):
    r = _records(spark, d)
    return _named(r, "src")(ddg.edges(r)).select("code_id", "src", "dst", "kind").distinct()


def ddg_node_kinds(spark, d):
    return ddg.nodes(_records(spark, d)).groupBy("code_id", "kind").agg(F.count("*").alias("n"))


def ddg_arguments(spark, d):
    """What calls are given, by place."""
    r = _records(spark, d)
    a = r.where("record = 'argument'").select("code_id", F.col("a").alias("site"), F.col("b").alias("src"), F.col("kind").alias("pos"))
    return _named(r, "src")(a).select("code_id", "site", "src", "pos").distinct()


def ddg_stitched(spark, d):
    """Orders call customers with their lines as arguments; parts are what comes back."""
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    calls = o.select(F.col("o_orderkey").alias("site"), (F.col("o_custkey") % 50).alias("body"), (F.col("o_orderkey") + 7000000).alias("result"))
    actuals = line.select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") + 8000000).alias("node")).distinct()
    formals = o.select((F.col("o_custkey") % 50).alias("body"), (F.col("o_custkey") % 4 + 1).alias("pos"), (F.col("o_custkey") + 9000000).alias("node")).distinct()
    returns = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("body"), F.col("p_partkey").alias("node")).where("node % 3 = 0")
    targets, sets = ddg.stitched_sets(calls, actuals, formals, returns)
    return ddg.by_set(targets, sets.groupBy("set").agg(F.count("*").alias("n"), F.sum("src").alias("total")))


def ddg_context_transitions(spark, d):
    e = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("source"), (F.col("l_partkey") % 20).alias("target"), F.col("l_returnflag").alias("kind"))
    c = table(spark, d, "nation").select((F.col("n_nationkey") % 20).alias("code"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("ctx"))
    return ddg.context_transitions(e, c)


def coverage_levels(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", ddg.coverage(p % 7 == 0, p % 5 == 0, p % 3 > 0).alias("flow"), G.coverage(F.col("p_size") % 4, p % 2).alias("calls"))


# --- sources


def _artifacts(spark, d):
    """Documents as compiled files: the path by number, the magic from the first letters."""
    name = F.concat(F.lit("a/b/c"), (F.col("doc_id") % 3).cast("string"), F.lit("/m"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".cpython-312"), F.lit(".pypy-39"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit(".pyc"))
    content = F.col("text").cast("binary")
    return table(spark, d, "documents").where("text IS NOT NULL").select(name.alias("path"), name.alias("rel"), content.alias("content"), F.length(content).cast("long").alias("size"))


def artifact_inventory(spark, d):
    return ingest.inventory(_artifacts(spark, d)).select("path", "package", "size", "sha256", "magic")


def artifact_classes(spark, d):
    inv = ingest.inventory(_artifacts(spark, d))
    magics = spark.createDataFrame([(b"The ".hex(), "3.12"), (b"Of t".hex(), "3.13")], "magic string, version string")
    return ingest.classified(inv, magics).groupBy("classification").agg(F.count("*").alias("n"))


def directive_comments(spark, d):
    """Turns of conversations as lines, every third with a directive."""
    tag = F.element_at(F.array(F.lit("EXPECT"), F.lit("FORBID"), F.lit("TAGS")), (F.col("turn") % 3 + 1).cast("int"))
    line = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit("x = 1  # "), tag, F.lit(": a"), F.col("turn").cast("string"), F.lit(" -> b  "))).otherwise(F.lit("# EXPECTED nothing"))
    return ingest.directives(table(spark, d, "conversations").select(F.col("conv_id").alias("path"), line.alias("line")))


def process_memory(spark, d):
    """Memory of customers' process trees: each is the child of that of a quarter of its number."""
    k = F.col("c_custkey")
    return evaluate.process_trees(table(spark, d, "customer").where("c_custkey > 0").select(k.alias("pid"), F.floor(k / 4).cast("long").alias("ppid"), (k % 1000).alias("rss")))


def catalog_statistics(spark, d):
    p = table(spark, d, "part")
    return evaluate.catalog_statistics(p.select(F.col("p_partkey").alias("case"), F.col("p_brand").alias("category"), (F.col("p_size") % 5).alias("expected"), (F.col("p_size") % 3).alias("negative")))


def catalog_violations(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") - F.col("p_partkey") % 2).alias("case"), F.when(F.col("p_size") % 9 > 0, F.col("p_brand")).alias("category"), (F.col("p_size") % 5).alias("expected"), (F.col("p_size") % 3).alias("negative"))
    return evaluate.catalog_violations(p).groupBy("problem").agg(F.count("*").alias("n"))


def component_completion(spark, d):
    o = table(spark, d, "orders")
    return evaluate.completion(o.select(F.col("o_orderpriority").alias("component"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status")), "component", "status")


def ablation_metrics(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderstatus").alias("variant"), F.col("o_custkey").alias("case"), F.count("*").over(Window.partitionBy("o_custkey", "o_orderstatus")).alias("facts")).distinct()
    return evaluate.ablation(runs, "variant", "case", "facts", "F")


QUERIES = {f.__name__: f for f in (
    pta_field_addresses, pta_keyed_loads, cg_on_the_fly, cg_contexts, cg_path_variants, cg_conflicts, cg_assigned, star_imports, unresolved_globals, qualified_names, inherited_deep, class_bases, class_metaclasses, super_members,
    constructor_calls, constructor_receivers, property_models, property_calls, receiver_facts, protocol_targets, call_fallbacks, external_attributes, closure_captures, merged_groups, may_defer, may_miss, sensitivity, sensitivity_violations,
    entry_functions, bound_receivers, builtin_dispatch, attribute_methods, method_sets, lifted, exception_tables, ddg_edges, ddg_node_kinds, ddg_arguments, ddg_stitched, ddg_context_transitions, coverage_levels, artifact_inventory,
    artifact_classes, directive_comments, process_memory, catalog_statistics, catalog_violations, component_completion, ablation_metrics,
)}

_ORDERS = """o AS (SELECT o_orderkey AS site, o_custkey AS caller, o_orderkey % 25 <> 1 AS direct, o_orderkey * 7 % top + 1 AS callee, o_orderkey * 13 % top + 1 AS actual FROM orders, (SELECT max(c_custkey) AS top FROM customer))"""
_CONSTRUCTION = """hit AS (SELECT l_orderkey AS class, l_linenumber AS pos, CASE WHEN l_linenumber = 3 AND l_orderkey % 4 = 0 THEN 'metaclass' END AS keyword, o_orderkey AS base FROM lineitem
  JOIN (SELECT DISTINCT l_suppkey AS v, l_suppkey * 3 + l_linenumber % 2 AS object FROM lineitem) ON v = l_suppkey JOIN orders ON o_orderkey = object)"""
_DECOR = """dec AS (SELECT l_suppkey AS class, 'p' || (l_partkey % 3) AS name, CASE l_returnflag WHEN 'A' THEN 'getter' WHEN 'N' THEN 'setter' ELSE 'deleter' END AS kind, l_partkey AS f,
  l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 AS place FROM lineitem),
props AS (SELECT class, name, arg_max(f, place) FILTER (WHERE kind = 'getter') AS getter, arg_max(f, place) FILTER (WHERE kind = 'setter') AS setter, arg_max(f, place) FILTER (WHERE kind = 'deleter') AS deleter FROM dec GROUP BY class, name HAVING count(*) FILTER (WHERE kind = 'getter') > 0)"""
_FACTS = """facts AS (SELECT s_suppkey AS object, ['add','radd','iadd','eq','bool','len'][p_partkey % 6 + 1] AS method, bool_or(p_partkey % 11 = 0 OR p_partkey % 2 = 0) AS defers
  FROM supplier JOIN part ON p_partkey % 25 = s_nationkey AND p_size % 3 = 0 GROUP BY 1, 2)"""
_RETURNS = """rets AS (SELECT code_id, idx, CASE WHEN opcode = 'Branch' AND k % 10 = 0 THEN 'Raise' WHEN opcode = 'StoreLocal' AND k % 12 = 0 THEN 'Call' ELSE opcode END AS op, opcode = 'LoadConst' AND k % 3 = 0 AS ni, k % 24 = 0 AS dflt
  FROM instr WHERE code_id % 7 <> 3 OR idx < n - 1), prev AS (SELECT *, lag(op) OVER w AS before, lag(ni) OVER w AS was_ni, lag(dflt) OVER w AS was_default FROM rets WINDOW w AS (PARTITION BY code_id ORDER BY idx))"""
_CHOSEN = """chosen AS (SELECT o_custkey AS code, o_orderkey % 2 = 0 AS flow, o_orderkey % 3 = 0 AS context, o_orderkey % 7 = 0 AS path FROM orders WHERE o_orderkey % 5 = 0)"""
_PROGRAM = f"""{X.instructions_sql()}, ev2 AS (SELECT *, CASE WHEN opcode = 'ConditionalBranch' AND k % 4 = 3 THEN 'call' WHEN opcode = 'ConditionalBranch' THEN 'cond' WHEN opcode = 'LoadLocal' THEN 'view' WHEN opcode = 'StoreLocal' THEN 'store'
  WHEN opcode = 'LoadConst' THEN 'unpack' WHEN opcode = 'Branch' THEN 'jump' ELSE 'end' END AS kind FROM instr),
sized AS (SELECT *, CASE kind WHEN 'jump' THEN 1 WHEN 'unpack' THEN 4 WHEN 'call' THEN 5 ELSE 2 END AS size FROM ev2),
p AS (SELECT *, 4 * (sum(size) OVER (PARTITION BY code_id ORDER BY idx) - size)::BIGINT AS place FROM sized),
flow AS (SELECT code_id, idx AS a, jump_target // 2 AS b FROM p WHERE kind IN ('jump', 'cond') UNION SELECT code_id, idx, idx + 1 FROM p WHERE kind NOT IN ('jump', 'end')),
defs AS (SELECT DISTINCT code_id, 0 AS event, symbol, -1::BIGINT AS def FROM (SELECT DISTINCT code_id FROM p), (SELECT unnest(['v0', 'v1', 'v2', 'v3']) AS symbol)
  UNION SELECT d.code_id, f.b, d.symbol, CASE WHEN p.kind = 'store' AND p.symbol = d.symbol THEN p.place + 4 ELSE d.def END FROM defs d JOIN flow f ON f.code_id = d.code_id AND f.a = d.event JOIN p ON p.code_id = d.code_id AND p.idx = d.event),
live AS (SELECT p.* FROM p JOIN (SELECT DISTINCT code_id, event FROM defs) e ON e.code_id = p.code_id AND e.event = p.idx),
loads AS (SELECT l.code_id, l.kind, l.place + CASE l.kind WHEN 'call' THEN 8 ELSE 0 END AS load, CASE WHEN d.def < 0 THEN 'input ' || l.symbol ELSE d.def::VARCHAR END AS src FROM live l JOIN defs d ON d.code_id = l.code_id AND d.event = l.idx AND d.symbol = l.symbol WHERE l.kind IN ('view', 'cond', 'call'))"""
ORACLES = {
    "pta_field_addresses": "SELECT s * 10 + 3 AS value, count(*) AS n, sum(p + 1000000)::BIGINT AS total FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) WHERE s % 4 = 0 OR p % 7 = s % 7 GROUP BY s",
    "pta_keyed_loads": "SELECT s * 10 + 3 AS value, count(*) AS n, sum(p + 1000000)::BIGINT AS total FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) WHERE s % 13 <> 0 AND (s % 9 >= 6 OR p % 7 = s % 9) GROUP BY s",
    # a code reached (object 0), or what its formal points to
    "cg_on_the_fly": f"""WITH RECURSIVE {_ORDERS}, r AS (SELECT c_custkey AS code, 0::BIGINT AS object FROM customer WHERE c_custkey IN (1, 4, 7)
  UNION SELECT u.code, u.object FROM r JOIN o ON o.caller = r.code AND ((o.direct AND r.object = 0) OR (NOT o.direct AND r.object > 0)), LATERAL (SELECT CASE WHEN o.direct THEN o.callee ELSE r.object END AS code, unnest([0, o.actual]) AS object) u)
SELECT site, caller, callee AS target FROM o JOIN (SELECT DISTINCT code FROM r) ON code = caller WHERE direct
UNION SELECT site, caller, r.object FROM o JOIN r ON r.code = caller AND r.object > 0 WHERE NOT direct
UNION SELECT site, caller, 0 FROM o JOIN (SELECT code FROM r GROUP BY code HAVING max(object) = 0) ON code = caller WHERE NOT direct""",
    "cg_contexts": "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS site, l_suppkey, l_partkey, (l_orderkey * 10 + l_linenumber) || '>' || l_suppkey AS context FROM lineitem",
    "cg_path_variants": """WITH g AS (SELECT c_custkey AS code_id, c_custkey % 6 AS k, CASE WHEN c_custkey % 6 <= 4 THEN (1 << (c_custkey % 6)::INT) ELSE 1 END AS n FROM customer),
v AS (SELECT *, unnest(range(0, n))::INT AS variant FROM g), b AS (SELECT *, unnest(range(1, k + 1)) AS i FROM v WHERE k > 0), x AS (SELECT *, (code_id * i) % 3 AS guard, CASE WHEN k > 4 THEN NULL ELSE (variant >> (i - 1)::INT) % 2 = 1 END AS yes FROM b)
SELECT code_id, variant, string_agg(coalesce(yes::VARCHAR, '?'), ',' ORDER BY i) AS decision FROM x GROUP BY code_id, variant HAVING NOT EXISTS (SELECT 1 FROM x y JOIN x z ON z.code_id = y.code_id AND z.variant = y.variant AND z.guard = y.guard AND z.yes <> y.yes WHERE y.code_id = x.code_id AND y.variant = x.variant)
UNION ALL SELECT code_id, variant, '' FROM v WHERE k = 0""",
    "cg_conflicts": "SELECT l_partkey AS object, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "cg_assigned": "SELECT l_partkey AS object, arg_max(l_suppkey, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey) AS code FROM lineitem GROUP BY 1",
    "star_imports": """WITH RECURSIVE pairs AS (SELECT 'n' || n_nationkey AS module, 'r' || n_regionkey AS source FROM nation UNION SELECT 'r' || n_regionkey, 'r' || ((n_regionkey + 1) % 5) FROM nation),
names AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_nationkey ELSE 'r' || (s_nationkey % 5) END AS module, CASE WHEN s_suppkey % 5 = 0 THEN '_' ELSE '' END || 'm' || (s_suppkey % 17) AS name FROM supplier),
r AS (SELECT module, name, module AS source FROM names WHERE name NOT LIKE '\\_%' ESCAPE '\\' UNION SELECT p.module, r.name, r.source FROM r JOIN pairs p ON p.source = r.module WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.module = p.module AND n.name = r.name))
SELECT * FROM r WHERE module <> source""".replace("\\\\", "\\"),
    "unresolved_globals": f"""WITH {X.instructions_sql()}, x AS (SELECT code_id % 40 AS module, symbol || (idx % 9) AS name, opcode FROM instr)
SELECT DISTINCT module, name FROM x WHERE opcode = 'LoadLocal' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.opcode = 'StoreLocal' AND y.module % 3 <> 0 AND y.module = x.module AND y.name = x.name)""",
    "qualified_names": """WITH RECURSIVE c AS (SELECT c_custkey AS k, CASE WHEN c_custkey = 1 THEN 0 WHEN c_custkey <= 48 THEN c_custkey - 1 ELSE c_custkey // 3 END AS up FROM customer WHERE c_custkey > 0),
n AS (SELECT *, CASE WHEN k % 5 = 0 THEN '<lambda' || row_number() OVER (PARTITION BY up, k % 5 = 0 ORDER BY k) || '>' WHEN k % 7 = 0 THEN NULL ELSE 'f' || k END AS name FROM c),
r AS (SELECT k, coalesce(name, '') AS q FROM n WHERE up = 0 UNION ALL SELECT n.k, CASE WHEN name IS NULL THEN r.q WHEN r.q = '' THEN name ELSE r.q || '.' || name END FROM n JOIN r ON r.k = n.up) SELECT k AS code_id, q AS qualified FROM r""",
    "inherited_deep": """WITH own AS (SELECT DISTINCT o_custkey AS class, 'm' || (o_orderkey % 101) AS name FROM orders), up AS (SELECT class FROM own UNION SELECT c_custkey FROM customer)
SELECT u.class, o.name, max(o.class) AS owner FROM up u JOIN own o ON o.class // 36 = u.class // 36 AND o.class <= u.class GROUP BY u.class, o.name""",
    "class_bases": f"WITH {_CONSTRUCTION} SELECT class, base, min(pos) AS place FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit m WHERE m.class = h.class AND m.base = h.base AND m.keyword = 'metaclass') GROUP BY class, base",
    "class_metaclasses": f"WITH {_CONSTRUCTION} SELECT class, min(base) AS meta FROM hit WHERE keyword = 'metaclass' GROUP BY class",
    "super_members": """WITH m AS (SELECT DISTINCT l_partkey AS class, 'm' || (l_suppkey % 6) AS name FROM lineitem), b AS (SELECT p_partkey AS class, p_partkey // 2 AS base, 0 AS place FROM part UNION ALL SELECT p_partkey, p_partkey // 3, 1 FROM part)
SELECT b.class, m.name, min_by(m.class, b.place) AS owner FROM b JOIN m ON m.class = b.base WHERE b.base > 0 AND b.base <> b.class GROUP BY b.class, m.name""",
    "constructor_calls": """WITH s AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS site, l_partkey AS p, l_suppkey * 2 AS i FROM lineitem), m AS (SELECT p_partkey AS class, CASE WHEN p_partkey % 3 = 0 THEN '__call__' ELSE '__init__' END AS name, p_partkey % 7 AS owner FROM part),
c AS (SELECT site, '__init__' AS name, p AS class FROM s UNION SELECT site, '__call__', p - p % 3 FROM s WHERE p % 4 = 0 UNION SELECT site, '__call__', i FROM s) SELECT DISTINCT c.site, c.name, c.class, m.owner FROM c JOIN m USING (class, name)""",
    "constructor_receivers": "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS site, l_partkey AS class, 'instance ' || (l_orderkey * 10 + l_linenumber) || '/' || l_partkey || '/' || l_suppkey AS object FROM lineitem",
    "property_models": f"WITH {_DECOR} SELECT * FROM props",
    "property_calls": f"""WITH {_DECOR}, a AS (SELECT o_orderkey AS site, o_orderkey % top + 1 AS class, 'p' || (o_custkey % 3) AS name, o_orderkey % 3 AS k FROM orders, (SELECT max(s_suppkey) AS top FROM supplier))
SELECT DISTINCT site, CASE k WHEN 0 THEN getter WHEN 1 THEN setter ELSE deleter END AS function FROM a JOIN props USING (class, name) WHERE CASE k WHEN 0 THEN getter WHEN 1 THEN setter ELSE deleter END IS NOT NULL""",
    "receiver_facts": f"WITH {_FACTS} SELECT object, method, true AS available, defers FROM facts",
    "protocol_targets": f"""WITH {_FACTS}, l AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS site, l_suppkey AS object FROM lineitem), w AS (SELECT *, CASE WHEN site % 2 = 0 THEN ['iadd', 'add', 'radd'] ELSE ['bool', 'len'] END AS wanted FROM l),
h AS (SELECT w.*, coalesce((SELECT list(method) FROM facts f WHERE f.object = w.object), []) AS there, coalesce((SELECT list(method) FROM facts f WHERE f.object = w.object AND f.defers), []) AS giving FROM w),
t AS (SELECT *, list_filter(wanted, lambda m: list_contains(there, m)) AS ok FROM h)
SELECT site, object, array_to_string(CASE WHEN site % 2 = 1 THEN ok[1:1] ELSE ok[1:CASE WHEN len(ok) = 0 OR NOT list_contains(giving, ok[1]) THEN 1 WHEN len(ok) = 1 OR NOT list_contains(giving, ok[2]) THEN 2 ELSE 3 END] END, ',') AS methods,
  array_to_string(list_filter(wanted, lambda m: NOT list_contains(there, m)), ',') AS unresolved FROM t""",
    "call_fallbacks": "SELECT p_partkey AS site, CASE WHEN p_size % 7 = 0 THEN 'instance' WHEN p_size % 5 = 0 THEN 'proxy' WHEN p_size % 3 = 0 THEN 'argument' WHEN p_size % 2 = 0 THEN 'property' WHEN p_size % 11 = 0 THEN 'builtin len' ELSE 'object and unknown' END AS rule FROM part",
    "external_attributes": "SELECT DISTINCT 'm' || (l_suppkey % 9) AS module, 'a' || (l_partkey % 50) AS name, 'm' || (l_suppkey % 9) || '.a' || (l_partkey % 50) AS qualified FROM lineitem WHERE l_suppkey % 9 IN (SELECT r_regionkey FROM region)",
    "closure_captures": "SELECT DISTINCT l_partkey + 5000 AS src, 10 * (l_partkey % 4) + l_suppkey % 10 + 900 AS dst FROM lineitem WHERE l_suppkey % 3 = 0 AND l_partkey % 4 < 3",
    "merged_groups": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), g AS (SELECT *, CASE WHEN s % 3 = 0 THEN NULL WHEN p % 5 = 0 THEN 'Iteration' ELSE 'Length' END AS op, CASE WHEN s % 4 = 0 THEN 'e' || (p % 2) END AS ext FROM l),
m AS (SELECT l_orderkey, unnest(['m' || (s % 13), 'm' || (p % 13)]) AS m, unnest([2 * l_linenumber, 2 * l_linenumber + 1]) AS place FROM l), f AS (SELECT l_orderkey, m, min(place) AS place FROM m GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS r FROM f)
SELECT g.l_orderkey AS site, CASE count(DISTINCT op) WHEN 0 THEN 'DynamicCall' WHEN 1 THEN min(op) ELSE 'DynamicProtocol' END AS operation, (SELECT string_agg(t.m, ',' ORDER BY t.place) FROM t WHERE t.l_orderkey = g.l_orderkey AND t.r <= 8) AS methods, CASE WHEN count(DISTINCT ext) = 1 THEN min(ext) END AS external FROM g GROUP BY g.l_orderkey""",
    "may_defer": f"WITH {X.instructions_sql()}, {_RETURNS} SELECT code_id, coalesce(bool_or(NOT coalesce(before = 'LoadConst' AND NOT was_ni, false)) FILTER (WHERE op = 'Return'), true) AS may_defer FROM prev GROUP BY code_id",
    "may_miss": f"""WITH {X.instructions_sql()}, {_RETURNS} SELECT code_id, bool_or(op = 'Raise' OR (op = 'Call' AND NOT dflt) OR (op = 'Return' AND NOT coalesce(before = 'LoadConst' OR (before = 'Call' AND was_default), false))) OR NOT bool_or(op = 'Return') AS may_miss FROM prev GROUP BY code_id""",
    "sensitivity": f"WITH {_CHOSEN}, x AS (SELECT code, bool_or(flow) AS flow, bool_or(context) AS context, bool_or(path) AS path FROM chosen GROUP BY code) SELECT c_custkey AS code, coalesce(flow OR path, false) AS flow, coalesce(context, false) AS context, coalesce(path, false) AS path FROM customer LEFT JOIN x ON code = c_custkey",
    "sensitivity_violations": f"""WITH {_CHOSEN} SELECT 'absent' AS problem, count(DISTINCT code) AS n FROM chosen WHERE code <> 0 AND (code % 3 = 0 OR code NOT IN (SELECT c_custkey FROM customer)) HAVING count(*) > 0 UNION ALL SELECT 'reserved', 1 FROM chosen WHERE code = 0 HAVING count(*) > 0
UNION ALL SELECT 'repeated', count(*) FROM (SELECT code FROM chosen GROUP BY code HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'empty', count(DISTINCT code) FROM chosen WHERE NOT (flow OR context OR path) HAVING count(*) > 0""",
    "entry_functions": """WITH t AS (SELECT 'f' || (c_custkey % 97) AS name, count(*) AS n, min(c_custkey) AS code FROM customer WHERE c_custkey % 9 = 0 GROUP BY 1)
SELECT w.name, CASE WHEN n = 1 THEN code END AS code, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' END AS problem FROM (SELECT DISTINCT 'f' || (p_partkey % 120) AS name FROM part) w LEFT JOIN t USING (name)""",
    "bound_receivers": "SELECT DISTINCT l_orderkey AS site, l_linenumber AS pos, l_linenumber - 1 + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS formal_pos FROM lineitem",
    "builtin_dispatch": """WITH b(name, operation, methods) AS (VALUES ('len', 'Length', 'len'), ('str', 'Conversion', 'str'), ('range', 'DynamicCall', ''), ('iter', 'Iteration', 'iter'), ('bool', 'Truth', 'bool,len'), ('hash', 'Hash', 'hash'), ('next', 'Iteration', 'next'), ('eval', 'DynamicCall', ''), ('float', 'Conversion', 'float')),
x AS (SELECT p_partkey, ['len', 'str', 'range', 'iter', 'bool', 'open', 'hash', 'next', 'eval', 'print', 'float'][p_partkey % 11 + 1] AS name FROM part) SELECT p_partkey, name, coalesce(operation, '-') AS operation, coalesce(methods, '') AS methods FROM x LEFT JOIN b USING (name)""",
    "attribute_methods": """WITH x AS (SELECT *, list_filter(['getattribute', CASE WHEN p_partkey % 3 = 0 THEN 'get' END, CASE WHEN p_partkey % 5 < 2 THEN 'getattr' END], lambda m: m IS NOT NULL) AS loads, list_filter(['setattr', CASE WHEN p_partkey % 3 = 0 THEN 'set' END], lambda m: m IS NOT NULL) AS stores,
  list_filter([CASE WHEN p_size % 2 = 0 THEN 'getattribute' END, CASE WHEN p_size % 3 = 0 THEN 'get' END, CASE WHEN p_size % 5 = 0 THEN 'getattr' END, CASE WHEN p_size % 7 < 3 THEN 'setattr' END, CASE WHEN p_size % 7 > 3 THEN 'set' END], lambda m: m IS NOT NULL) AS there FROM part)
SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN ['getattribute', 'get', 'getattr'] ELSE ['setattr', 'set'] END ELSE list_filter(CASE WHEN p_partkey % 2 = 0 THEN loads ELSE stores END, lambda m: list_contains(there, m)) END, ',') AS methods FROM x""",
    "method_sets": """WITH x AS (SELECT p_partkey, unnest(range(0, 10)) AS i FROM part), y AS (SELECT p_partkey, i, 'm' || (CASE WHEN i < 5 THEN p_partkey * (i + 1) % 9 ELSE (p_partkey * (i - 4) + 4) % 9 END) AS m FROM x), z AS (SELECT p_partkey, m, min(i) AS i FROM y GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS r FROM z) SELECT p.p_partkey, coalesce(string_agg(m, ',' ORDER BY i), '') AS methods FROM part p LEFT JOIN t ON t.p_partkey = p.p_partkey AND r <= 8 AND m <> 'm3' GROUP BY p.p_partkey""",
    "exception_tables": """SELECT DISTINCT l_orderkey AS code_id, CAST(2 * (l_linenumber * 700 + CAST(floor(l_quantity) AS INT)) AS INT) AS start_off, CAST(2 * (l_linenumber * 700 + CAST(floor(l_quantity) AS INT) + l_suppkey % 90 + 1) AS INT) AS end_off, CAST(l_partkey * 6 AS INT) AS handler_off,
  CAST(floor(l_quantity) AS INT) % 12 // 2 AS stack_depth, 1 + CAST(floor(l_quantity) AS INT) % 12 % 2 AS exc_items, CAST(floor(l_quantity) AS INT) % 12 % 2 = 1 AS push_lasti FROM lineitem""",
    "ddg_edges": f"""WITH RECURSIVE {_PROGRAM}
SELECT DISTINCT code_id, src, load AS dst, 'DefUse' AS kind FROM loads
UNION SELECT code_id, place::VARCHAR, place + 4, 'Operand' FROM live WHERE kind IN ('view', 'store', 'cond', 'unpack')
UNION SELECT code_id, place::VARCHAR, place + 4, 'ReturnValue' FROM live WHERE kind = 'end'
UNION SELECT code_id, (place + 4)::VARCHAR, place + 5, 'Result' FROM live WHERE kind = 'unpack' UNION SELECT code_id, (place + 5)::VARCHAR, place + 8, 'Operand' FROM live WHERE kind = 'unpack' UNION SELECT code_id, (place + 4)::VARCHAR, place + 12, 'Operand' FROM live WHERE kind = 'unpack'
UNION SELECT code_id, 'input g' || (k % 3), place, 'DefUse' FROM live WHERE kind = 'call' UNION SELECT code_id, place::VARCHAR, place + 12, 'Callee' FROM live WHERE kind = 'call'
UNION SELECT code_id, (place + 8)::VARCHAR, place + 12, 'Operand' FROM live WHERE kind = 'call' UNION SELECT code_id, (place + 12)::VARCHAR, place + 16, 'Operand' FROM live WHERE kind = 'call'""",
    "ddg_arguments": f"WITH RECURSIVE {_PROGRAM} SELECT code_id, place + 12 AS site, (place + 8)::VARCHAR AS src, '0' AS pos FROM live WHERE kind = 'call'",
    "ddg_stitched": """WITH c AS (SELECT o_orderkey AS site, o_custkey % 50 AS body, o_orderkey + 7000000 AS result FROM orders), a AS (SELECT DISTINCT l_orderkey AS site, l_linenumber AS pos, l_partkey + 8000000 AS node FROM lineitem),
f AS (SELECT DISTINCT o_custkey % 50 AS body, o_custkey % 4 + 1 AS pos, o_custkey + 9000000 AS node FROM orders), e AS (SELECT DISTINCT a.node AS src, f.node AS dst, 'DefUse' AS kind FROM c JOIN a USING (site) JOIN f ON f.body = c.body AND f.pos = a.pos
  UNION SELECT p_partkey, c.result, 'Result' FROM c JOIN part ON p_partkey % 50 = c.body AND p_partkey % 3 = 0) SELECT dst, kind, count(*) AS n, sum(src)::BIGINT AS total FROM e GROUP BY dst, kind""",
    "ddg_context_transitions": """SELECT DISTINCT l_suppkey % 20 AS source, l_partkey % 20 AS target, 'c' || a.n_regionkey AS source_ctx, 'c' || b.n_regionkey AS target_ctx, l_returnflag AS kind FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem) JOIN nation a ON a.n_nationkey % 20 = l_suppkey % 20 JOIN nation b ON b.n_nationkey % 20 = l_partkey % 20""",
    "coverage_levels": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN 2 ELSE 0 END AS flow, CASE WHEN p_size % 4 > 0 OR p_partkey % 2 > 0 THEN 2 ELSE 0 END AS calls FROM part",
    "artifact_inventory": """SELECT 'a/b/c' || (doc_id % 3) || '/m' || doc_id || ['.cpython-312', '.pypy-39', ''][doc_id % 3 + 1] || '.pyc' AS path, 'a/b/c' || (doc_id % 3) AS package, octet_length(encode(text)) AS size, sha256(text) AS sha256, lower(left(hex(encode(text)), 8)) AS magic FROM documents WHERE text IS NOT NULL""",
    "artifact_classes": """SELECT CASE WHEN octet_length(encode(text)) < 16 THEN 'invalid' WHEN left(hex(encode(text)), 8) IN (hex(encode('The ')), hex(encode('Of t'))) THEN 'supported' WHEN doc_id % 3 = 1 THEN 'pypy' WHEN doc_id % 3 = 0 THEN 'cpython-other' ELSE 'unknown' END AS classification, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "directive_comments": "SELECT conv_id AS path, ['EXPECT', 'FORBID', 'TAGS'][turn % 3 + 1] AS kind, 'a' || turn || ' -> b' AS value FROM conversations WHERE (conv_id + turn) % 3 = 0",
    "process_memory": """WITH RECURSIVE r AS (SELECT c_custkey AS root, c_custkey AS pid FROM customer WHERE c_custkey > 0 UNION ALL SELECT c.c_custkey, r.pid FROM r JOIN customer c ON c.c_custkey > 0 AND c.c_custkey = r.root // 4) SELECT root AS pid, count(*) AS processes, sum(pid % 1000)::BIGINT AS rss FROM r GROUP BY root""",
    "catalog_statistics": "SELECT CASE WHEN grouping(p_brand) = 1 THEN 'all' ELSE p_brand END AS category, count(DISTINCT p_partkey) AS cases, sum(p_size % 5)::BIGINT AS expected, sum(p_size % 3)::BIGINT AS negative FROM part GROUP BY ROLLUP (p_brand)",
    "catalog_violations": """WITH c AS (SELECT p_partkey - p_partkey % 2 AS case_, p_size AS s FROM part) SELECT 'repeated case' AS problem, count(*) AS n FROM (SELECT case_ FROM c GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'no category', count(DISTINCT case_) FROM c WHERE s % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'no candidate', count(DISTINCT case_) FROM c WHERE s % 15 = 0 HAVING count(*) > 0""",
    "component_completion": "SELECT o_orderpriority AS component, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS share FROM orders GROUP BY 1",
    "ablation_metrics": """WITH r AS (SELECT o_orderstatus AS variant, o_custkey AS c, count(*) AS facts FROM orders GROUP BY 1, 2) SELECT r.variant, count(*) AS cases, sum(r.facts)::BIGINT AS total, sum(b.facts)::BIGINT AS base_total FROM r JOIN r b ON b.c = r.c AND b.variant = 'F' GROUP BY r.variant""",
}


def _lifted_sql() -> str:
    """The same lifting with the rows of the opcode dimension as values."""
    import opcode

    rows = ", ".join(f"({opcode.opmap[n]}, '{n}', '{a}', '{b}', {i}, {o}, {2 if n in decode.CACHED_JUMPS else 0})" for n in LIFTED for a, b, i, o in [decode.OPCODES_313[n]])
    effect = lambda r: f"CASE {r} WHEN -1 THEN arg WHEN -2 THEN 2 * arg WHEN -3 THEN arg + 1 WHEN -4 THEN arg WHEN -5 THEN (arg & 255) + (arg >> 8) + 1 WHEN -7 THEN 3 + arg % 2 WHEN -8 THEN arg + 2 ELSE {r} END"
    name = lambda i: f"CASE WHEN {i} < 9 THEN 'n' || ({i}) END"
    local = lambda i: f"CASE WHEN {i} < 12 THEN 'l' || ({i}) END"
    return f"""WITH {X.instructions_sql()}, b AS (SELECT code_id, idx, CASE WHEN idx = n - 1 THEN {opcode.opmap["RETURN_CONST"]} WHEN k % 17 = 0 THEN {decode.EXTENDED_ARG} WHEN k % 19 = 0 THEN 254 ELSE {[opcode.opmap[n] for n in LIFTED]}[k % {len(LIFTED)} + 1] END AS op, (k * 7) % 23 AS v FROM instr),
g AS (SELECT *, coalesce(max(idx) FILTER (WHERE op <> {decode.EXTENDED_ARG}) OVER (PARTITION BY code_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev FROM b),
e AS (SELECT e.code_id, 2 * (e.prev + 1) AS off, e.op, CAST(sum(p.v * power(256, e.idx - p.idx)) AS BIGINT) AS arg, e.idx - e.prev - 1 AS prefixes FROM g e JOIN b p ON p.code_id = e.code_id AND p.idx > e.prev AND p.idx <= e.idx WHERE e.op <> {decode.EXTENDED_ARG} GROUP BY e.code_id, e.prev, e.idx, e.op),
d(op, name, sem, kind, rin, rout, extra) AS (VALUES {rows}),
x AS (SELECT e.*, d.* EXCLUDE (op), row_number() OVER (PARTITION BY code_id ORDER BY off) - 1 AS idx, CASE WHEN kind = 'const' AND arg < 20 THEN ['int', 'str', 'strings'][arg % 3 + 1] END AS const_kind, CASE WHEN kind = 'const' AND arg < 20 THEN arg::VARCHAR END AS const_text FROM e LEFT JOIN d USING (op))
SELECT code_id, idx, off, coalesce(sem, 'Unsupported') AS opcode, arg AS operand, CASE kind WHEN 'name' THEN {name("arg")} WHEN 'name1' THEN {name("arg >> 1")} WHEN 'name2' THEN {name("arg >> 2")} WHEN 'local' THEN {local("arg")} WHEN 'pair' THEN {local("arg >> 4")} END AS symbol,
  CASE WHEN kind = 'pair' THEN {local("arg % 16")} END AS secondary_symbol, CASE kind WHEN 'jump' THEN off + 2 * prefixes + 2 + extra + 2 * arg WHEN 'back' THEN off + 2 * prefixes + 2 + extra - 2 * arg END AS jump_target,
  CASE WHEN sem = 'ConditionalBranch' THEN name IN ('POP_JUMP_IF_TRUE', 'POP_JUMP_IF_NONE') END AS jump_on_true, coalesce(name = 'LOAD_FAST_AND_CLEAR', false) AS clears, {effect("rin")} + CASE WHEN name = 'CALL_KW' THEN 1 ELSE 0 END AS stack_in,
  {effect("rout")} + CASE WHEN name IN ('LOAD_GLOBAL', 'LOAD_ATTR', 'LOAD_SUPER_ATTR') THEN arg % 2 ELSE 0 END AS stack_out, const_kind, const_text, CASE WHEN name = 'CALL_KW' THEN lag(const_text) OVER w END AS keywords, CASE WHEN sem = 'ImportModule' THEN lag(const_kind) OVER w = 'strings' END AS has_fromlist
FROM x WINDOW w AS (PARTITION BY code_id ORDER BY off)"""


ORACLES["lifted"] = _lifted_sql()
ORACLES["ddg_node_kinds"] = f"""WITH RECURSIVE {_PROGRAM}, per(of, node, k) AS (VALUES ('view', 'Load', 1), ('view', 'Operation', 1), ('store', 'Constant', 1), ('store', 'Store', 1), ('unpack', 'Constant', 1), ('unpack', 'Operation', 4), ('jump', 'Operation', 1), ('cond', 'Load', 1), ('cond', 'Operation', 1),
  ('call', 'Load', 2), ('call', 'Operation', 3), ('end', 'Constant', 1), ('end', 'Return', 1)),
given AS (SELECT code_id, src AS name FROM loads WHERE src LIKE 'input%' UNION SELECT code_id, 'input g' || (k % 3) FROM live WHERE kind = 'call' UNION SELECT code_id, 'input ' || symbol FROM defs GROUP BY code_id, event, symbol HAVING min(def) < 0 AND max(def) >= 0),
every AS (SELECT code_id, per.node AS kind, per.k FROM live JOIN per ON per.of = live.kind UNION ALL SELECT code_id, 'Operation', size FROM p WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.code_id = p.code_id AND l.idx = p.idx) UNION ALL SELECT code_id, 'Input', 1 FROM given)
SELECT code_id, kind, sum(k)::BIGINT AS n FROM every GROUP BY code_id, kind"""
