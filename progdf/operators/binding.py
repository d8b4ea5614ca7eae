"""Argument binding and the dispatch rules of Python's protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bodies whose formals are broadcast; those of more are shuffled.
BODIES = 10_000
POSITIONAL = ("positional_only", "positional")


def _with_formals(actuals: DataFrame, formals: DataFrame) -> DataFrame:
    """actuals with `own`, what their body takes: a body's formals are one row, so that no argument is moved to its body's task where bodies are few."""
    places = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("formal_pos"))))
    named = F.collect_set(F.when(F.col("kind").isin("positional", "keyword_only"), F.struct("name", "formal_pos")))
    own = formals.groupBy("body").agg(F.struct(
        places(*POSITIONAL).alias("positional"), named.alias("named"), places("varargs").alias("varargs"), places("kwargs").alias("kwargs"), F.array_sort(F.collect_set("formal_pos")).alias("every")).alias("own"))
    few = own.limit(BODIES + 1).count() <= BODIES
    return actuals.join(F.broadcast(own) if few else own, "body")


def _filled() -> Column:
    """Formals that an argument with `own` fills, in an array."""
    c = F.col
    first = lambda *sets: F.coalesce(*[F.when(F.size(s) > 0, s) for s in sets], c("own.every"))
    direct = F.when(F.array_contains(c("own.positional"), c("pos")), F.array("pos"))
    named = F.transform(F.filter("own.named", lambda f: f["name"] == c("keyword")), lambda f: f["formal_pos"])
    known = F.when(c("keyword").isNull(), F.coalesce(direct, first(c("own.varargs")))).otherwise(first(named, c("own.kwargs")))
    return F.when(c("expanded"), c("own.every")).when(~c("expanded"), known)


def bind(actuals: DataFrame, formals: DataFrame) -> DataFrame:
    """(site, pos, formal_pos), each once.

    actuals: (site, body, pos, keyword, expanded): keyword is null for a positional argument, expanded marks sites whose arguments
    are not known one by one. formals: (body, formal_pos, name, kind) with kind positional_only, positional, keyword_only, varargs or kwargs.
    Positional arguments fill positional formals in order, the rest goes to *args or, without one, to every formal. A keyword
    goes to the formal of its name, else to **kwargs, else to every formal. Expanded sites bind everything to everything.
    """
    return _with_formals(actuals, formals).select("site", "pos", F.explode(_filled()).alias("formal_pos")).distinct()


def adjust_receiver(bound: DataFrame, sites: DataFrame) -> DataFrame:
    """Bindings of sites (site, bound_method) that call a bound method without naming its receiver move one formal on."""
    return bound.join(sites, "site").withColumn("formal_pos", F.col("formal_pos") + F.col("bound_method").cast("int")).drop("bound_method")


def missing_defaults(bound: DataFrame, sites: DataFrame, formals: DataFrame) -> DataFrame:
    """(site, body, formal_pos) of positional formals that no argument of a site (site, body) fills."""
    want = sites.join(formals.where(F.col("kind").isin(*POSITIONAL)), "body").select("site", "body", "formal_pos")
    return want.join(bound.select("site", "formal_pos").distinct(), ["site", "formal_pos"], "left_anti")


def missing(actuals: DataFrame, formals: DataFrame) -> DataFrame:
    """missing_defaults() of the sites of actuals and of what bind() gives for them, each once, in one pass: a site is one row with what it fills."""
    a = _with_formals(actuals, formals).select("site", "body", "own.positional", _filled().alias("filled"))
    at = a.groupBy("site").agg(F.collect_set(F.struct("body", "positional")).alias("bodies"), F.flatten(F.collect_set("filled")).alias("filled"))
    at = at.select("site", F.explode("bodies").alias("of"), "filled")
    return at.select("site", "of.body", F.explode(F.array_except("of.positional", "filled")).alias("formal_pos"))


# Fixed values of Python's data model.
BINARY = ("add", "and", "floordiv", "lshift", "matmul", "mul", "mod", "or", "pow", "rshift", "sub", "truediv", "xor")
COMPARISONS = {"lt": "gt", "le": "ge", "eq": "eq", "ne": "ne", "gt": "lt", "ge": "le"}
BUILTINS = {
    "bool": ("Truth", ("bool", "len")), "float": ("Conversion", ("float",)), "format": ("Format", ("format",)), "hash": ("Hash", ("hash",)), "int": ("Conversion", ("int",)), "str": ("Conversion", ("str",)),
    "len": ("Length", ("len",)), "iter": ("Iteration", ("iter",)), "next": ("Iteration", ("next",)), "reversed": ("Iteration", ("reversed",)),
    **{k: ("DynamicCall", ()) for k in ("__import__", "input", "eval", "exec", "map", "range", "super")},
}
OPERATIONS = {
    "EnterContext": ("ContextEnter", ("enter",)), "LoadAttribute": ("AttributeLoad", ("getattribute", "getattr", "get")), "StoreAttribute": ("AttributeStore", ("setattr", "set")), "ImportModule": ("Import", ("import",)),
    "ImportAttribute": ("AttributeLoad", ("getattribute",)), "LoadElement": ("ItemLoad", ("getitem",)), "StoreElement": ("ItemStore", ("setitem",)), "StoreCollectionElement": ("ItemStore", ("setitem",)), "DeleteElement": ("ItemDelete", ("delitem",)),
    "ConditionalBranch": ("Truth", ("bool", "len")), "Generic": ("DynamicProtocol", ()), "BuildCollection": ("DynamicProtocol", ()), "UnpackCollection": ("DynamicProtocol", ()), "Suspend": ("None", ()), "Yield": ("None", ()),
}
FAMILIES = {
    "Generic": "DynamicOperation", "BuildCollection": "DynamicOperation", "UnpackCollection": "DynamicOperation", "EnterContext": "DynamicOperation", "LoadAttribute": "AttributeAccess", "StoreAttribute": "AttributeAccess",
    "ImportModule": "Import", "ImportAttribute": "Import", "LoadElement": "ItemAccess", "StoreElement": "ItemAccess", "StoreCollectionElement": "ItemAccess", "DeleteElement": "ItemAccess", "ConditionalBranch": "Truthiness",
}
METHODS_AT_MOST = 8


def _map(entries: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


def family(op: Column) -> Column:
    """Protocol family of an operation; None has no call site."""
    return F.coalesce(F.try_element_at(_map({k: F.lit(v) for k, v in FAMILIES.items()}), op), F.lit("None"))


def operation(op: Column) -> Column:
    return F.coalesce(F.try_element_at(_map({k: F.lit(v[0]) for k, v in OPERATIONS.items()}), op), F.lit("DynamicCall"))


def candidates(op: Column) -> Column:
    """Methods that an operation may call."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(_map({k: F.array(*map(F.lit, v[1])).cast("array<string>") for k, v in OPERATIONS.items()}), op), none)


def builtin(name: Column) -> tuple[Column, Column]:
    """(operation, methods) of a call of a builtin; null for another name."""
    return (
        F.try_element_at(_map({k: F.lit(v[0]) for k, v in BUILTINS.items()}), name),
        F.try_element_at(_map({k: F.array(*map(F.lit, v[1])).cast("array<string>") for k, v in BUILTINS.items()}), name),
    )


def method_set(*sets: Column) -> Column:
    """Union in order of first occurrence, cut to the eight that a set holds."""
    return F.slice(F.array_distinct(F.concat(*sets)), 1, METHODS_AT_MOST)


def without(methods: Column, one: Column) -> Column:
    return F.array_remove(methods, one)


def binary_methods(operand: Column) -> Column:
    """Methods of a binary operand: 0 to 12 direct and reflected, 13 to 25 in place first; getitem for 26."""
    direct = F.element_at(F.array(*map(F.lit, BINARY)), (operand % 13 + 1).cast("int"))
    pair = F.array(direct, F.concat(F.lit("r"), direct))
    return F.when(operand == 26, F.array(F.lit("getitem"))).when(operand >= 13, F.concat(F.array(F.concat(F.lit("i"), direct)), pair)).otherwise(pair)


def comparison_methods(operand: Column) -> Column:
    names = list(COMPARISONS)
    one = F.element_at(F.array(*map(F.lit, names)), (operand + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(COMPARISONS[n]) for n in names]), (operand + 1).cast("int"))
    return F.when(operand.between(0, 5), F.array_distinct(F.array(one, other))).otherwise(F.array().cast("array<string>"))


def selected(kind: Column, wanted: Column, available: Column, defers: Column) -> Column:
    """Methods that are called of the wanted ones: truth takes bool before len; a dynamic operation all that are there; comparisons,
    arithmetic and in-place forms the first one that is there and, while one may give up, the next."""
    there = F.filter(wanted, lambda m: F.array_contains(available, m))
    chain = F.aggregate(there, F.struct(F.array().cast("array<string>").alias("got"), F.lit(True).alias("go")), lambda s, m: F.struct(
        F.when(s["go"], F.concat(s["got"], F.array(m))).otherwise(s["got"]).alias("got"), (s["go"] & F.array_contains(defers, m)).alias("go")), lambda s: s["got"])
    return F.when(kind == "truth", F.slice(there, 1, 1)).when(kind == "dynamic", there).otherwise(chain)


def attribute_methods(load: Column, member: Column, may_miss: Column, known: Column, available: Column) -> Column:
    """Methods of an attribute access: of an unknown receiver all; a load has getattribute, a descriptor where the member exists and getattr where it may miss."""
    every = F.when(load, F.array(*map(F.lit, ("getattribute", "get", "getattr")))).otherwise(F.array(*map(F.lit, ("setattr", "set"))))
    one = lambda c, m: F.when(c, F.array(F.lit(m))).otherwise(F.array().cast("array<string>"))
    loads = F.concat(F.array(F.lit("getattribute")), one(member, "get"), one(may_miss, "getattr"))
    stores = F.concat(F.array(F.lit("setattr")), one(member, "set"))
    return F.when(~known, every).otherwise(F.filter(F.when(load, loads).otherwise(stores), lambda m: F.array_contains(available, m)))
