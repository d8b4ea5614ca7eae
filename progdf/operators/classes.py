"""Classes, receivers and dispatch as relations: bases, metaclasses, constructors, super, properties, protocol methods, fallbacks.

All inputs are relations of the points-to analysis and of the lowered programs; every rule is a join or an aggregate, so rules run for
all classes and sites at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import binding


def class_bases(arguments: DataFrame, points_to: DataFrame, class_objects: DataFrame) -> DataFrame:
    """(class, base, place): bases of a class from the arguments (class, pos, keyword, value) of the call that builds it.

    Every class that an argument points to is a base, each once, at its first place; what the metaclass keyword points to is none.
    """
    hit = arguments.join(points_to, "value").join(class_objects.select("object", F.col("class").alias("base")), "object")
    meta = hit.where("keyword = 'metaclass'").select("class", "base").distinct()
    return hit.groupBy("class", "base").agg(F.min("pos").alias("place")).join(meta, ["class", "base"], "left_anti")


def metaclasses(arguments: DataFrame, points_to: DataFrame, class_objects: DataFrame) -> DataFrame:
    """(class, meta): the least class that the metaclass keyword of the construction points to."""
    hit = arguments.where("keyword = 'metaclass'").join(points_to, "value").join(class_objects.select("object", F.col("class").alias("meta")), "object")
    return hit.groupBy("class").agg(F.min("meta").alias("meta"))


def super_members(bases: DataFrame, members: DataFrame) -> DataFrame:
    """(class, name, owner): what super() of a class finds: members (class, name, owner) of its bases (class, base, place), the first base first, its own left out."""
    up = bases.join(members.select(F.col("class").alias("base"), "name", "owner"), "base")
    return up.groupBy("class", "name").agg(F.min_by("owner", "place").alias("owner"))


def constructor_calls(sites: DataFrame, class_objects: DataFrame, instances: DataFrame, members: DataFrame, metas: DataFrame) -> DataFrame:
    """(site, name, class, owner): methods that a call of an object runs, by sites (site, object).

    A class runs __init__ of its own or its bases' and __call__ of its metaclass, an instance (object, class) __call__ of its class.
    """
    built = sites.join(class_objects.select("object", "class"), "object")
    init = built.select("site", F.lit("__init__").alias("name"), "class")
    meta = built.join(metas, "class").select("site", F.lit("__call__").alias("name"), F.col("meta").alias("class"))
    own = sites.join(instances.select("object", "class"), "object").select("site", F.lit("__call__").alias("name"), "class")
    return init.unionByName(meta).unionByName(own).join(members.select("class", "name", "owner"), ["class", "name"]).select("site", "name", "class", "owner").distinct()


def receivers(calls: DataFrame) -> DataFrame:
    """(site, class, context, object): the receiver that a construction (site, class, context array) allocates, one for each site, class and context."""
    key = F.concat_ws("/", F.col("site").cast("string"), F.col("class").cast("string"), F.array_join(F.col("context").cast("array<string>"), ">"))
    return calls.select("site", "class", "context").distinct().withColumn("object", F.concat(F.lit("instance "), key))


def properties(decorations: DataFrame) -> DataFrame:
    """(class, name, getter, setter, deleter): the last function of each kind from (class, name, kind, function, place); a setter without a getter is no property."""
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("function")), F.when(F.col("kind") == k, F.col("place"))).alias(k)
    return decorations.groupBy("class", "name").agg(last("getter"), last("setter"), last("deleter")).where("getter IS NOT NULL")


def property_calls(accesses: DataFrame, props: DataFrame) -> DataFrame:
    """(site, function): what attribute accesses (site, class, name, access) of properties call; access is load, store or delete."""
    f = F.when(F.col("access") == "load", F.col("getter")).when(F.col("access") == "store", F.col("setter")).otherwise(F.col("deleter"))
    return accesses.join(props, ["class", "name"]).select("site", f.alias("function")).where("function IS NOT NULL").distinct()


def receiver_facts(pointed: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(object, method, available, defers) of receivers' protocol methods.

    pointed: (object, class) of the receivers; fields: (class, method, function); methods: (function, may_defer). A method is
    available where the class has it, and defers unless all of its functions surely return a result. The functions of a class are
    looked at once, not for each of its receivers.
    """
    own = fields.join(methods, "function", "left").groupBy("class", "method").agg(F.max(F.coalesce("may_defer", F.lit(True))).alias("defers"))
    return pointed.join(own, "class").groupBy("object", "method").agg(F.lit(True).alias("available"), F.max("defers").alias("defers"))


def dispatched(sites: DataFrame, pointed: DataFrame, facts: DataFrame) -> DataFrame:
    """(site, object, methods, unresolved): methods that protocol sites (site, kind, wanted, value) call on each receiver, and the wanted ones that it lacks.

    pointed: (value, object). facts: receiver_facts().
    """
    have = facts.groupBy("object").agg(F.array_sort(F.collect_set("method")).alias("there"), F.array_sort(F.collect_set(F.when(F.col("defers"), F.col("method")))).alias("giving"))
    none = F.array().cast("array<string>")
    x = sites.join(pointed, "value").join(have, "object", "left").withColumns({"there": F.coalesce("there", none), "giving": F.coalesce("giving", none)})
    return x.select("site", "object", binding.selected(F.col("kind"), F.col("wanted"), F.col("there"), F.col("giving")).alias("methods"), F.array_except("wanted", "there").alias("unresolved"))


def fallbacks(sites: DataFrame) -> DataFrame:
    """(site, rule): how an unresolved call gets its result.

    sites: site and what its callee may be: is_class, is_super, is_decorator (gives its argument back), is_property, external (a
    builtin's name). The first that holds decides; else the result is a new object and the unknown.
    """
    rule = F.when(F.col("is_class"), "instance").when(F.col("is_super"), "proxy").when(F.col("is_decorator"), "argument").when(F.col("is_property"), "property").when(F.col("external").isNotNull(), F.concat(F.lit("builtin "), F.col("external")))
    return sites.select("site", F.coalesce(rule, F.lit("object and unknown")).alias("rule"))


def external_attributes(demand: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, name, qualified): attributes that loads (module, name) ask external modules (module) for, each once."""
    return demand.join(modules.select("module").distinct(), "module", "left_semi").select("module", "name").distinct().withColumn("qualified", F.concat_ws(".", "module", "name"))


def captures(closures: DataFrame, points_to: DataFrame, cells: DataFrame) -> DataFrame:
    """copy constraints (src, dst): every closure object feeds its body's cells, whether or not the call was seen before.

    closures: (object, body, slot, value) of created functions; points_to: (value, object) of callees; cells: (body, slot, cell).
    """
    live = closures.join(points_to.select("object").distinct(), "object", "left_semi")
    return live.join(cells, ["body", "slot"]).select(F.col("value").alias("src"), F.col("cell").alias("dst")).distinct()


def merged_groups(groups: DataFrame) -> DataFrame:
    """(site, operation, methods, external): groups (site, place, operation, methods, external) of a site as one.

    Any group wins over DynamicCall, different operations become DynamicProtocol, methods are united in order, eight at most, and
    different externals become none.
    """
    real = F.when(F.col("operation") != "DynamicCall", F.col("operation"))
    listed = F.array_sort(F.collect_list(F.struct("place", "methods")))
    # whether all are the same shows in the least and the greatest, without rows for each distinct count
    x = groups.groupBy("site").agg(F.min(real).alias("one"), F.max(real).alias("other"), listed.alias("listed"), F.min("external").alias("external"), F.max("external").alias("last"))
    operation = F.when(F.col("one").isNull(), "DynamicCall").when(F.col("one") == F.col("other"), F.col("one")).otherwise("DynamicProtocol")
    methods = F.slice(F.array_distinct(F.flatten(F.transform("listed", lambda s: s["methods"]))), 1, binding.METHODS_AT_MOST)
    return x.select("site", operation.alias("operation"), methods.alias("methods"), F.when(F.col("external") == F.col("last"), F.col("external")).alias("external"))


def may_defer(instr: DataFrame) -> DataFrame:
    """(code_id, may_defer): may a program return NotImplemented? Surely not only where each return follows a constant that is another.

    instr: code_id, idx, opcode, const_text.
    """
    w = Window.partitionBy("code_id").orderBy("idx")
    x = instr.select("code_id", "opcode", F.lag("opcode").over(w).alias("before"), F.lag("const_text").over(w).alias("const"))
    doubt = F.when(F.col("opcode") == "Return", ~F.coalesce((F.col("before") == "LoadConst") & (F.coalesce("const", F.lit("")) != "NotImplemented"), F.lit(False)))
    return x.groupBy("code_id").agg(F.coalesce(F.max(doubt), F.lit(True)).alias("may_defer"))


def may_miss(instr: DataFrame) -> DataFrame:
    """(code_id, may_miss): may a __getattribute__ program miss an attribute that exists? Surely not only where nothing is raised, nothing
    is called but the default (is_default), and each return follows a constant or that call.

    instr: code_id, idx, opcode, is_default.
    """
    w = Window.partitionBy("code_id").orderBy("idx")
    default = F.coalesce("is_default", F.lit(False))
    x = instr.select("code_id", "opcode", default.alias("is_default"), F.lag("opcode").over(w).alias("before"), F.lag(default).over(w).alias("was"))
    fine = F.coalesce((F.col("before") == "LoadConst") | ((F.col("before") == "Call") & F.col("was")), F.lit(False))
    doubt = F.when(F.col("opcode") == "Raise", True).when(F.col("opcode") == "Call", ~F.col("is_default")).when(F.col("opcode") == "Return", ~fine)
    some = F.max((F.col("opcode") == "Return"))
    return x.groupBy("code_id").agg((F.coalesce(F.max(doubt), F.lit(False)) | ~some).alias("may_miss"))


#: Parts of a sensitivity.
SENSITIVITIES = ("flow", "context", "path")


def sensitivity(codes: DataFrame, level: str, chosen: DataFrame | None = None) -> DataFrame:
    """(code, flow, context, path): what the analysis of each code object tells apart.

    level: insensitive, selective or complete. chosen: (code, flow, context, path) for the selective level; path implies flow.
    ValueError for another level, or chosen codes at another level.
    """
    if level not in ("insensitive", "selective", "complete"):
        raise ValueError(f"level {level}")
    if level != "selective" and chosen is not None and not chosen.isEmpty():
        raise ValueError("code objects are chosen at the selective level alone")
    every = lambda v: codes.select("code", *[F.lit(v).alias(k) for k in SENSITIVITIES])
    if level != "selective" or chosen is None:
        return every(level == "complete")
    x = codes.select("code").join(chosen, "code", "left")
    on = {k: F.coalesce(k, F.lit(False)) for k in SENSITIVITIES}
    return x.select("code", (on["flow"] | on["path"]).alias("flow"), on["context"].alias("context"), on["path"].alias("path"))


def sensitivity_violations(codes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(problem, code): chosen codes that are reserved, absent, repeated, or without any part."""
    bad = lambda df, text: df.select(F.lit(text).alias("problem"), "code")
    out = bad(chosen.where("code = 0"), "reserved").unionByName(bad(chosen.where("code <> 0").join(codes.select("code"), "code", "left_anti"), "absent"))
    many = chosen.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    return out.unionByName(bad(many, "repeated")).unionByName(bad(chosen.where("NOT (coalesce(flow, false) OR coalesce(context, false) OR coalesce(path, false))"), "empty")).distinct()


def entry_functions(codes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, code, problem) of wanted entry points (name): the one top-level function of a name; problem tells of none or several.

    codes: (code, name, parent, parent_is_module).
    """
    top = codes.where("parent_is_module").groupBy("name").agg(F.count("*").alias("n"), F.min("code").alias("code"))
    x = names.select("name").distinct().join(top, "name", "left")
    problem = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "several")
    return x.select("name", F.when(problem.isNull(), F.col("code")).alias("code"), problem.alias("problem"))


def looked_up(relation: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing): rows of a relation with the wanted keys, and keys without a row."""
    keys = wanted.select(key).distinct()
    return relation.join(keys, key, "left_semi"), keys.join(relation.select(key).distinct(), key, "left_anti")
