"""From data dependence to points-to constraints and call sites, and the analysis of whole packages.

Definitions are the values of the points-to analysis: definition-use, stores and results are copies, so locals are flow sensitive without
more ado; attributes, elements and collections are fields of objects that allocating instructions create. All rules are joins on the
records of the dependence kernel, for all code objects at once; reachability from the entries decides later which of them count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from progdf.functions.scratch import saved

from . import callgraph, cdg, cfg, ddg, decode, package, pta

#: Values of a code object are numbered within so many.
SPAN = 1 << 26


def value(code: Column, node: Column) -> Column:
    """Id of a definition: the instruction's node, an input or a handler's input of a code object. A code object with more than 2**22 instructions is an error."""
    at = F.when(node >= 1 << 24, F.raise_error(F.lit("a code object has too many instructions for the ids of its values")).cast("long")).when(node >= 0, node).when(node > -(1 << 40), F.lit(1 << 25) - node).otherwise(F.lit(3 << 24) - node - (1 << 40))
    return code.cast("long") * SPAN + at


def extra(code: Column, k: int) -> Column:
    """Id of a value of a code object that is no definition: 1 and 2 what goes to its varargs and kwargs, 3 its module."""
    return code.cast("long") * SPAN + SPAN - k


def field(name: Column) -> Column:
    """Id of a field name; 0 is the summary of all fields."""
    return F.shiftrightunsigned(F.xxhash64(name), 2) + 1


def element(place: Column) -> Column:
    """Id of the field of an element; its names can't be attributes."""
    return field(F.concat(F.lit("[]"), place.cast("string")))


def imported_module(module: Column, is_package: Column, symbol: Column, level: Column, has_names: Column) -> Column:
    """Full name of what IMPORT_NAME gives: relative to the importing module's package, and the top of a dotted name if nothing is taken from it."""
    parts = F.split(module, "\\.")
    up = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    base = F.array_join(F.slice(parts, 1, F.greatest(up, F.lit(0))), ".")
    full = F.when(F.coalesce(level, F.lit(0)) == 0, symbol).otherwise(F.when(symbol == "", base).when(base == "", symbol).otherwise(F.concat(base, F.lit("."), symbol)))
    return F.when((F.coalesce(level, F.lit(0)) == 0) & ~F.coalesce(has_names, F.lit(False)), F.substring_index(symbol, ".", 1)).otherwise(full)


class Lowered:
    """Constraint tables and the relations of calls of all code objects."""

    def __init__(self, codes: DataFrame, lifted: DataFrame, records: DataFrame, unknown: bool = True):
        spark = codes.sparkSession
        e, n_ = saved(ddg.edges(records), "edges"), ddg.nodes(records)
        at = lifted.select("code_id", (F.col("idx") * 4).cast("long").alias("node"), "opcode", "name", "symbol", "secondary_symbol", "operand", "const_kind", "const_text", "stack_out", "keyword_names")
        v = lambda c: value(F.col("code_id"), F.col(c))
        into_ = e.join(at.withColumnRenamed("node", "dst"), ["code_id", "dst"])
        apart = at.where("opcode = 'UnpackCollection'").select("code_id", F.col("node").alias("src"), F.lit("Result").alias("kind"))
        pairs = e.where("kind IN ('DefUse', 'Result')").join(apart, ["code_id", "src", "kind"], "left_anti").select(v("src").alias("src"), v("dst").alias("dst"))
        stores = e.where("kind = 'Operand'").join(at.withColumn("dst", F.explode(F.array("node", F.col("node") + 1))), ["code_id", "dst"])
        stores = stores.where("opcode IN ('StoreLocal', 'StoreGlobal', 'StoreLocalPair', 'StoreLoadLocal', 'StackCopy', 'StoreCollectionElement', 'Yield', 'EnterContext')").select(v("src").alias("src"), v("dst").alias("dst"))
        # objects: one for each constant of a code object, one for each allocating instruction, one for each module name
        const = at.where("opcode IN ('LoadConst', 'LoadLiteral')").select(v("node").alias("value"), F.shiftrightunsigned(F.xxhash64("code_id", "name", "operand"), 2).alias("object"))
        made = at.where("opcode IN ('BuildCollection', 'CreateFunction', 'Generic', 'SetFunctionAttribute') AND (opcode <> 'SetFunctionAttribute')").select(v("node").alias("value"), v("node").alias("object"))
        place = codes.select("code_id", "module", "parent_id", "is_package")
        imported = lifted.where("opcode = 'ImportModule'").select("code_id", (F.col("idx") * 4).cast("long").alias("node"), "symbol", "import_level", "has_fromlist").join(place, "code_id")
        imported = imported.withColumn("source", imported_module(F.col("module"), F.col("is_package"), F.col("symbol"), F.col("import_level"), F.col("has_fromlist")))
        module = lambda name: field(F.concat(F.lit("module "), name))
        modules = imported.select(v("node").alias("value"), module(F.col("source")).alias("object"))
        address = const.unionByName(made).unionByName(modules)
        loads = into_.where("opcode = 'LoadAttribute' AND name <> 'LOAD_SUPER_ATTR' AND kind = 'Address'").select(v("src").alias("base"), field(F.col("symbol")).alias("field"), v("dst").alias("dst"))
        imports = into_.where("opcode = 'ImportAttribute' AND kind = 'Operand'").select(v("src").alias("base"), field(F.col("symbol")).alias("field"), v("dst").alias("dst"))
        bases = records.where("record = 'base'").select("code_id", F.col("a").alias("dst"), F.col("b").alias("base_node"))
        # elements: a key that is one constant names its own field, any other the summary
        name_of = F.when((F.col("const_kind") == "int") & ~F.col("const_text").startswith("-"), F.col("const_text")).when(F.col("const_kind") == "str", F.concat(F.lit("'"), F.col("const_text")))
        consts = at.where("opcode = 'LoadConst'").select("code_id", F.col("node").alias("b"), name_of.alias("key"), "const_kind", "const_text")
        one = lambda df, *by: df.join(consts, ["code_id", "b"], "left").groupBy("code_id", *by).agg(F.when(F.count("*") == F.count("key"), F.when(F.countDistinct("b") == 1, F.max("key"))).alias("key"))
        keys = one(records.where("record = 'key'").select("code_id", F.col("a").alias("dst"), "b"), "dst")
        summary = F.lit(pta.SUMMARY).cast("long")
        named_place = F.when(F.col("key").isNotNull(), element(F.col("key"))).otherwise(summary)
        items = bases.join(at.withColumnRenamed("node", "dst").where("opcode = 'LoadElement'"), ["code_id", "dst"]).join(keys, ["code_id", "dst"], "left").select(v("base_node").alias("base"), named_place.alias("field"), v("dst").alias("dst"))
        written = into_.where("opcode IN ('StoreAttribute', 'StoreElement') AND kind = 'Operand'").join(bases, ["code_id", "dst"]).join(keys, ["code_id", "dst"], "left")
        written = written.select(v("src").alias("src"), v("base_node").alias("base"), F.when(F.col("opcode") == "StoreAttribute", field(F.col("symbol"))).otherwise(named_place).alias("field"))
        # displays: by place, dicts by their constant keys; what keys are has a field of its own
        shown = records.where("record = 'element'").select("code_id", "a", "b", F.col("kind").cast("int").alias("at")).join(at.select("code_id", F.col("node").alias("a"), F.col("name").alias("how"), "operand"), ["code_id", "a"])
        map_keys = one(shown.where("how = 'BUILD_MAP' AND at % 2 = 0").select("code_id", "a", (F.col("at") + 1).alias("at"), "b"), "a", "at")
        listed = shown.where("how = 'BUILD_CONST_KEY_MAP' AND at = operand").join(consts.where("const_kind = 'strings'"), ["code_id", "b"]).select("code_id", "a", F.posexplode(F.split("const_text", "\x1f")).alias("at", "key")).withColumn("key", F.concat(F.lit("'"), "key"))
        shown = shown.join(map_keys.unionByName(listed), ["code_id", "a", "at"], "left")
        is_key = ((F.col("how") == "BUILD_MAP") & (F.col("at") % 2 == 0)) | ((F.col("how") == "BUILD_CONST_KEY_MAP") & (F.col("at") == F.col("operand")))
        where = F.when(is_key, element(F.lit("keys"))).when(F.col("how").isin("BUILD_MAP", "BUILD_CONST_KEY_MAP"), named_place).otherwise(element(F.col("at")))
        elements = shown.select(v("b").alias("src"), v("a").alias("base"), where.alias("field"))
        # unpacking takes elements by place, the last of them from the lowest output; with a star it takes any
        unpacked = into_.where("opcode = 'UnpackCollection' AND kind = 'Operand'").withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.col("stack_out"), F.lit(1)) - 1)))
        unpacked = unpacked.select(v("src").alias("base"), F.when(F.col("name") == "UNPACK_SEQUENCE", element(F.col("stack_out") - 1 - F.col("k"))).otherwise(summary).alias("field"), value(F.col("code_id"), F.col("dst") + F.least("k", F.lit(2))).alias("dst"))
        items = items.unionByName(unpacked)
        # functions: what creates them, and what sets their attributes
        child = codes.select(F.col("parent_id").alias("code_id"), F.col("const_index").alias("operand"), F.col("code_id").alias("code"))
        made_of = e.where("kind = 'Operand'").join(at.where("opcode = 'CreateFunction'").withColumnRenamed("node", "dst").select("code_id", "dst"), ["code_id", "dst"])
        made_of = made_of.join(at.where("opcode = 'LoadConst'").withColumnRenamed("node", "src").select("code_id", "src", "operand"), ["code_id", "src"]).join(child, ["code_id", "operand"])
        self.functions = saved(made_of.select(v("dst").alias("object"), "code").distinct(), "functions")
        sets = e.join(at.where("opcode = 'SetFunctionAttribute'").select("code_id", F.col("node").alias("dst"), F.col("operand").alias("which")), ["code_id", "dst"])
        chain = sets.where("kind = 'DefUse'").select(v("src").alias("value"), v("dst").alias("next"))
        named = self.functions.select(F.col("object").alias("value"), "object", "code")
        created = named
        for _ in range(4):  # defaults, keyword defaults, annotations, closure
            named = named.join(chain, "value").select(F.col("next").alias("value"), "object", "code")
            created = created.unionByName(named)
        created = saved(created.distinct(), "created")
        # calls
        method = at.where("opcode = 'LoadAttribute' AND stack_out = 2").select("code_id", F.col("node").alias("src")).withColumn("method", F.lit(True))
        called = e.where("kind = 'Callee'").join(method, ["code_id", "src"], "left").join(at.where("opcode = 'Call'").select("code_id", F.col("node").alias("dst"), F.col("name").alias("how"), "operand", "keyword_names"), ["code_id", "dst"])
        shape = called.groupBy("code_id", "dst").agg(F.max(F.col("method").isNotNull()).alias("method"), F.first("how").alias("how"), F.first("operand").alias("operand"), F.first("keyword_names").alias("keyword_names"))
        passed = records.where("record = 'argument'").select("code_id", F.col("a").alias("dst"), F.col("kind").cast("int").alias("at"), "b").join(shape, ["code_id", "dst"])
        passed = passed.withColumn("pos", F.col("at") - F.when((F.col("how") != "CALL_FUNCTION_EX") & F.col("method"), 1).otherwise(0)).where("pos >= 0")
        # keywords name the last values; a call without a method form may have one value more, its first
        n = F.max("pos").over(Window.partitionBy("code_id", "dst")) + 1
        names = F.coalesce(F.size("keyword_names"), F.lit(0))
        passed = passed.withColumn("total", n).withColumn("keyword", F.when((names > 0) & (F.col("pos") >= F.col("total") - names), F.get("keyword_names", F.col("pos") - F.col("total") + names)))
        passed = saved(passed.select(v("dst").alias("site"), "pos", "keyword", v("b").alias("value"), (F.col("how") == "CALL_FUNCTION_EX").alias("star"), "code_id", "dst"), "args")
        self.args = passed.where("NOT star").select("site", "pos", "keyword", "value").distinct()
        self.stars = passed.where("star").select("site", value(F.col("code_id"), F.col("dst") + 2).alias("value")).distinct()
        spread = passed.where("star").select(F.col("value").alias("base"), F.lit(pta.SUMMARY).cast("long").alias("field"), value(F.col("code_id"), F.col("dst") + 2).alias("dst"))
        # parameters
        k = F.col("n_args") + F.col("n_kwonly")
        own_names = codes.select("code_id", "n_args", "n_posonly", "n_kwonly", "varargs", F.posexplode(F.slice("locals", 1, k + F.col("varargs").cast("int") + F.col("varkw").cast("int"))).alias("pos", "label"))
        kind = F.when(F.col("pos") < F.col("n_posonly"), "positional_only").when(F.col("pos") < F.col("n_args"), "positional").when(F.col("pos") < k, "keyword_only").when(F.col("varargs") & (F.col("pos") == k), "varargs").otherwise("kwargs")
        inputs = n_.where("kind = 'Input' AND node < 0").select("code_id", "node", "label")
        params = own_names.withColumn("kind", kind).join(inputs, ["code_id", "label"])
        into = F.when(F.col("kind") == "varargs", extra(F.col("code_id"), 1)).when(F.col("kind") == "kwargs", extra(F.col("code_id"), 2))
        self.params = saved(params.select(F.col("code_id").alias("body"), "pos", F.col("label").alias("name"), "kind", v("node").alias("value"), into.alias("into")).distinct(), "params")
        gathered = self.params.where("into IS NOT NULL")
        address = address.unionByName(gathered.select("value", F.col("into").alias("object")))
        collected = gathered.select(F.col("into").alias("src"), F.col("value").alias("base"), F.lit(pta.SUMMARY).cast("long").alias("field"))
        given = sets.where("kind = 'Operand' AND which = 1").select("code_id", F.col("src").alias("a"), v("dst").alias("value")).join(records.where("record = 'element'"), ["code_id", "a"])
        size = F.max(F.col("kind").cast("int")).over(Window.partitionBy("value"))
        self.defaults = saved(given.withColumn("back", size - F.col("kind").cast("int")).select("value", "back", v("b").alias("default")).join(created, "value").select("object", "back", F.col("default").alias("value")).distinct(), "defaults")
        # classes: the construction's first argument is the body, the others from the third on are bases
        built = e.where("kind = 'Callee'").join(at.where("name = 'LOAD_BUILD_CLASS'").withColumnRenamed("node", "src").select("code_id", "src"), ["code_id", "src"]).select(v("dst").alias("site")).distinct()
        self.classes = saved(built.join(self.args.where("pos = 0 AND keyword IS NULL"), "site").join(created.select("value", F.col("code").alias("body")), "value").select(F.col("site").alias("object"), "body").distinct(), "classes")
        self.class_args = self.args.where("pos >= 2 AND keyword IS NULL").join(built, "site").select(F.col("site").alias("class"), (F.col("pos") - 2).alias("place"), "value")
        self.class_bodies = self.classes.select(F.col("body").alias("code")).distinct()
        address = address.unionByName(self.classes.select(F.col("object").alias("value"), "object"))
        # a class body's names are fields of its class, a module's those of its module
        stored = at.where("opcode = 'StoreGlobal'").join(place, "code_id")
        members = stored.join(self.classes.select(F.col("body").alias("code_id"), "object"), "code_id").select(v("node").alias("src"), F.col("object").alias("base"), field(F.col("symbol")).alias("field"))
        top = place.where("parent_id = 0").select("module", extra(F.col("code_id"), 3).alias("base"))
        address = address.unionByName(top.select(F.col("base").alias("value"), module(F.col("module")).alias("object")))
        plain = stored.join(self.class_bodies.withColumnRenamed("code", "code_id"), "code_id", "left_anti")
        members = members.unionByName(plain.join(top, "module").select(v("node").alias("src"), "base", field(F.col("symbol")).alias("field")))
        parts = F.split("module", "\\.")
        under = place.where("parent_id = 0 AND module LIKE '%.%'").select("module", F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".").alias("above"), F.element_at(parts, -1).alias("last"))
        submodules = under.select(module(F.col("above")).alias("base"), field(F.col("last")).alias("field"), module(F.col("module")).alias("object"))
        # a module's globals: its stores feed the inputs of the same name in all its code objects, and star imports bring those of other modules
        own = plain.select("module", "symbol", v("node").alias("src"))
        asked = e.where("kind = 'DefUse' AND src < -1").join(at.where("opcode = 'LoadGlobal'").withColumnRenamed("node", "dst"), ["code_id", "dst"]).select("code_id", "src", "symbol").distinct().join(place, "code_id").select("module", "symbol", v("src").alias("dst"))
        star = e.where("kind = 'Operand'").join(at.where("name = 'CALL_INTRINSIC_1' AND operand = 2").select("code_id", F.col("node").alias("dst")), ["code_id", "dst"]).join(imported.select("code_id", F.col("node").alias("src"), "module", "source"), ["code_id", "src"]).select("module", "source").distinct()
        star = saved(star, "stars")
        if not star.isEmpty():
            brought = callgraph.star_imports(star, own.select("module", F.col("symbol").alias("name")).distinct())
            from_stars = brought.join(own.select(F.col("module").alias("source"), F.col("symbol").alias("name"), "src"), ["source", "name"]).select("module", F.col("name").alias("symbol"), "src")
            members = members.unionByName(from_stars.join(top, "module").select("src", "base", field(F.col("symbol")).alias("field")))
            own = own.unionByName(from_stars)
        names_ = own.join(asked, ["module", "symbol"]).select("src", "dst")
        lost = asked.join(own, ["module", "symbol"], "left_anti")
        # what a code object closes over: all that those around it give the name
        closes = codes.select(F.col("code_id").alias("inner"), F.col("parent_id").alias("code_id"), F.explode("frees").alias("label"))
        outer = at.where("opcode = 'StoreLocal'").select("code_id", F.col("symbol").alias("label"), v("node").alias("src")).unionByName(inputs.select("code_id", "label", v("node").alias("src")))
        inner_inputs = inputs.select(F.col("code_id").alias("inner"), "label", v("node").alias("dst"))
        closed = closes.join(outer, ["code_id", "label"]).join(inner_inputs, ["inner", "label"]).select("src", "dst")
        around = closes.where("label = '__class__'").join(self.classes.select(F.col("body").alias("code_id"), "object"), "code_id").join(inner_inputs, ["inner", "label"]).select(F.col("object").alias("src"), "dst")
        # builtins that wrap a function
        wraps = e.where("kind = 'Callee'").join(at.where("opcode = 'LoadGlobal' AND symbol IN ('property', 'staticmethod', 'classmethod')").select("code_id", F.col("node").alias("src"), "symbol"), ["code_id", "src"]).join(place, "code_id").join(own.select("module", "symbol").distinct(), ["module", "symbol"], "left_anti")
        wraps = wraps.select(v("dst").alias("site"), F.col("symbol").alias("kind")).distinct()
        self.wrappers = wraps.join(self.args.where("pos = 0"), "site").select(F.col("site").alias("object"), "kind", "value").distinct()
        self.known_sites = wraps.select("site").unionByName(built).distinct()
        address = address.unionByName(wraps.select(F.col("site").alias("value"), F.col("site").alias("object")))
        if unknown:
            address = address.unionByName(lost.select(F.col("dst").alias("value"), F.lit(pta.UNKNOWN).cast("long").alias("object")))
        # attribute loads that rules look at; those of super() have the class around them
        owner = codes.select("code_id", F.col("parent_id").alias("body")).join(self.classes, "body").select("code_id", F.col("object").alias("super_class"))
        reads = into_.where("opcode = 'LoadAttribute' AND kind = 'Address'").join(owner, "code_id", "left")
        self.attributes = reads.select(v("dst").alias("dst"), v("src").alias("base"), field(F.col("symbol")).alias("field"), F.col("code_id").alias("code"), F.when(F.col("name") == "LOAD_SUPER_ATTR", F.col("super_class")).alias("super_class")).distinct()
        self.field = field
        self.constraints = pta.Constraints(spark, {
            "address": address.distinct(), "copy": pairs.unionByName(stores).unionByName(names_).unionByName(closed).unionByName(around).distinct(), "field_load": loads.unionByName(imports).unionByName(items).unionByName(spread).distinct(),
            "field_store": written.unionByName(elements).unionByName(collected).unionByName(members).distinct(), "field_address": submodules.distinct(),
        })
        self.sites = e.where("kind = 'Callee'").select(v("dst").alias("site"), F.col("code_id").alias("caller"), v("src").alias("callee")).distinct()
        self.results = self.sites.select("site", F.col("site").alias("value")).distinct()
        self.returns = e.where("kind = 'ReturnValue'").select(F.col("code_id").alias("body"), v("src").alias("value"))


def flows(lifted: DataFrame, records: DataFrame, codes: DataFrame, low: Lowered, facts: DataFrame) -> DataFrame:
    """(src, dst, kind): stores of attributes and elements to loads of the same place of one object, and of globals to loads in other code objects."""
    at = lifted.select("code_id", (F.col("idx") * 4).cast("long").alias("a"), "idx", "opcode", "symbol").where("opcode IN ('LoadAttribute', 'StoreAttribute', 'LoadElement', 'StoreElement')")
    x = records.where("record = 'base'").select("code_id", "a", "b").join(at, ["code_id", "a"])
    x = x.select(value(F.col("code_id"), F.col("a")).alias("access"), value(F.col("code_id"), F.col("b")).alias("value"), F.coalesce("symbol", F.lit("[]")).alias("location"), F.col("code_id").alias("code"), "idx", F.col("opcode").startswith("Store").alias("stores"))
    x = x.join(pta.points_to(facts), "value").where(F.col("object") != pta.UNKNOWN).drop("value").distinct()
    x = saved(x, "accesses")
    heap = ddg.heap_def_use(x.where("stores"), x.where("NOT stores"))
    g = lifted.where("opcode IN ('LoadGlobal', 'StoreGlobal')").join(codes.select("code_id", "module"), "code_id").select("module", F.col("symbol").alias("name"), F.col("code_id").alias("code"), value(F.col("code_id"), (F.col("idx") * 4).cast("long")).alias("node"), F.col("opcode").alias("op"))
    names = ddg.global_def_use(g.where("op = 'StoreGlobal'").drop("op"), g.where("op = 'LoadGlobal'").drop("op"), low.class_bodies)
    return heap.withColumn("kind", F.lit("Heap")).unionByName(names.withColumn("kind", F.lit("Global")))


def analyze(codes: DataFrame, entries: DataFrame | None = None, unknown: bool = True) -> dict[str, DataFrame]:
    """All relations of a package of code objects (with ids): instructions, cfg, cdg, ddg, call graph, points-to facts.

    entries: (code) of further entry points; modules and class bodies always are. Code that nothing calls has flow relations
    but no call edges. Points-to and data dependence use the raw flow, the published cfg and cdg the refined one.
    """
    codes = saved(codes.withColumn("is_package", F.col("path").rlike(r"(^|/)__init__\.py[co]?$")), "codes")
    regions = saved(decode.exception_regions(codes), "regions")
    lifted = saved(decode.lift(decode.wordcode(codes), codes, decode.dimension(codes.sparkSession)), "instructions")
    placed = saved(cfg.with_blocks(lifted, regions), "placed")
    raw = saved(cfg.edges(placed, regions), "edges")
    params = codes.select("code_id", F.explode(F.slice("locals", 1, F.col("n_args") + F.col("n_kwonly") + F.col("varargs").cast("int") + F.col("varkw").cast("int"))).alias("symbol"))
    refined = saved(cfg.refined(placed, raw, params), "refined")
    pdom = saved(cdg.post_dominance(cfg.blocks(placed), refined), "pdom")
    records = saved(ddg.fragments(placed, raw), "records")
    low = Lowered(codes, lifted, records, unknown)
    c = pta.Constraints(low.constraints.spark, {k: saved(t, k) for k, t in low.constraints.tables.items()})
    first = codes.where("parent_id = 0").select(F.col("code_id").alias("code")).unionByName(low.class_bodies)
    if entries is not None:
        first = first.unionByName(entries.select("code"))
    for name in ("sites", "results", "returns", "attributes", "args", "stars", "class_args", "wrappers", "known_sites"):
        setattr(low, name, saved(getattr(low, name), name))
    edges, facts, calls = package.fixed_point(c, low, first.distinct())
    inner = ddg.edges(records).select(value(F.col("code_id"), F.col("src")).alias("src"), value(F.col("code_id"), F.col("dst")).alias("dst"), "kind")
    into = package.bound_arguments(calls, low.args, low.stars, low.params, low.defaults).select("src", "dst", F.lit("DefUse").alias("kind"))
    back = low.returns.withColumnRenamed("value", "src").join(calls.where("returns").select("body", F.col("site").alias("dst")), "body").select("src", "dst", F.lit("Result").alias("kind"))
    between = into.unionByName(back).unionByName(flows(lifted, records, codes, low, facts))
    return {
        "instructions": placed, "cfg": refined, "post_dominance": pdom, "cdg": cdg.control_dependence(refined, pdom), "ddg_nodes": ddg.nodes(records), "ddg": inner.unionByName(between).distinct(),
        "call_graph": edges, "points_to": facts, "errors": records.where("record = 'error'").select("code_id", "label"),
    }
