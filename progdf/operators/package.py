"""One fixed point of the rules of a package: calls, argument binding, classes, instances, attributes, super, properties, wrappers.

Facts are those of the points-to analysis over shared sets. A round looks up attributes on what their bases point to now, resolves the
sites of reached bodies, allocates instances and bound methods, binds arguments of new calls to parameters, and hands what is new to the solver,
which derives only what follows from it. Rules are joins for all sites at once; what has been found before is taken off by anti-joins, and
the points-to facts themselves are never written again. It ends when no rule has anything new.

Objects of the rules: a function is what its creation points to, a class what its construction points to (both have the id of that value), an
instance has one for each site and class, a bound method one for each receiver and function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from progdf.functions.scratch import Grown, forget, saved

from . import pta

CALLS = "site long, caller long, object long, body long, receiver long, returns boolean"


def _made(kind: str, *columns):
    """Id of an object that a rule makes."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(kind), *columns), 2) + 1


def ancestors(classes: DataFrame, bases: DataFrame, most: int = 100) -> DataFrame:
    """(class, owner, rank): each class and what it inherits from, rank ordering owners: nearer ones first, then by the order of bases.

    classes (class), bases (class, base, place). A class that inherits from itself ends like any other: owners come once, at their nearest.
    """
    own = classes.select("class", F.col("class").alias("owner"), F.array(F.lit(0)).alias("rank"))
    all_ = Grown(own, "ancestors")
    new = all_.read()
    for _ in range(most):
        up = new.join(bases.select(F.col("class").alias("owner"), F.col("base"), "place"), "owner")
        # the rank is the number of steps, then the places that they took
        step = F.concat(F.array(F.col("rank")[0] + 1), F.slice("rank", 2, 1000), F.array(F.col("place").cast("int")))
        up = up.select("class", F.col("base").alias("owner"), step.alias("rank")).groupBy("class", "owner").agg(F.min("rank").alias("rank"))
        new = saved(up.join(all_.read(), ["class", "owner"], "left_anti"), "ancestors")
        if new.isEmpty():
            return all_.read()
        all_.add(new)
    raise RuntimeError("inheritance did not settle")


def looked_up(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(class, field, object): what a name means on a class: members (owner, field, object) of its first owner in lines (class, owner, rank) that has it."""
    hit = lines.join(members, "owner")
    first = hit.groupBy("class", "field").agg(F.min("rank").alias("rank"))
    return hit.join(first, ["class", "field", "rank"]).select("class", "field", "object").distinct()


def bound_arguments(calls: DataFrame, args: DataFrame, stars: DataFrame, params: DataFrame, defaults: DataFrame) -> DataFrame:
    """(src, dst) copies of calls (site, object, body, receiver): where the arguments' values go.

    calls' receiver: 0 for none. args (site, pos, keyword, value); stars (site, value) of calls with * or **, whose elements may go anywhere; params (body, pos, name, kind,
    value) with kind positional_only, positional, keyword_only, varargs or kwargs; defaults (object, place from the end, value). A
    receiver takes the first place. What finds no place of its own goes to varargs or kwargs. A default counts where the call gives nothing.
    """
    shift = F.when(F.col("receiver") != 0, 1).otherwise(0)
    c = calls.select("site", "object", "body", shift.alias("shift")).distinct()
    given = c.join(args, "site").withColumn("at", F.col("pos") + F.col("shift"))
    p = params.select("body", F.col("pos").alias("place"), "name", "kind", F.col("value").alias("dst"))
    by_place = given.where("keyword IS NULL").join(p.where("kind IN ('positional_only', 'positional')"), (given["body"] == p["body"]) & (F.col("at") == F.col("place"))).drop(p["body"])
    by_name = given.join(p.where("kind IN ('positional', 'keyword_only')"), (given["body"] == p["body"]) & (F.col("keyword") == F.col("name"))).drop(p["body"])
    key = ["site", "object", "body", "shift", "pos"]
    placed = by_place.unionByName(by_name)
    rest = given.join(placed.select(*key).distinct(), key, "left_anti")
    spill = rest.join(p, "body").where("(keyword IS NULL AND kind = 'varargs') OR (keyword IS NOT NULL AND kind = 'kwargs')")
    wild = c.join(stars, "site").join(p, "body").where("kind IN ('varargs', 'kwargs') OR place >= shift")
    filled = placed.select("site", "object", "place").distinct().unionByName(c.where("shift = 1").select("site", "object", F.lit(0).alias("place")))
    d = c.join(defaults, "object").join(p.where("kind IN ('positional_only', 'positional')"), "body")
    d = d.withColumn("last", F.max("place").over(Window.partitionBy("site", "object", "body"))).where("place = last - back").join(filled, ["site", "object", "place"], "left_anti")
    out = [x.select(F.col("value").alias("src"), "dst") for x in (placed, spill, wild, d)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).distinct()


def fixed_point(c: pta.Constraints, low, entries: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges (site, caller, target), facts by value, calls) of a lowered package: relations as attributes of `low`, see lower.Lowered.

    Sites of reached bodies alone count. An edge without target stands for a site that points to nothing or also to what is not callable code.
    """
    spark = c.spark
    later = low.params.select("value").unionByName(low.results.select("value")).unionByName(low.attributes.select(F.col("dst").alias("value")))
    own, members = pta.shared(c, later)
    of = lambda df, col: df.join(members.select(F.col("value").alias(col), "cls"), col, "left").withColumn(col, F.coalesce("cls", col)).drop("cls")
    sites, attributes = saved(of(low.sites, "callee"), "sites"), saved(of(low.attributes, "base"), "attributes")
    base_args = saved(of(low.class_args, "value"), "class_args")
    wrappers = saved(of(low.wrappers, "value"), "wrappers")
    copies, known = Grown(own.get("copy"), "copies"), Grown(pta._seed(own), "facts")
    pta.settle(own, known, known.read(), most, pta.WIDEN)
    active = Grown(entries.select(F.col("code").cast("long").alias("code")).distinct(), "active")
    found = Grown(spark.createDataFrame([], CALLS), "found")
    instances = Grown(spark.createDataFrame([], "object long, class long"), "instances")
    bound = Grown(spark.createDataFrame([], "object long, receiver long, function long"), "bound")
    classes = low.classes.select(F.col("object").alias("class"))
    for _ in range(most):
        facts = known.read()
        p = pta.points_to(facts)
        points = lambda df, col: df.join(p.select(F.col("value").alias(col), "object"), col)  # noqa: B023, E731
        bases = points(base_args, "value").join(classes.select(F.col("class").alias("base")), F.col("object") == F.col("base")).groupBy("class", "base").agg(F.min("place").alias("place"))
        lines = ancestors(classes, saved(bases, "bases"))
        own_members = pta.fields(facts).select(F.col("base").alias("owner"), "field", "object").join(classes.select(F.col("class").alias("owner")), "owner", "left_semi")
        look = saved(looked_up(lines, own_members), "names")
        above = saved(looked_up(lines.where("rank[0] > 0"), own_members), "names")
        # what the bases of attribute loads are
        base = saved(points(attributes, "base").select("dst", "field", "code", "super_class", "object"), "bases")
        inst = instances.read()
        on_instance = base.where("super_class IS NULL").join(inst, "object").join(look.withColumnRenamed("object", "member"), ["class", "field"]).select("dst", "code", F.col("object").alias("receiver"), "class", "member")
        on_super = base.where("super_class IS NOT NULL").join(above.select(F.col("class").alias("super_class"), "field", F.col("object").alias("member")), ["super_class", "field"]).select("dst", "code", F.col("object").alias("receiver"), F.col("super_class").alias("class"), "member")
        on_class = base.where("super_class IS NULL").join(classes, F.col("object") == F.col("class")).join(look.withColumnRenamed("object", "member"), ["class", "field"]).select("dst", "code", F.lit(None).cast("long").alias("receiver"), "class", "member")
        got = on_instance.unionByName(on_super).unionByName(on_class)
        got = saved(got.join(low.functions.select(F.col("object").alias("member"), F.col("code").alias("body")), "member", "left").join(wrappers.withColumnsRenamed({"object": "member", "kind": "wrapper", "value": "inner"}), "member", "left"), "got")
        inner = got.where("wrapper IS NOT NULL").join(p.select(F.col("value").alias("inner"), F.col("object").alias("function")), "inner").join(low.functions.select(F.col("object").alias("function"), F.col("code").alias("inner_body")), "function")
        methods = got.where("body IS NOT NULL AND receiver IS NOT NULL").select("dst", "receiver", F.col("member").alias("function"))
        methods = methods.unionByName(inner.where("wrapper = 'classmethod'").select("dst", F.col("class").alias("receiver"), "function"))
        methods = methods.withColumn("object", _made("bound", "receiver", "function"))
        plain = got.where("wrapper IS NULL AND (body IS NULL OR receiver IS NULL)").select("dst", F.col("member").alias("object"))
        plain = plain.unionByName(inner.where("wrapper = 'staticmethod'").select("dst", F.col("function").alias("object")))
        getters = inner.where("wrapper = 'property' AND receiver IS NOT NULL").select(F.col("dst").alias("site"), F.col("code").alias("caller"), F.col("function").alias("object"), F.col("inner_body").alias("body"), "receiver", F.lit(True).alias("returns"))
        more_bound = saved(methods.select("object", "receiver", "function").distinct().join(bound.read().select("object"), "object", "left_anti"), "bound")
        bound.add(more_bound)
        # what the sites of reached bodies call
        live = active.read().withColumnRenamed("code", "caller")
        callee = saved(points(sites.join(live, "caller", "left_semi"), "callee").select("site", "caller", "object"), "callees")
        functions = low.functions.select("object", F.col("code").alias("body"))
        direct = callee.join(functions, "object").select("site", "caller", "object", "body", F.lit(0).cast("long").alias("receiver"), F.lit(True).alias("returns"))
        by_method = callee.join(bound.read(), "object").select("site", "caller", F.col("function").alias("object"), "receiver").join(functions, "object").select("site", "caller", "object", "body", "receiver", F.lit(True).alias("returns"))
        built = callee.join(classes, F.col("object") == F.col("class")).select("site", "caller", "class", _made("instance", "site", "class").alias("receiver"))
        more_instances = saved(built.select(F.col("receiver").alias("object"), "class").distinct().join(inst.select("object"), "object", "left_anti"), "instances")
        instances.add(more_instances)
        named = lambda x, name: x.join(look.where(F.col("field") == low.field(F.lit(name))).select("class", "object"), "class").join(functions, "object")  # noqa: B023, E731
        inits = named(built, "__init__").select("site", "caller", "object", "body", "receiver", F.lit(False).alias("returns"))
        called = named(callee.join(inst, "object").withColumnRenamed("object", "receiver"), "__call__").select("site", "caller", "object", "body", "receiver", F.lit(True).alias("returns"))
        calls = direct
        for x in (by_method, inits, called, getters.join(live, "caller", "left_semi")):
            calls = calls.unionByName(x)
        calls = saved(calls.distinct().join(found.read(), ["site", "object", "body", "receiver"], "left_anti"), "calls")
        found.add(calls)
        active.add(saved(calls.select(F.col("body").alias("code")).distinct().join(active.read(), "code", "left_anti"), "active"))
        # values that get objects, and copies
        lost = callee.where(F.col("object") == pta.UNKNOWN).join(low.known_sites, "site", "left_anti").select(F.col("site").alias("value"), "object")
        receivers = calls.where("receiver <> 0").join(low.params.where("pos = 0 AND kind IN ('positional', 'positional_only')").select("body", "value"), "body").select("value", F.col("receiver").alias("object"))
        new_objects = receivers.unionByName(lost).unionByName(plain.select(F.col("dst").alias("value"), "object")).unionByName(methods.select(F.col("dst").alias("value"), "object")).unionByName(built.select(F.col("site").alias("value"), F.col("receiver").alias("object")))
        new_objects = saved(of(new_objects, "value").distinct().join(p, ["value", "object"], "left_anti"), "objects")
        back = low.returns.withColumnRenamed("value", "src").join(calls.where("returns").select("body", F.col("site").alias("dst")), "body").select("src", "dst")
        brought = bound_arguments(calls, low.args, low.stars, low.params.withColumn("value", F.coalesce("into", "value")), low.defaults).unionByName(back)
        brought = of(of(brought, "src"), "dst").where("src <> dst").select("src", "dst").distinct()
        brought = saved(brought.join(copies.read(), ["src", "dst"], "left_anti"), "stitches")
        if calls.isEmpty() and more_bound.isEmpty() and more_instances.isEmpty() and new_objects.isEmpty() and brought.isEmpty():
            break
        copies.add(brought)
        own = pta.Constraints(spark, {**own.tables, "copy": copies.read()}, once=True)
        pta.more(own, known, brought, most, pta.WIDEN, new_objects)
        forget(look, above, base, got, callee)
    else:
        raise RuntimeError("the package did not settle")
    solution = pta.Solution(saved(pta.widened(known.read()), "facts"), members)
    every = found.read()
    edges = every.select("site", "caller", F.col("body").alias("target")).distinct()
    live = sites.join(active.read().withColumnRenamed("code", "caller"), "caller", "left_semi")
    code = low.functions.select("object").unionByName(classes.select(F.col("class").alias("object"))).unionByName(bound.read().select("object")).unionByName(instances.read().select("object")).distinct().withColumn("fine", F.lit(True))
    seen = live.join(pta.points_to(solution.facts).withColumnRenamed("value", "callee"), "callee", "left").join(code, "object", "left")
    open_ = seen.groupBy("site", "caller").agg(F.max(F.col("fine").isNull()).alias("open")).where("open").select("site", "caller", F.lit(None).cast("long").alias("target"))
    late = later.distinct().join(members, "value", "left_anti").select("value", F.col("value").alias("cls"))
    return saved(edges.unionByName(open_), "calls"), pta.Solution(solution.facts, members.unionByName(late)).expanded(), every
