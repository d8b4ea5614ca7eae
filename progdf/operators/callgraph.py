"""Call graphs: construction, look-ups, resolution against points-to facts, on-the-fly discovery."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from progdf.functions import parts
from progdf.functions.scratch import Grown, forget, numbered, saved

from . import pta


def violations(edges: DataFrame) -> DataFrame:
    """(problem, site): null or reserved ids, and sites with several callers."""
    bad = edges.where("site IS NULL OR caller IS NULL OR caller = 0").select(F.lit("invalid id").alias("problem"), "site")
    many = edges.groupBy("site").agg(F.countDistinct("caller").alias("n")).where("n > 1").select(F.lit("several callers").alias("problem"), "site")
    return bad.unionByName(many)


def with_groups(edges: DataFrame, columns: list[str]) -> DataFrame:
    """group_id for edges without target, from 1 in the order of the group's columns; 0 for edges with one."""
    groups = numbered(edges.where("target IS NULL").select(*columns).distinct(), columns, "group_id")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"g.{c}")) for c in columns]
    cond = F.col("e.target").isNull()
    for s in same:
        cond = cond & s
    return edges.alias("e").join(groups.alias("g"), cond, "left").select("e.*", F.coalesce("g.group_id", F.lit(0)).alias("group_id"))


def nodes(edges: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(code, in_degree, out_degree): edges count each; one without target adds to its caller only."""
    out = edges.groupBy(F.col("caller").alias("code")).agg(F.count("*").alias("out_degree"))
    into = edges.where("target IS NOT NULL").groupBy(F.col("target").alias("code")).agg(F.count("*").alias("in_degree"))
    both = out.join(into, "code", "full_outer")
    if codes is not None:
        both = both.join(codes.select("code").distinct(), "code", "full_outer")
    return both.select("code", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def targets(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, target) of wanted sites, each once."""
    return edges.where("target IS NOT NULL").join(sites.select("site").distinct(), "site", "left_semi").select("site", "target").distinct()


def resolve(sites: DataFrame, points_to: DataFrame, callables: DataFrame) -> DataFrame:
    """Edges (site, caller, target) of sites (site, caller, callee): a target for each callable that the callee points to, and one edge without target where it points to nothing or to something else too."""
    hit = sites.join(points_to.withColumnRenamed("value", "callee"), "callee", "left").join(callables.select("object", F.col("code").alias("target")), "object", "left")
    known = hit.where("target IS NOT NULL").select("site", "caller", "target").distinct()
    lost = hit.groupBy("site", "caller").agg(F.max(F.col("target").isNull()).alias("open")).where("open").select("site", "caller", F.lit(None).cast("long").alias("target"))
    return known.unionByName(lost)


def callable_conflicts(registered: DataFrame) -> DataFrame:
    """Objects registered for several functions."""
    return registered.groupBy("object").agg(F.countDistinct("code").alias("n")).where("n > 1").select("object", "n")


def assigned(registered: DataFrame, order: str) -> DataFrame:
    """The last assignment of each object."""
    return registered.groupBy("object").agg(F.max_by("code", order).alias("code"))


def reachable(edges: DataFrame, entries: DataFrame, most: int = 200) -> DataFrame:
    """Codes that calls reach from entries (code), entries included; frontier by frontier."""
    step = edges.where("target IS NOT NULL").select(F.col("caller").alias("code"), F.col("target").alias("next")).distinct()
    new = saved(entries.select("code").distinct(), "reached")
    all_ = Grown(new, "reached")
    for _ in range(most):
        new = saved(new.join(step, "code").select(F.col("next").alias("code")).distinct().join(all_.read(), "code", "left_anti"), "reached")
        if new.isEmpty():
            return all_.read()
        all_.add(new)
    raise RuntimeError("calls did not settle")


def on_the_fly(c: pta.Constraints, sites: DataFrame, callables: DataFrame, formals: DataFrame, returns: DataFrame, actuals: DataFrame, results: DataFrame, entries: DataFrame, most: int = 200, bind=None) -> tuple[DataFrame, DataFrame]:
    """(edges, facts): sites of reached bodies are resolved, their targets activated once and stitched, until nothing new comes.

    sites (site, caller, callee), callables (object, code), formals (body, pos, value), returns (body, value), actuals (site, pos, value), results (site, value), entries (code).
    bind: (calls (site, caller, object, body)) to further copies (src, dst) that they bring, beside actuals to formals by position and returns to results.

    A round looks at the sites of bodies reached in it, and at other sites of reached bodies only where their callee's set has grown.
    What is found is stitched as copies between classes of values; formals and results are classes of their own. The edges are those of the last facts.
    Rounds shuffle all tables but small ones, so that what goes through the driver does not grow with the program.
    """
    with parts.little_sent(c.spark):
        return _on_the_fly(c, sites, callables, formals, returns, actuals, results, entries, most, bind)


def _on_the_fly(c: pta.Constraints, sites: DataFrame, callables: DataFrame, formals: DataFrame, returns: DataFrame, actuals: DataFrame, results: DataFrame, entries: DataFrame, most: int, bind) -> tuple[DataFrame, DataFrame]:
    spark = c.spark
    later = formals.select("value").unionByName(results.select("value"))
    own, members = pta.shared(c, later)
    of = lambda df, col: df.join(members.select(F.col("value").alias(col), "cls"), col, "left").withColumn(col, F.coalesce("cls", col)).drop("cls")
    where = saved(of(sites, "callee"), "sites")
    copies = Grown(own.get("copy"), "copies")
    known = Grown(pta._seed(own), "facts")
    changed = None
    pta.settle(own, known, known.read(), most, pta.WIDEN)
    fresh = saved(entries.select("code").distinct(), "active")
    active = Grown(fresh, "active")
    found = Grown(spark.createDataFrame([], "site long, caller long, object long, body long"), "found")
    for _ in range(most):
        at = lambda codes: where.join(codes.withColumnRenamed("code", "caller"), "caller", "left_semi")
        meets = lambda s, facts: s.join(pta.points_to(facts).withColumnRenamed("value", "callee"), "callee").join(callables.select("object", F.col("code").alias("body")), "object")
        hits = meets(at(fresh), known.read())
        if changed is not None:
            hits = hits.unionByName(meets(at(active.read()), changed))
        key = ["site", "caller", "object", "body"]
        calls = saved(hits.select(*[F.col(k).cast("long").alias(k) for k in key]).distinct().join(found.read(), key, "left_anti"), "hits")
        if calls.isEmpty():
            break
        found.add(calls)
        fresh = saved(calls.select(F.col("body").alias("code")).distinct().join(active.read(), "code", "left_anti"), "active")
        active.add(fresh)
        pairs = calls.select("site", "body").distinct()
        brought = pta.stitched(actuals.join(pairs, "site"), formals, returns, results.join(pairs, "site"))
        if bind is not None:
            brought = brought.unionByName(bind(calls))
        brought = of(of(brought, "src"), "dst").where("src <> dst").select("src", "dst").distinct()
        brought = saved(brought.join(copies.read(), ["src", "dst"], "left_anti"), "stitches")
        copies.add(brought)
        own = pta.Constraints(spark, {**own.tables, "copy": copies.read()}, once=True)
        changed = pta.more(own, known, brought, most)
    else:
        raise RuntimeError("call graph did not settle")
    solution = pta.Solution(saved(pta.widened(known.read()), "facts"), members)
    live = where.join(active.read().withColumnRenamed("code", "caller"), "caller", "left_semi")
    edges = saved(resolve(live, pta.points_to(solution.facts), callables), "calls")
    return edges, _with_late(solution, later).expanded()


def _with_late(solution: pta.Solution, later: DataFrame) -> pta.Solution:
    """Formals and results that no constraint names are classes of themselves."""
    more = later.distinct().join(solution.members, "value", "left_anti").select("value", F.col("value").alias("cls"))
    return pta.Solution(solution.facts, solution.members.unionByName(more))


def coverage(unknown: Column, edges_without_target: Column) -> Column:
    """2 if anything is unknown or unresolved, 0 if all is concrete."""
    return F.when((unknown > 0) | (edges_without_target > 0), F.lit(2)).otherwise(F.lit(0))


def contexts(site: Column, parent: Column, depth: int = 2) -> Column:
    """Call string of a callee: its site before its caller's, cut to depth."""
    return F.slice(F.concat(F.array(site), parent), 1, depth)


def path_variants(branches: DataFrame, most: int = 16) -> DataFrame:
    """(code_id, variant, decision): each choice of the conditional branches (code_id, guards array) while they are at most `most` variants, else one without decisions.

    A guard names the local that it tests; two branches on the same local that is never assigned again have to agree.
    """
    k = F.size("guards")
    count = F.expr(f"CASE WHEN size(guards) <= 20 AND shiftleft(1, size(guards)) <= {most} THEN shiftleft(1, size(guards)) ELSE 1 END")
    made = branches.withColumn("count", count).withColumn("variant", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    decision = F.expr("transform(sequence(0, size(guards) - 1), i -> if(count = 1 AND size(guards) > 0, NULL, (variant div cast(power(2, i) as int)) % 2 = 1))")
    made = made.withColumn("decision", F.when(k > 0, decision).otherwise(F.array().cast("array<boolean>")))
    clash = F.expr("exists(sequence(0, size(guards) - 1), i -> exists(sequence(0, size(guards) - 1), j -> guards[i] IS NOT NULL AND guards[i] = guards[j] AND decision[i] <> decision[j]))")
    return made.where((k == 0) | ~F.coalesce(clash, F.lit(False))).select("code_id", "variant", "decision")


def inherited(classes: DataFrame, own: DataFrame) -> DataFrame:
    """(class, name, owner): each class's members: its own, then those of its bases in order, nearest first.

    classes: (class, base, place). own: (class, name). A nearer definition hides a farther one, of equal distance that of the earlier base.
    Classes are looked at in the order of their levels, each once, when its bases are whole; where classes inherit from each other in a
    circle there is no such order, and members come by rounds.
    """
    edges = saved(classes.select("class", "base", "place").where("class IS NOT NULL AND base IS NOT NULL AND class <> base"), "bases")
    levels = _levels(edges)
    if levels is None:
        return _inherited_by_rounds(classes, own)
    at = saved(edges.join(levels, "class").join(levels.select(F.col("class").alias("base"), F.col("level").alias("from")), "base", "left").withColumn("from", F.coalesce("from", F.lit(0))), "ways")
    needed: dict[int, set[int]] = {}
    for r in at.select("level", "from").distinct().collect():  # pairs of levels
        needed.setdefault(r["level"], set()).add(r["from"])
    first = own.select("class", "name").distinct().join(levels, "class", "left")
    first = saved(first.select("class", "name", F.col("class").alias("owner"), F.lit(0).alias("steps"), F.coalesce("level", F.lit(0)).alias("level")), "own")
    parts = [saved(first.where("level = 0").drop("level"), "members")]
    have = Grown(parts[0], "members")
    for level in range(1, max(needed, default=0) + 1):
        above = [parts[k].select(F.col("class").alias("base"), "name", "owner", "steps") for k in sorted(needed[level])]
        up = at.where(F.col("level") == level).select("class", "base", "place").join(functools.reduce(DataFrame.unionByName, above), "base")
        up = up.select("class", "name", F.struct((F.col("steps") + 1).alias("steps"), "place", "owner").alias("best"))
        mine = first.where(F.col("level") == level).select("class", "name", F.struct("steps", F.lit(None).cast(edges.schema["place"].dataType).alias("place"), "owner").alias("best"))
        best = up.unionByName(mine).groupBy("class", "name").agg(F.min("best").alias("best"))
        parts.append(saved(best.select("class", "name", "best.owner", "best.steps"), "members"))
        have.add(parts[-1])
    return have.read().select("class", "name", "owner")


def _levels(edges: DataFrame) -> DataFrame | None:
    """(class, level) of the classes of edges (class, base) that have bases: one more than the highest of them, where those without bases have 0; None if there is a circle."""
    left = edges.select("class", "base").distinct()
    found = Grown(edges.sparkSession.createDataFrame([], "class long, level int").select(F.col("class").cast(edges.schema["class"].dataType), "level"), "levels")
    waiting = saved(left.select("class").distinct(), "waiting")
    while True:
        # an edge is left while its base waits itself
        next_ = saved(left.join(waiting.withColumnRenamed("class", "base"), "base", "left_semi"), "left")
        rest = saved(next_.select("class").distinct(), "waiting")
        ready = saved(waiting.join(rest, "class", "left_anti").select("class", F.lit(len(found.paths)).alias("level")), "levels")
        if ready.isEmpty():
            return found.read() if waiting.isEmpty() else None
        found.add(ready)
        left, waiting = next_, rest


def _inherited_by_rounds(classes: DataFrame, own: DataFrame) -> DataFrame:
    """inherited() as a fixed point by distance: a round for each level of bases; a class that inherits from itself ends like any other, as no member comes twice."""
    new = saved(own.select("class", "name", F.col("class").alias("owner")).distinct(), "members")
    have = Grown(new, "members")
    while True:
        # what is new one level up is all that can be new here
        up = classes.join(new.select(F.col("class").alias("base"), "name", "owner"), "base").join(have.read().select("class", "name"), ["class", "name"], "left_anti")
        new = saved(up.groupBy("class", "name").agg(F.min_by("owner", "place").alias("owner")), "members")
        if new.isEmpty():
            return have.read()
        have.add(new)


def star_imports(pairs: DataFrame, names: DataFrame, most: int = 50) -> DataFrame:
    """(module, name, source): names that star imports (module, source) bring, transitively; names with a leading underscore and names of the module's own stay out."""
    public = names.where("name NOT LIKE '\\\\_%'").select("module", "name", F.col("module").alias("origin")).distinct()
    all_ = new = saved(public, "names")
    own = names.select("module", "name").distinct()
    for _ in range(most):
        got = pairs.join(new.select(F.col("module").alias("source"), "name", "origin"), "source").select("module", "name", "origin").distinct()
        got = got.join(own, ["module", "name"], "left_anti")
        new = saved(got.join(all_, ["module", "name", "origin"], "left_anti"), "names")
        if new.isEmpty():
            return all_.where("module <> origin").select("module", "name", F.col("origin").alias("source"))
        all_ = saved(all_.unionByName(new), "names")
    raise RuntimeError("star imports did not settle")


def unresolved_globals(inputs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Inputs (module, name) without a definition."""
    return inputs.join(definitions.select("module", "name").distinct(), ["module", "name"], "left_anti")


def qualified_names(codes: DataFrame) -> DataFrame:
    """(code_id, qualified): names along parents (code_id, parent_id, name, place); lambdas are numbered within their parent in order, implicit frames stand for their owner.

    Every round doubles how far up a code object's names reach, so rounds grow with the logarithm of the depth. A code object
    whose parents never end has no name.
    """
    number = F.row_number().over(Window.partitionBy("parent_id").orderBy("place"))
    lambdas = codes.where("name = '<lambda>'").withColumn("label", F.concat(F.lit("<lambda"), number, F.lit(">"))).select("code_id", "label")
    own = F.when(F.col("name").isin("<listcomp>", "<setcomp>", "<dictcomp>", "<genexpr>"), F.array().cast("array<string>")).otherwise(F.array(F.coalesce("label", "name")))
    now = saved(codes.join(lambdas, "code_id", "left").select("code_id", F.col("parent_id").alias("up"), own.alias("names")), "names")
    left = now.where("up <> 0").count()
    while left:
        above = now.select(F.col("code_id").alias("up"), F.col("up").alias("next"), F.col("names").alias("before"))
        new = now.join(above, "up", "left").select("code_id", F.when(F.col("up") == 0, 0).otherwise(F.coalesce("next", F.lit(-1))).alias("up"), F.concat(F.coalesce("before", F.array().cast("array<string>")), "names").alias("names"))
        last, now = now, saved(new, "names")
        forget(last)
        before, left = left, now.where("up > 0").count()
        if left == before:
            break
    return now.where("up = 0").select("code_id", F.array_join("names", ".").alias("qualified"))
