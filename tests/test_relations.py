"""Points-to, calls, binding, evaluation and sinks on small relations."""

from pyspark.sql import functions as F

from progdf.functions import dot
from progdf.operators import binding, callgraph, evaluate, pta, reach


def facts(spark, **tables):
    dfs = {k: spark.createDataFrame(v, ", ".join(f"{c} long" for c in pta.SCHEMAS[k])) for k, v in tables.items()}
    return pta.solve(pta.Constraints(spark, dfs))


def points(f):
    return {(r.value, r.object) for r in pta.points_to(f).collect()}


def test_copies_follow_chains_and_cycles(spark):
    assert points(facts(spark, address=[(1, 10)], copy=[(1, 2), (2, 3), (3, 1)])) == {(1, 10), (2, 10), (3, 10)}


def test_store_and_load_through_a_pointer(spark):
    f = facts(spark, address=[(1, 10), (2, 20)], store=[(2, 1)], load=[(1, 3)])
    assert (3, 20) in points(f) and [tuple(r) for r in pta.contents(f).collect()] == [(10, 20)]


def test_fields_exact_and_summary(spark):
    f = facts(spark, address=[(1, 10), (2, 20), (3, 30)], field_store=[(2, 1, 5), (3, 1, 6)], field_load=[(1, 5, 7), (1, 0, 8), (1, 9, 9)])
    assert {p for p in points(f) if p[0] > 3} == {(7, 20), (8, 20), (8, 30)}


def test_unknown_base(spark):
    f = facts(spark, address=[(1, -1), (2, 20), (3, 10)], field_store=[(2, 1, 5)], field_load=[(1, 5, 7), (3, 5, 8)])
    assert (7, -1) in points(f) and (8, -1) in points(f)


def test_keyed_load_falls_back_only_without_a_known_key(spark):
    base = {"address": [(1, 10), (2, 50), (3, 20), (4, 60)], "field_store": [(3, 1, 5)], "key_field": [(50, 5)]}
    assert (7, 20) in points(facts(spark, **base, keyed_load=[(1, 2, 7)]))
    assert (8, 20) in points(facts(spark, **base, keyed_load=[(1, 4, 8)]))
    other = {**base, "key_field": [(50, 6)]}
    assert not {p for p in points(facts(spark, **other, keyed_load=[(1, 2, 7)])) if p[0] == 7}


def test_widening_keeps_the_unknown_and_sixteen(spark):
    f = facts(spark, address=[(1, o) for o in range(10, 40)] + [(1, -1)] + [(2, o) for o in range(10, 40)])
    got = points(f)
    assert {o for v, o in got if v == 1} == {-1, *range(10, 26)} and len([1 for v, _ in got if v == 2]) == 30


def test_on_the_fly_resolves_what_a_call_brings(spark):
    c = pta.Constraints(spark, {"address": spark.createDataFrame([(1, 100), (2, 200)], "value long, object long")})
    df = spark.createDataFrame
    edges, _ = callgraph.on_the_fly(
        c, df([(11, 1, 1), (12, 2, 30)], "site long, caller long, callee long"), df([(100, 2), (200, 3)], "object long, code long"), df([(2, 0, 30)], "body long, pos int, value long"),
        df([], "body long, value long"), df([(11, 0, 2)], "site long, pos int, value long"), df([], "site long, value long"), df([(1,)], "code long"),
    )
    assert {(r.site, r.target) for r in edges.collect()} == {(11, 2), (12, 3)}


def test_binding(spark):
    formals = spark.createDataFrame([("f", 0, "a", "positional"), ("f", 1, "b", "positional"), ("f", 2, "rest", "varargs"), ("f", 3, "k", "keyword_only")], "body string, formal_pos int, name string, kind string")
    actuals = spark.createDataFrame([(1, "f", 0, None, False), (1, "f", 1, None, False), (1, "f", 2, None, False), (1, "f", 3, "k", False), (2, "f", 0, "b", False)], "site int, body string, pos int, keyword string, expanded boolean")
    got = binding.bind(actuals, formals)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 0, 1)]
    sites = actuals.select("site", "body").distinct()
    assert [tuple(r) for r in binding.missing_defaults(got, sites, formals).select("site", "formal_pos").collect()] == [(2, 0)]


def test_scores_of_missing_results_and_empty_ratios(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["c"], ["a", "c"]), (2, ["a"], [], None)], "id int, expected array<string>, forbidden array<string>, actual array<string>")
    out = {r.id: (r.tp, r.fn, r.fp, r.tn) for r in evaluate.score(df).collect()}
    assert out == {1: (1, 1, 1, 0), 2: (0, 1, 0, 0)}
    r = evaluate.finish(evaluate.score(df.where("id = 2"))).first()
    assert r.precision == 1.0 and r.recall == 0.0


def test_path_variants_drop_contradictions(spark):
    df = spark.createDataFrame([(1, ["x", "x"]), (2, ["x", "y"]), (3, [])], "code_id int, guards array<string>")
    n = {r.code_id: r["count"] for r in callgraph.path_variants(df).groupBy("code_id").count().collect()}
    assert n == {1: 2, 2: 4, 3: 1}


def test_star_imports(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "module string, source string")
    names = spark.createDataFrame([("c", "x"), ("c", "_y"), ("b", "z"), ("a", "z")], "module string, name string")
    assert {(r.module, r.name, r.source) for r in callgraph.star_imports(pairs, names).collect()} == {("b", "x", "c"), ("a", "x", "c")}


def test_qualified_names(spark):
    df = spark.createDataFrame([(1, 0, "m", 0), (2, 1, "f", 0), (3, 2, "<lambda>", 0), (4, 2, "<lambda>", 1), (5, 2, "<listcomp>", 2)], "code_id long, parent_id long, name string, place int")
    got = {r.code_id: r.qualified for r in callgraph.qualified_names(df).collect()}
    assert got == {1: "m", 2: "m.f", 3: "m.f.<lambda1>", 4: "m.f.<lambda2>", 5: "m.f"}


def test_dot_quoting(spark):
    df = spark.createDataFrame([('a"b\\c\nd\te',)], "t string")
    assert df.select(dot.quoted(F.col("t"))).first()[0] == '"a\\"b\\\\c\\nd\\te"'


def test_values_with_the_same_set_are_one_class(spark):
    """Cycles of copies, copies of one value, and loads of the same base become classes; results are those without sharing."""
    tables = {
        "address": [(1, 10), (2, 10), (3, 20), (30, 50)], "copy": [(1, 4), (4, 5), (5, 6), (6, 4), (3, 5), (6, 7), (7, 8), (30, 31), (31, 30)],
        "load": [(1, 11), (2, 12), (4, 13)], "store": [(3, 1), (8, 3)], "field_load": [(1, 5, 14), (2, 5, 15), (11, 5, 16)], "field_store": [(30, 1, 5)],
    }
    dfs = {k: spark.createDataFrame(v, ", ".join(f"{c} long" for c in pta.SCHEMAS[k])) for k, v in tables.items()}
    c = pta.Constraints(spark, dfs)
    cls = {r.value: r.cls for r in pta.shared(c)[1].collect()}
    for same in ((1, 2), (4, 5, 6, 7, 8), (11, 12), (14, 15), (30, 31)):
        assert len({cls[v] for v in same}) == 1, same
    assert len({cls[v] for v in (1, 3, 4, 11, 13, 14, 16, 30)}) == 8
    kept = {r.value: r.cls for r in pta.shared(c, spark.createDataFrame([(5,), (12,)], "value long"))[1].collect()}
    assert kept[11] != kept[12] and kept[4] == kept[5]

    sets, inside, named = {}, {}, {}
    for _ in range(20):
        put = lambda d, k, o: d.setdefault(k, set()).update(o)
        for v, o in tables["address"]:
            put(sets, v, {o})
        for a, b in tables["copy"]:
            put(sets, b, sets.get(a, ()))
        for a, b in tables["store"]:
            for o in list(sets.get(b, ())):
                put(inside, o, sets.get(a, ()))
        for a, b in tables["load"]:
            for o in list(sets.get(a, ())):
                put(sets, b, inside.get(o, ()))
        for a, b, f in tables["field_store"]:
            for o in list(sets.get(b, ())):
                put(named, (o, f), sets.get(a, ()))
        for a, f, b in tables["field_load"]:
            for o in list(sets.get(a, ())):
                put(sets, b, named.get((o, f), ()))
    want = {(v, o) for v, os in sets.items() for o in os}
    solution = pta.solution(c, widen=False)
    assert {(r.value, r.object) for r in solution.points_to().collect()} == want
    assert {r.value: r.n for r in solution.per_value(F.count("*").alias("n")).collect()} == {v: len(os) for v, os in sets.items() if os}
    assert solution.facts.where("kind = 'p'").count() < len(want)


def test_a_set_with_the_unknown_is_bounded_in_every_round(spark):
    rows = [(1, o) for o in range(10, 60)] + [(1, -1)]
    c = pta.Constraints(spark, {"address": spark.createDataFrame(rows, "value long, object long"), "copy": spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "src long, dst long")})
    solution = pta.solution(c.extended(address=spark.createDataFrame([(4, 5)], "value long, object long")))
    got = {(r.value, r.object) for r in solution.points_to().collect()}
    assert {o for v, o in got if v == 3} == {-1, 5, *range(10, 25)}


def test_labels_reach_labels_by_the_fewest_edges(spark):
    df = spark.createDataFrame
    edges = df([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4), (1, 1, 2), (2, 1, 4), (1, 9, None)], "graph long, src long, dst long")
    sources = df([(1, "a", 1), (1, "b", 2), (1, "b", 3), (1, "lone", 7), (2, "a", 1)], "graph long, label string, node long")
    targets = df([(1, "end", 4), (1, "self", 1), (2, "end", 4), (2, "none", 3)], "graph long, label string, node long")
    got = {tuple(r) for r in reach.reached(edges, sources, targets).collect()}
    assert got == {(1, "a", "end", 3), (1, "a", "self", 3), (1, "b", "end", 1), (1, "b", "self", 1), (2, "a", "end", 1)}
    paths = df([(1, "p", 0, 1), (1, "p", 1, 3), (1, "p", 2, 1), (1, "q", 0, 4), (1, "q", 1, 1), (1, "one", 0, 8)], "graph long, path string, place int, node long")
    assert {(r.path, r.holds, r.missing) for r in reach.paths_hold(edges, paths).collect()} == {("p", True, None), ("q", False, 1), ("one", True, None)}
