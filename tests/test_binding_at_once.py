"""Arguments are bound where they are: few bodies move no argument, and all rules hold on odd rows."""

import random
import re

from progdf.operators import binding
from progdf.plans import registry

FORMALS = [("f", 0, "a", "positional_only"), ("f", 1, "b", "positional"), ("f", 2, "rest", "varargs"), ("f", 3, "c", "keyword_only"), ("f", 4, "kw", "kwargs"), ("g", 0, "a", "positional"), ("g", 1, "d", "keyword_only"), ("g", 1, "d", "keyword_only"), ("h", 0, "rest", "varargs"), ("i", 0, "a", "positional"), ("i", 1, "b", "positional")]
SCHEMA = "site long, body string, pos int, keyword string, expanded boolean"


def wanted(actuals):
    out = set()
    for site, body, pos, keyword, expanded in actuals:
        own = [f for f in FORMALS if f[0] == body]
        at = lambda *kinds: {f[1] for f in own if f[3] in kinds}  # noqa: B023, E731
        every = {f[1] for f in own}
        if expanded:
            hit = every
        elif expanded is None:
            hit = set()
        elif keyword is None:
            hit = {pos} & at("positional_only", "positional") or at("varargs") or every
        else:
            hit = {f[1] for f in own if f[2] == keyword and f[3] in ("positional", "keyword_only")} or at("kwargs") or every
        out |= {(site, pos, f) for f in hit}
    return out


def odd_rows():
    r = random.Random(5)
    rows = [(r.randrange(90), r.choice(["f", "g", "h", "i", "none", None]), r.choice([0, 1, 2, 5, None]), r.choice([None, None, "a", "b", "d", "zz"]), r.choice([False, False, False, True, None])) for _ in range(600)]
    return rows + rows[:50]


def test_rules_on_odd_rows(spark, monkeypatch):
    rows = odd_rows()
    actuals, formals = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(FORMALS, "body string, formal_pos int, name string, kind string")
    want = wanted(rows)
    gone = {(s, b, f[1]) for s, b, *_ in rows for f in FORMALS if f[0] == b and f[3].startswith("positional") and not any(x[0] == s and x[2] == f[1] for x in want)}
    assert gone
    for bodies in (binding.BODIES, 2):  # broadcast, and shuffled
        monkeypatch.setattr(binding, "BODIES", bodies)
        got = [tuple(x) for x in binding.bind(actuals, formals).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        lost = [tuple(x) for x in binding.missing(actuals, formals).collect()]
        assert len(lost) == len(set(lost)) and set(lost) == gone
        assert {tuple(x) for x in binding.missing_defaults(binding.bind(actuals, formals), actuals.select("site", "body").distinct(), formals).select("site", "body", "formal_pos").collect()} == gone


def test_arguments_are_shuffled_by_site_alone(spark):
    for name in ("binding_pairs", "binding_missing"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
        assert sorted(dealt) == ["body", "l_orderkey", "l_orderkey"], dealt  # formals by body
