"""A small package from sources to all relations."""

from progdf.functions.scratch import saved
from progdf.operators import lower, package
from progdf.sources import ingest

SOURCE = '''
def ident(x):
    return x

def apply(f, v):
    return f(v)

def unused():
    return ident(None)

result = apply(ident, [1, 2])
first = result[0]
'''


def test_package(spark):
    files = spark.createDataFrame([("m.py", "m", SOURCE.encode())], "path string, module string, content binary")
    ids = saved(ingest.with_ids(ingest.compile_sources(files)))
    code = {r.qualname: r.code_id for r in ids.collect()}
    out = lower.analyze(ids)
    assert out["errors"].isEmpty()
    calls = {(r.caller, r.target) for r in out["call_graph"].collect()}
    assert (code["<module>"], code["apply"]) in calls and (code["apply"], code["ident"]) in calls
    assert not any(c == code["unused"] for c, _ in calls)
    assert out["ddg"].where("kind = 'Result'").count() > 0 and not out["instructions"].isEmpty()


PACKAGE = {
    "pkg/__init__.py": ("pkg", ""),
    "pkg/shapes.py": ("pkg.shapes", '''
class Base:
    def __init__(self, size, *, label=None):
        self.size = size
        self.label = label

    def area(self):
        return self.unit()

    def unit(self):
        return [0]

    @property
    def twice(self):
        return double(self.size)

    @staticmethod
    def make(kind):
        return kind()

    @classmethod
    def built(cls):
        return cls(one)

class Square(Base):
    def __init__(self, size, label=None):
        super().__init__(size, label=label)

    def unit(self):
        return self.size

    def __call__(self, f):
        return f(self)

def double(x):
    return x

def one():
    return {}
'''),
    "pkg/use.py": ("pkg.use", '''
from .shapes import Square, Base
from . import shapes
from pkg.stars import *

def handler():
    return "h"

def other():
    return "o"

def spread(*args, **rest):
    return args[0]()

def defaulted(f=handler):
    return f()

def outer(g):
    def inner():
        return g()
    return inner

def run():
    s = Square(handler, label=other)
    s.area()
    s.label()
    s.twice
    s(defaulted2)
    Base.make(shapes.one)
    Base.built()
    spread(other)
    defaulted()
    outer(other)()
    starred()

def defaulted2(x):
    return x

def unused():
    return handler()

def elements():
    table = {"a": handler, "b": other}
    table["b"]()
    made = {}
    made["k"] = handler
    made["j"] = keyed
    made["j"]()
    first, second = handler, spread
    pair = (handler, starred)
    x, y = pair
    y()
    return second(other)

def keyed():
    return [handler, defaulted2][1](0)

run()
elements()
'''),
    "pkg/stars.py": ("pkg.stars", '''
def starred():
    return _hidden()

def _hidden():
    return 1
'''),
}


def test_rules_of_classes_and_calls_feed_each_other(spark):
    """Real code: constructors, inherited methods, super, properties, wrappers, calls of instances, keywords, defaults, stars, closures, imports."""
    files = spark.createDataFrame([(p, m, s.encode()) for p, (m, s) in PACKAGE.items()], "path string, module string, content binary")
    ids = saved(ingest.with_ids(ingest.compile_sources(files)))
    name = {r.code_id: r.qualname for r in ids.collect()}
    out = lower.analyze(ids)
    assert out["errors"].isEmpty()
    rows = out["call_graph"].collect()
    calls = {(name[r.caller], name[r.target]) for r in rows if r.target is not None}
    want = {
        "<module>": ["run", "elements"], "elements": ["other", "keyed", "starred", "spread"], "keyed": ["defaulted2"], "run": ["Square.__init__", "Base.area", "other", "Base.twice", "Square.__call__", "Base.make", "Base.built", "spread", "defaulted", "outer", "outer.<locals>.inner", "starred"],
        "Base.area": ["Square.unit"], "Square.__init__": ["Base.__init__"], "Base.twice": ["double"], "Square.__call__": ["defaulted2"], "Base.make": ["one"], "Base.built": ["Base.__init__"],
        "spread": ["other"], "defaulted": ["handler"], "outer.<locals>.inner": ["other"], "starred": ["_hidden"],
    }
    assert calls == {(a, b) for a, bs in want.items() for b in bs}
    kinds = {r.kind for r in out["ddg"].select("kind").distinct().collect()}
    assert {"Heap", "Global", "Result", "DefUse"} <= kinds


def test_lookups_take_the_nearest_owner_and_the_first_base(spark):
    classes = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5)], "class long")
    bases = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 0), (3, 4, 0), (5, 5, 0)], "class long, base long, place int")
    lines = package.ancestors(classes, bases)
    order = {c: [r.owner for r in sorted(lines.where(f"class = {c}").collect(), key=lambda r: r["rank"])] for c in (1, 2, 5)}
    assert order == {1: [1, 2, 3, 4], 2: [2, 4], 5: [5]}
    members = spark.createDataFrame([(4, 7, 40), (3, 7, 30), (2, 8, 20), (4, 8, 41)], "owner long, field long, object long")
    assert {tuple(r) for r in package.looked_up(lines, members).where("class = 1").collect()} == {(1, 7, 30), (1, 8, 20)}


def test_arguments_find_their_parameters(spark):
    df = spark.createDataFrame
    params = df([(9, 0, "self", "positional", 100), (9, 1, "a", "positional", 101), (9, 2, "b", "positional", 102), (9, 3, "k", "keyword_only", 103), (9, 4, "rest", "varargs", 104), (9, 5, "more", "kwargs", 105)], "body long, pos int, name string, kind string, value long")
    calls = df([(1, 50, 9, 77), (2, 50, 9, 0), (3, 50, 9, 77)], "site long, object long, body long, receiver long")
    args = df([(1, 0, None, 11), (1, 1, None, 12), (1, 2, None, 13), (2, 0, None, 21), (2, 1, "b", 22), (2, 2, "k", 23), (2, 3, "z", 24)], "site long, pos int, keyword string, value long")
    got = package.bound_arguments(calls, args, df([(3, 31)], "site long, value long"), params, df([(50, 0, 900), (50, 1, 901)], "object long, back int, value long"))
    want = {(11, 101), (12, 102), (13, 104), (21, 100), (22, 102), (23, 103), (24, 105), (901, 101), *((31, d) for d in (101, 102, 103, 104, 105)), (900, 102)}
    assert {tuple(r) for r in got.collect()} == want
