"""Sources to control flow: our own programs, compared with the interpreter's own disassembly."""

import dis
import py_compile
import types

import pytest

from pyspark.sql import functions as F

from progdf.functions.scratch import saved
from progdf.operators import cdg, cfg, decode
from progdf.sources import ingest

SOURCE = '''
import os
from .helper import work as w

def outer(a, b=1, *rest, k=None, **kw):
    total = 0
    for x in rest:
        if x > a:
            total += x
        else:
            continue
    try:
        with open(b) as f:
            data = [y * 2 for y in f if y]
    except (OSError, ValueError) as e:
        raise RuntimeError(e) from None
    finally:
        del total
    return lambda z: w(z, key=data)

class C(object):
    def m(self):
        return super().m()[1:2]
'''


@pytest.fixture(scope="module")
def package(tmp_path_factory):
    d = tmp_path_factory.mktemp("package")
    (d / "src" / "pkg").mkdir(parents=True)
    (d / "src" / "pkg" / "__init__.py").write_text("X = 1\n")
    (d / "src" / "pkg" / "mod.py").write_text(SOURCE)
    (d / "src" / "pkg" / "bad.py").write_text("def (:\n")
    return d


@pytest.fixture(scope="module")
def codes(spark, package):
    files = ingest.files(spark, str(package))
    assert ingest.source_root(files) == "src"
    return ingest.compile_sources(ingest.files(spark, str(package / "src")).withColumn("module", ingest.module_name(ingest.F.col("rel")))).cache()


def tree(code):
    return [code, *[y for c in code.co_consts if isinstance(c, types.CodeType) for y in tree(c)]]


def test_modules_failures_and_order(codes):
    assert {r.module for r in codes.select("module").distinct().collect()} == {"pkg", "pkg.mod", "pkg.bad"}
    assert [r.error.split(":")[0] for r in ingest.failures(codes).collect()] == ["SyntaxError"]
    ids = ingest.with_ids(codes).orderBy("code_id").collect()
    assert [r.code_id for r in ids] == list(range(1, len(ids) + 1)) and ids[0].parent_id == 0
    assert [r.qualname for r in ids if r.module == "pkg.mod"] == [c.co_qualname for c in tree(compile(SOURCE, "x", "exec"))]


def test_instructions_are_those_of_the_interpreter(spark, codes):
    ids = ingest.with_ids(codes).where("module = 'pkg.mod'")
    raw = decode.wordcode(ids)
    lifted = decode.lift(raw, ids, decode.dimension(spark))
    got = {}
    for r in lifted.orderBy("code_id", "idx").collect():
        got.setdefault(r.code_id, []).append(r)
    assert decode.violations(ids).isEmpty() and lifted.where("opcode = 'Unsupported'").isEmpty()
    regions = {}
    for r in decode.exception_regions(ids).collect():
        regions.setdefault(r.code_id, []).append((r.start_off, r.end_off, r.handler_off, r.stack_depth, r.push_lasti))
    for code, key in zip(tree(compile(SOURCE, "x", "exec")), sorted(got), strict=True):
        want = list(dis.get_instructions(code))
        assert [(r.off, r.name) for r in got[key]] == [(i.start_offset, i.opname) for i in want]
        for r, i in zip(got[key], want, strict=True):
            if r.jump_target is not None:
                assert r.jump_target == i.jump_target
            if i.opname in ("LOAD_FAST", "STORE_FAST", "LOAD_NAME", "LOAD_DEREF"):
                assert r.symbol == i.argval
        entries = [(e.start, e.end, e.target, e.depth, e.lasti) for e in dis._parse_exception_table(code)]
        assert sorted(regions.get(key, [])) == sorted(entries)


def test_flow_of_real_code_is_valid(spark, codes):
    ids = ingest.with_ids(codes)
    lifted, regions = saved(decode.lift(decode.wordcode(ids), ids, decode.dimension(spark))), saved(decode.exception_regions(ids))
    assert cfg.violations(lifted, regions).isEmpty()
    placed = saved(cfg.with_blocks(lifted, regions))
    edges = saved(cfg.edges(placed, regions))
    assert cfg.graph_violations(placed, edges).isEmpty()
    assert cfg.refined(placed, edges).count() <= edges.count()
    assert not cdg.control_dependence(edges, cdg.post_dominance(cfg.blocks(placed), edges)).isEmpty()


def test_compiled_files(spark, package, tmp_path):
    py_compile.compile(str(package / "src/pkg/mod.py"), cfile=str(tmp_path / "mod.cpython-313.pyc"))
    (tmp_path / "short.pyc").write_bytes(b"abc")
    files = ingest.files(spark, str(tmp_path), "*.pyc").withColumn("module", ingest.module_name(ingest.F.col("rel")))
    out = ingest.load_pyc(files)
    assert {r.module for r in out.where("error IS NULL").collect()} == {"mod"} and out.where("error LIKE '%16 bytes'").count() == 1
    magic = ingest.inventory(files).where("size > 16").first().magic
    known = spark.createDataFrame([(magic, "3.13")], "magic string, version string")
    assert sorted(r.classification for r in ingest.classified(ingest.inventory(files), known).collect()) == ["invalid", "supported"]


def test_paths_and_imports(spark):
    df = spark.createDataFrame([("a/../../x.py",), ("a/./b.py",)], "rel string")
    assert [r[0] for r in df.select(ingest.escapes(ingest.F.col("rel"))).collect()] == [True, False]
    df = spark.createDataFrame([("a.b", 1, "c"), ("a.b", 2, "c"), ("a.b", 0, "c"), ("a.b", 1, None)], "p string, l int, n string")
    assert [r[0] for r in df.select(ingest.relative_import(*map(ingest.F.col, "pln"))).collect()] == ["a.b.c", "a.c", "c", "a.b"]


def test_only_sources_that_the_predicate_accepts(spark, tmp_path):
    for name in ("a.py", "skip/b.py", "skip/__init__.py", "c/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = ingest.files(spark, str(tmp_path), include=lambda rel: ~rel.startswith("skip/"))
    assert sorted(r.rel for r in found.collect()) == ["a.py", "c/d.py"]
    assert ingest.files(spark, str(tmp_path), include=lambda rel: F.lit(None).cast("boolean")).isEmpty()


def test_places_and_names_of_compiled_files(spark):
    paths = {
        "source/a/__pycache__/b.cpython-310.opt-1.pyc": ("source/a/b.py", "a.b"), "x/source/__pycache__/__init__.pypy39.pyc": ("x/source/__init__.py", ""), "source/a/b.pyc": ("source/a/b.py", "a.b"), "__pycache__/b.cpython-310.pyc": ("b.py", None),
        "b.pyc": ("b.py", None), "source/__pycache__/b.pyc": (None, None), "source/a.py": (None, "a"), "source": (None, None), "source/source/.x": (None, "source..x"), "": (None, None),
    }
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    got = {r.path: (r.c, r.m) for r in df.select("path", ingest.source_candidate(F.col("path")).alias("c"), ingest.module_identity(F.col("path")).alias("m")).collect()}
    assert got == paths | {None: (None, None)}
