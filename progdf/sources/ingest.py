"""Python sources and compiled files as tables of code objects.

A file is read by Spark's binaryFile source and compiled or unmarshalled in a worker; the tree of code objects becomes one row each,
in preorder. Files that cannot be read become rows with an error, and callers decide whether that ends the run.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from progdf.functions.scratch import numbered

CODE_SCHEMA = (
    "path string, module string, seq int, parent_seq int, const_index int, name string, qualname string, first_line int, n_args int, n_posonly int, n_kwonly int, varargs boolean, varkw boolean, "
    "code binary, names array<string>, locals array<string>, cells array<string>, frees array<string>, derefs array<string>, const_kinds array<string>, const_texts array<string>, "
    "exception_table binary, lines array<int>, error string"
)


def _paths(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Files under root by the file system's own listing: Spark's would pass over names such as __init__.py."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    found, it = [], p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    while it.hasNext():
        f = it.next().getPath()
        if f.getName().endswith(suffix):
            found.append(f.toString())
    return sorted(found)


def _read(batches):
    """Contents of files that Spark's own sources hide, read in the workers."""
    from pyarrow import fs

    for batch in batches:
        paths = batch.column(0).to_pylist()
        data = []
        for p in paths:
            store, rest = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", p))
            with store.open_input_stream(rest) as f:
                data.append(f.read())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary()), pa.array([len(x) for x in data], pa.int64())], ["path", "content", "length"])


def files(spark: SparkSession, root: str, pattern: str = "*.py", include: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, rel, content, size) of files under root, or root itself; rel is below root. Only paths are listed on the driver.

    include: a condition on rel; what it denies, or leaves null, is no source.
    """
    paths = _paths(spark, root, pattern.lstrip("*"))
    hidden = [p for p in paths if p.rsplit("/", 1)[-1].startswith("_")]
    seen = [p for p in paths if p not in set(hidden)]
    df = spark.createDataFrame([(p,) for p in hidden], "path string").repartition(max(1, len(hidden) // 64)).mapInArrow(_read, "path string, content binary, length long")
    if seen:
        df = df.unionByName(spark.read.format("binaryFile").load(seen).select("path", "content", "length"))
    base = F.lit(root.rstrip("/").removeprefix("file:").removeprefix("//"))
    path = F.regexp_replace("path", "^file:/*", "/")
    rel = F.when(path.startswith(F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2)).otherwise(F.element_at(F.split(path, "/"), -1))
    out = df.select(path.alias("path"), rel.alias("rel"), "content", F.col("length").alias("size"))
    return out.where(include(F.col("rel"))) if include else out


def source_root(df: DataFrame, explicit: bool = False) -> str:
    """'src' where the sources lie below src/, else ''."""
    return "src" if not explicit and df.agg(F.max(F.col("rel").startswith("src/"))).first()[0] else ""


def escapes(rel: Column) -> Column:
    """Does a relative path leave its root?"""
    depth = F.aggregate(F.split(rel, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda s, x: F.struct(
        (s["d"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("d"),
        F.least(s["low"], s["d"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("low")), lambda s: s["low"])
    return rel.startswith("/") | (depth < 0)


def module_name(rel: Column, prefix: str = "") -> Column:
    """Dotted name of a relative source path: without suffix and version tag, __init__ and __pycache__ dropped."""
    stem = F.regexp_replace(rel, r"(\.(cpython|pypy)-?\d+[a-z0-9-]*)?(\.opt-\d)?\.pyc?$", "")
    parts = F.filter(F.split(stem, "/"), lambda x: ~x.isin("", ".", "__init__", "__pycache__"))
    return F.array_join(F.concat(F.array(F.lit(prefix)), parts) if prefix else parts, ".")


def relative_import(package: Column, level: Column, name: Column) -> Column:
    """Absolute name of an import of `level` dots from within a package."""
    parts = F.split(package, r"\.")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - (level - 1), F.lit(0)))
    return F.when(level == 0, name).otherwise(F.array_join(F.filter(F.concat(base, F.array(F.coalesce(name, F.lit("")))), lambda x: x != ""), "."))


def _constant(c) -> tuple[str, str]:
    if c is None or c is Ellipsis or c is NotImplemented:
        return "singleton", repr(c)
    if isinstance(c, bool):
        return "bool", repr(c)
    if isinstance(c, int):
        return ("int", str(c)) if -(2**63) <= c < 2**63 else ("bigint", str(c))
    if isinstance(c, str):
        return "str", c
    if isinstance(c, tuple | frozenset) and all(isinstance(x, str) for x in c):
        return "strings", "\x1f".join(c if isinstance(c, tuple) else sorted(c))
    return ("code", c.co_qualname) if hasattr(c, "co_code") else ("other", type(c).__name__)


def code_rows(top, path: str, module: str):
    """Rows of a code object and those within it, preorder."""
    todo, seq = [(top, -1, -1)], 0
    while todo:
        c, parent, index = todo.pop()
        kinds = [_constant(x) for x in c.co_consts]
        own = [*c.co_varnames, *[x for x in c.co_cellvars if x not in c.co_varnames], *c.co_freevars]
        yield (path, module, seq, parent, index, c.co_name, c.co_qualname, c.co_firstlineno, c.co_argcount, c.co_posonlyargcount, c.co_kwonlyargcount, bool(c.co_flags & 4), bool(c.co_flags & 8), c.co_code,
               list(c.co_names), list(c.co_varnames), list(c.co_cellvars), list(c.co_freevars), own, [k for k, _ in kinds], [t for _, t in kinds], c.co_exceptiontable, [p[0] or 0 for p in c.co_positions()], None)
        todo += [(x, seq, i) for i, x in reversed(list(enumerate(c.co_consts))) if hasattr(x, "co_code")]
        seq += 1


def _extracted(df: DataFrame, read) -> DataFrame:
    schema = pa.schema([(f.name, t) for f, t in zip(df.sparkSession.createDataFrame([], CODE_SCHEMA).schema, [
        pa.string(), pa.string(), *[pa.int32()] * 3, pa.string(), pa.string(), *[pa.int32()] * 4, pa.bool_(), pa.bool_(), pa.binary(), *[pa.list_(pa.string())] * 7, pa.binary(), pa.list_(pa.int32()), pa.string()], strict=True)])

    def run(batches):
        for batch in batches:
            rows = []
            for path, module, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows += code_rows(read(content, path), path, module)
                except Exception as e:  # any fault of a file is that file's row
                    rows.append((path, module, -1, -1, -1, *[None] * 18, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return df.select("path", "module", "content").mapInArrow(run, CODE_SCHEMA)


def compile_sources(df: DataFrame) -> DataFrame:
    """Code objects of (path, module, content) sources, compiled by the workers' interpreter. Broken sources give a row with an error."""
    version = sys.version_info[:2]

    def read(content: bytes, path: str):
        if sys.version_info[:2] != version:
            raise RuntimeError(f"worker runs Python {sys.version_info[:2]}, not {version}")
        return compile(content, path, "exec", dont_inherit=True, optimize=0)

    return _extracted(df, read)


def load_pyc(df: DataFrame) -> DataFrame:
    """Code objects of compiled files of the workers' interpreter; a short header, another magic number or another object is an error."""

    def read(content: bytes, path: str):
        import importlib.util
        import marshal

        if len(content) < 16:
            raise ValueError("header of fewer than 16 bytes")
        if content[:4] != importlib.util.MAGIC_NUMBER:
            raise ValueError("compiled by another interpreter")
        c = marshal.loads(content[16:])
        if not hasattr(c, "co_code"):
            raise ValueError("no code object")
        return c

    return _extracted(df, read)


def with_ids(codes: DataFrame) -> DataFrame:
    """code_id, dense from 1 in the order of modules and preorder, and parent_id, 0 for modules; rows with errors are left out."""
    good = codes.where("error IS NULL")
    first = good.groupBy("module", "path").agg(F.count("*").alias("n"))
    place = numbered(first, ["module", "path"], "place")
    # places by tens of thousands are summed first, then those of one group
    group = F.floor((F.col("place") - 1) / 10_000)
    sums = place.groupBy(group.alias("group")).agg(F.sum("n").alias("n"))
    sums = sums.select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = place.withColumn("group", group).withColumn("own", own).join(sums, "group").select("module", "path", (F.col("own") + F.col("above")).alias("base"))
    out = good.join(base, ["module", "path"])
    return out.withColumns({"code_id": F.col("base") + F.col("seq") + 1, "parent_id": F.when(F.col("parent_seq") < 0, 0).otherwise(F.col("base") + F.col("parent_seq") + 1)}).drop("base")


def failures(codes: DataFrame) -> DataFrame:
    return codes.where("error IS NOT NULL").select("path", "error")


def inventory(df: DataFrame) -> DataFrame:
    """(path, package, size, sha256, magic) of compiled files: package is the first three parts of the relative path."""
    return df.select("path", F.array_join(F.slice(F.split("rel", "/"), 1, 3), "/").alias("package"), "size", F.sha2("content", 256).alias("sha256"), F.lower(F.hex(F.substring("content", 1, 4))).alias("magic"))


def classified(inv: DataFrame, magics: DataFrame) -> DataFrame:
    """classification of an inventory: invalid, supported (magic of the dimension), pypy, cpython by its tag, or unknown."""
    out = inv.join(F.broadcast(magics.select("magic", "version")), "magic", "left")
    tag = F.regexp_extract("path", r"\.(cpython|pypy)-?(\d+)", 1)
    return out.withColumn("classification", F.when(F.col("size") < 16, "invalid").when(F.col("version").isNotNull(), "supported").when(tag == "pypy", "pypy").when(tag == "cpython", "cpython-other").otherwise("unknown"))


def _stem(name: Column) -> Column:
    """What stands before the interpreter's tag in the name of a cached file, null without tag."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(tag)), F.substring_index(name, tag, 1)) for tag in (".cpython-", ".pypy")])


def source_candidate(path: Column) -> Column:
    """Where the source of a compiled file would be: above its __pycache__, or beside it; null if its name does not tell."""
    at = F.split(path, "/")
    name, folder = F.element_at(at, -1), F.slice(at, 1, F.size(at) - 1)
    cached = F.size(folder) > 0
    above = F.array_join(F.concat(F.slice(folder, 1, F.greatest(F.size(folder) - 1, F.lit(0))), F.array(F.concat(_stem(name), F.lit(".py")))), "/")
    return F.when(~path.endswith(".pyc"), None).when(cached & (F.get(folder, F.size(folder) - 1) == "__pycache__"), F.when(_stem(name).isNotNull(), above)).otherwise(F.regexp_replace(path, "c$", ""))


def module_identity(rel: Column) -> Column:
    """Dotted name of a source or cached file by its path below the first folder called source; null without one."""
    parts = F.split(rel, "/")
    place = F.array_position(parts, "source").cast("int")
    rest = F.slice(parts, place + 1, F.size(parts))
    last, n = F.get(rest, F.size(rest) - 1), F.size(rest)
    cached = (n >= 2) & (F.get(rest, n - 2) == "__pycache__")
    name = F.when(cached, _stem(last)).otherwise(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""))
    folders = F.slice(rest, 1, F.greatest(n - F.when(cached, 2).otherwise(1), F.lit(0)))
    return F.when((place > 0) & (n > 0) & name.isNotNull(), F.array_join(F.when(name == "__init__", folders).otherwise(F.concat(folders, F.array(name))), "."))


def source_evidence(compiled: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, candidate, status, flags, timestamp_matches, size_matches) of compiled (path, content) files against sources (path, modified in seconds, size).

    status: absent without a source at the candidate; matched or mismatch by the header's time and size, both of 32 bits;
    unverified without candidate, with a header of fewer than 16 bytes, or if the header holds no time (its flags are not 0).
    """
    h = F.substring("content", 1, 16)
    number = lambda at: F.conv(F.concat(*[F.hex(F.substring("header", at + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("long")
    c = compiled.select("path", h.alias("header")).withColumn("candidate", source_candidate(F.col("path")))
    known = sources.select(F.col("path").alias("candidate"), F.col("modified").cast("long").alias("modified"), F.col("size").cast("long").alias("size"))
    x = c.join(known, "candidate", "left")
    there = F.col("size").isNotNull()
    x = x.withColumn("flags", F.when(there & (F.length("header") == 16), number(4)))
    low = F.lit(0xFFFFFFFF)
    timed = F.col("flags") == 0
    x = x.withColumns({"timestamp_matches": F.when(timed, F.col("modified").bitwiseAND(low) == number(8)), "size_matches": F.when(timed, F.col("size").bitwiseAND(low) == number(12))})
    both = F.col("timestamp_matches") & F.col("size_matches")
    status = F.when(F.col("candidate").isNotNull() & ~there, "absent").when(both, "matched").when(~both, "mismatch").otherwise("unverified")
    return x.select("path", "candidate", status.alias("status"), "flags", "timestamp_matches", "size_matches")


def source_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_lines: lines that are neither blank nor comments."""
    return df.withColumn("n_lines", F.size(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))))


def directives(lines: DataFrame) -> DataFrame:
    """(path, kind, value) of EXPECT, FORBID and TAGS comments in (path, line) rows."""
    kind = F.regexp_extract("line", r"#\s*(EXPECT|FORBID|TAGS):\s*(.*?)\s*$", 1)
    return lines.select("path", kind.alias("kind"), F.regexp_extract("line", r"#\s*(EXPECT|FORBID|TAGS):\s*(.*?)\s*$", 2).alias("value")).where("kind <> ''")
