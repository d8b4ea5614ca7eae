"""Source, naming and wordcode queries over encoded tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from progdf.operators import decode, legacy
from progdf.sources import ingest

from . import encodings as X
from .encodings import table


def _paths(spark, d):
    """A source path for each page: the parts of its URL after the host, every fourth a package's __init__."""
    p = table(spark, d, "pages")
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), r"[^A-Za-z0-9/]+", "_")
    return p.select("page_id", F.concat(F.regexp_replace(path, "/+$", ""), F.when(F.col("page_id") % 4 == 0, "/__init__.py").when(F.col("page_id") % 4 == 1, ".cpython-313.pyc").otherwise(".py")).alias("rel"))


def module_names(spark, d):
    return _paths(spark, d).select("page_id", ingest.module_name(F.col("rel")).alias("module"))


def relative_imports(spark, d):
    """Imports of none to three dots from each page's module."""
    x = _paths(spark, d).select("page_id", ingest.module_name(F.col("rel")).alias("package"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    return x.select("page_id", "level", ingest.relative_import(F.col("package"), F.col("level"), F.lit("helper")).alias("module"))


def source_lines(spark, d):
    return ingest.source_lines(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"))


def escaping_paths(spark, d):
    p = _paths(spark, d).select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "a/../").when(F.col("page_id") % 3 == 1, "a/../../").otherwise(""), "rel").alias("rel"))
    return p.select("page_id", ingest.escapes(F.col("rel")).alias("escapes"))


def _codes(spark, d):
    """Wordcode of each user: an opcode from k, every eleventh a prefix and every thirteenth a cache, then a plain last instruction."""
    i = X.instructions(spark, d)
    op = F.when(F.col("idx") == F.col("n") - 1, 1).when(F.col("k") % 11 == 0, decode.EXTENDED_ARG).when(F.col("k") % 13 == 0, decode.CACHE).otherwise(F.col("k") % 40 + 2)
    pair = F.concat(F.lpad(F.hex(op), 2, "0"), F.lpad(F.hex((F.col("k") * 7) % 256), 2, "0"))
    return i.groupBy("code_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", pair.alias("h")))), lambda s: s["h"]), "")).alias("code"))


def wordcode_instructions(spark, d):
    return decode.wordcode(_codes(spark, d)).where("prefix_size < 6")


def wordcode_violations(spark, d):
    """Wordcode cut short of its last byte or instruction, by problem."""
    c = _codes(spark, d).select("code_id", F.expr("substring(code, 1, length(code) - CASE code_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)").alias("code"))
    return decode.violations(c).groupBy("problem").agg(F.count("*").alias("n"))


def _compiled(spark, d):
    """A compiled file for each order: cached with a tag of either kind or with none, or beside its source; its header has the date and the price."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.floor("o_totalprice").cast("long").alias("price"))
    k = F.col("o_orderkey")
    folder, stem = F.concat(F.lit("lib/source/p"), (k % 50).cast("string")), F.when(k % 6 == 5, "__init__").otherwise(F.concat(F.lit("m"), k.cast("string")))
    folder = F.when(k % 6 == 5, F.concat(folder, F.lit("/q"), k.cast("string"))).otherwise(folder)
    name = F.when(k % 4 == 0, F.concat(F.lit("/__pycache__/"), stem, F.lit(".cpython-313.pyc"))).when(k % 4 == 1, F.concat(F.lit("/__pycache__/"), stem, F.lit(".pypy39.pyc"))).when(k % 4 == 2, F.concat(F.lit("/"), stem, F.lit(".pyc"))).otherwise(F.concat(F.lit("/__pycache__/"), stem, F.lit(".pyc")))
    four = lambda v: F.concat(*[F.substring(F.lpad(F.hex(v), 8, "0"), i, 2) for i in (7, 5, 3, 1)])
    head = F.concat(F.lit("A7F30D0A"), four(F.when(k % 9 == 0, 3).otherwise(0).cast("long")), four(F.unix_date("day").cast("long")), four(F.col("price")))
    o = o.withColumns({"path": F.concat(folder, name), "content": F.unhex(F.when(k % 17 == 0, F.substring(head, 1, 24)).otherwise(F.concat(head, F.lit("E300"))))})
    sources = o.where(k % 5 != 0).select(F.concat(folder, F.lit("/"), stem, F.lit(".py")).alias("path"), (F.unix_date("day") + (k % 11 == 0).cast("int")).alias("modified"), (F.col("price") + (k % 13 == 0).cast("int")).alias("size"))
    return o.select("o_orderkey", "path", "content"), sources


def source_evidence(spark, d):
    """What headers of compiled files tell of the sources beside them."""
    return ingest.source_evidence(*_compiled(spark, d))


def module_identities(spark, d):
    return _compiled(spark, d)[0].select("o_orderkey", ingest.module_identity(F.col("path")).alias("module"))


def _legacy_codes(spark, d):
    """Each user's events as wordcode of 3.10, in stretches of eight: the second unit of a stretch is a SETUP whose handler is in the stretch, and jumps leave no stretch but for its end."""
    i = X.instructions(spark, d).withColumn("p", F.col("idx") % 8)
    k, more = F.col("k"), F.col("idx") + 2 < F.col("n")
    plain = F.when(k % 3 == 0, 4).when(k % 3 == 1, 2).otherwise(100)
    op = (
        F.when(F.col("idx") == F.col("n") - 1, 83).when(F.col("p") == 0, 100).when(F.col("p") == 1, F.when(k % 3 == 0, 122).when(k % 3 == 1, 143).otherwise(154)).when(F.col("p") == 2, 124)
        .when((F.col("p") == 4) & (k % 7 == 0) & more, 93).when((F.col("p") == 6) & (k % 5 == 0) & more & (F.col("idx") < 250), 113).when(F.col("p") == 6, 100).when(F.col("p") == 7, 125).otherwise(plain)
    )
    arg = F.when(op == 93, 1).when(op == 113, F.col("idx") + 2).when(F.col("p") == 1, k % 4 + 1).otherwise(0)
    pair = F.concat(F.lpad(F.hex(op), 2, "0"), F.lpad(F.hex(arg), 2, "0"))
    out = i.groupBy("code_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", pair.alias("h")))), lambda s: s["h"]), "")).alias("code"))
    none = F.array().cast("array<string>")
    return out.withColumns({c: none for c in ("names", "locals", "derefs", "const_kinds", "const_texts")})


def legacy_regions(spark, d):
    """Exception regions of programs of 3.10, with the depth of the stack below them."""
    codes = _legacy_codes(spark, d)
    return legacy.exception_regions(legacy.lifted(decode.wordcode(codes, False, legacy.EXTENDED_ARG), codes)).select("code_id", "start_off", "end_off", "handler_off", "stack_depth", "exc_items")


QUERIES = {f.__name__: f for f in (source_evidence, module_identities, legacy_regions, module_names, relative_imports, source_lines, escaping_paths, wordcode_instructions, wordcode_violations)}

_PATHS = r"""paths AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '[^A-Za-z0-9/]+', '_', 'g'), '/+$', '') AS stem FROM pages),
mods AS (SELECT page_id, array_to_string(list_filter(string_split(stem, '/'), lambda x: x NOT IN ('', '.', '__init__', '__pycache__')), '.') AS module FROM paths)"""
_BYTES = f"""b AS (SELECT code_id, idx, n, CASE WHEN idx = n - 1 THEN 1 WHEN k % 11 = 0 THEN {decode.EXTENDED_ARG} WHEN k % 13 = 0 THEN {decode.CACHE} ELSE k % 40 + 2 END AS op, (k * 7) % 256 AS v FROM instr)"""
_COMPILED = """f AS (SELECT o_orderkey AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(floor(o_totalprice) AS BIGINT) AS price, 'p' || (o_orderkey % 50) || CASE WHEN o_orderkey % 6 = 5 THEN '/q' || o_orderkey ELSE '' END AS folder,
  CASE WHEN o_orderkey % 6 = 5 THEN '__init__' ELSE 'm' || o_orderkey END AS stem FROM orders)"""
ORACLES = {
    "source_evidence": f"""WITH {_COMPILED}, g AS (SELECT *, 'lib/source/' || folder || CASE k % 4 WHEN 0 THEN '/__pycache__/' || stem || '.cpython-313.pyc' WHEN 1 THEN '/__pycache__/' || stem || '.pypy39.pyc' WHEN 2 THEN '/' || stem || '.pyc' ELSE '/__pycache__/' || stem || '.pyc' END AS path,
  k % 4 <> 3 AND k % 5 <> 0 AND k % 17 <> 0 AS headed FROM f), h AS (SELECT *, headed AND k % 9 <> 0 AS timed FROM g)
SELECT path, CASE WHEN k % 4 <> 3 THEN 'lib/source/' || folder || '/' || stem || '.py' END AS candidate, CASE WHEN k % 4 = 3 THEN 'unverified' WHEN k % 5 = 0 THEN 'absent' WHEN NOT timed THEN 'unverified' WHEN k % 11 <> 0 AND k % 13 <> 0 THEN 'matched' ELSE 'mismatch' END AS status,
  CAST(CASE WHEN headed THEN CASE WHEN k % 9 = 0 THEN 3 ELSE 0 END END AS BIGINT) AS flags, CASE WHEN timed THEN k % 11 <> 0 END AS timestamp_matches, CASE WHEN timed THEN k % 13 <> 0 END AS size_matches FROM h""",
    "module_identities": f"""WITH {_COMPILED} SELECT k AS o_orderkey, CASE WHEN k % 4 <> 3 THEN replace(folder, '/', '.') || CASE WHEN stem <> '__init__' THEN '.' || stem ELSE '' END END AS module FROM f""",
    # waves of a breadth-first walk, each in the order of the wave before and of handler, jump, next; later visits never come first
    "legacy_regions": f"""WITH RECURSIVE {X.instructions_sql()}, prog AS (SELECT code_id, idx, n, k, CASE WHEN idx = n - 1 THEN 83 WHEN idx % 8 = 0 THEN 100 WHEN idx % 8 = 1 THEN CASE k % 3 WHEN 0 THEN 122 WHEN 1 THEN 143 ELSE 154 END WHEN idx % 8 = 2 THEN 124
  WHEN idx % 8 = 4 AND k % 7 = 0 AND idx + 2 < n THEN 93 WHEN idx % 8 = 6 AND k % 5 = 0 AND idx + 2 < n AND idx < 250 THEN 113 WHEN idx % 8 = 6 THEN 100 WHEN idx % 8 = 7 THEN 125 ELSE CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 100 END END AS op FROM instr
), setups AS (SELECT code_id, idx, op, n, idx + 2 + k % 4 AS handler FROM prog WHERE op IN (122, 143, 154)
), ways AS (
  SELECT m.code_id, m.idx AS src, s.handler AS dst, 0 AS place, 6 AS delta FROM prog m JOIN setups s ON s.code_id = m.code_id AND m.idx > s.idx AND m.idx < s.handler AND s.handler < s.n
  UNION ALL SELECT code_id, idx, idx + 2, 1, CASE op WHEN 93 THEN -1 ELSE 0 END FROM prog WHERE op IN (93, 113)
  UNION ALL SELECT code_id, idx, idx + 1, 2, CASE WHEN op IN (4, 93, 100, 124, 143) THEN 1 WHEN op = 125 THEN -1 ELSE 0 END FROM prog WHERE op NOT IN (83, 113)
), steps AS (SELECT w.*, p.op FROM ways w JOIN prog p ON p.code_id = w.code_id AND p.idx = w.src
), walk AS (
  SELECT code_id, 0 AS wave, 0 AS node, 0 AS depth, 0 AS below, CAST(1 AS BIGINT) AS place FROM prog WHERE idx = 0
  UNION ALL SELECT code_id, wave + 1, dst, CASE step WHEN 0 THEN below ELSE depth END + delta, below, row_number() OVER (PARTITION BY code_id ORDER BY place, step)
  FROM (SELECT w.code_id, w.wave, s.dst, w.depth, s.delta, w.place, s.place AS step, CASE WHEN s.op IN (122, 143) THEN w.depth WHEN s.op = 154 THEN greatest(w.depth - 1, 0) ELSE w.below END AS below
    FROM walk w JOIN steps s ON s.code_id = w.code_id AND s.src = w.node QUALIFY row_number() OVER (PARTITION BY w.code_id, s.dst ORDER BY w.place, s.place) = 1)
), visited AS (SELECT code_id, node, arg_min(depth, wave) AS depth FROM walk GROUP BY code_id, node)
SELECT s.code_id, CAST(2 * (s.idx + 1) AS INT) AS start_off, CAST(2 * s.handler AS INT) AS end_off, CAST(2 * s.handler AS INT) AS handler_off, CAST(coalesce(CASE s.op WHEN 154 THEN greatest(v.depth - 1, 0) ELSE v.depth END, 0) AS INT) AS stack_depth, 6 AS exc_items
FROM setups s LEFT JOIN visited v ON v.code_id = s.code_id AND v.node = s.idx""",
    "module_names": f"WITH {_PATHS} SELECT * FROM mods",
    "relative_imports": f"""WITH {_PATHS}, l AS (SELECT page_id, string_split(module, '.') AS p, unnest([0, 1, 2, 3]) AS level FROM mods)
SELECT page_id, level, CASE WHEN level = 0 THEN 'helper' ELSE array_to_string(list_append(p[1:greatest(len(p) - (level - 1), 0)], 'helper'), '.') END AS module FROM l""",
    "source_lines": """SELECT doc_id, count(*) FILTER (WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#')) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""",
    "escaping_paths": "SELECT page_id, page_id % 3 = 1 AS escapes FROM pages",
    # an instruction takes the prefixes since the last one that was none
    "wordcode_instructions": f"""WITH {X.instructions_sql()}, {_BYTES}, g AS (SELECT *, coalesce(max(idx) FILTER (WHERE op <> {decode.EXTENDED_ARG}) OVER (PARTITION BY code_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev FROM b)
SELECT e.code_id, CAST(2 * (e.prev + 1) AS INT) AS off, e.op AS opcode, CAST(sum(p.v * power(256, e.idx - p.idx)) AS BIGINT) AS arg, CAST(e.idx - e.prev - 1 AS INT) AS prefix_size
FROM g e JOIN b p ON p.code_id = e.code_id AND p.idx > e.prev AND p.idx <= e.idx WHERE e.op NOT IN ({decode.EXTENDED_ARG}, {decode.CACHE}) AND e.idx - e.prev - 1 < 6 GROUP BY e.code_id, e.prev, e.idx, e.op""",
    "wordcode_violations": f"""WITH {X.instructions_sql()}, {_BYTES} SELECT 'odd wordcode' AS problem, count(*) AS n FROM b WHERE idx = n - 1 AND code_id % 3 = 0 HAVING count(*) > 0
UNION ALL SELECT 'prefix without instruction', count(*) FROM b WHERE idx = n - 2 AND code_id % 3 = 1 AND op = {decode.EXTENDED_ARG} HAVING count(*) > 0""",
}
