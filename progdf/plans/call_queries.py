"""Points-to, call-graph, binding, protocol and sink queries over encoded tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from progdf.functions import dot
from progdf.functions.scratch import saved
from progdf.operators import binding as B
from progdf.operators import callgraph as G
from progdf.operators import cdg, cfg, pta

from . import encodings as X
from .encodings import table


def _counted():
    """Members of a set: their number and sum."""
    return F.count("*").alias("n"), F.sum("object").alias("total")


def _keys(spark, d) -> pta.Constraints:
    """orders point to their customers' objects; values are copied to customers, nations and regions."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    value = lambda col, kind: F.col(col).cast("long") * 10 + kind
    address = o.where("o_orderkey % 5 = 0").select(value("o_orderkey", 1).alias("value"), (F.col("o_orderkey") + 1).alias("object"))
    address = address.unionByName(o.where("o_orderkey % 97 = 0").select(value("o_orderkey", 1).alias("value"), F.lit(-1).cast("long").alias("object")))
    copy = o.select(value("o_orderkey", 1).alias("src"), value("o_custkey", 2).alias("dst"))
    copy = copy.unionByName(c.select(value("c_custkey", 2).alias("src"), value("c_nationkey", 3).alias("dst"))).unionByName(n.select(value("n_nationkey", 3).alias("src"), value("n_regionkey", 4).alias("dst")))
    return pta.Constraints(spark, {"address": address, "copy": copy})


def pta_copies(spark, d):
    """Number and sum of the members of every set, before widening."""
    return pta.solution(_keys(spark, d), widen=False).per_value(*_counted())


def pta_widened(spark, d):
    return pta.solution(_keys(spark, d)).per_value(*_counted())


def pta_statistics(spark, d):
    c = _keys(spark, d)
    return pta.statistics(pta.solve(c, widen=False), c)


def _fields(spark, d) -> pta.Constraints:
    """Suppliers hold parts in fields by brand, stored through order lines; loads by line: exact, of any field, of the unknown."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    x = line.join(part.select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("brand")), "l_partkey")
    x = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), "brand", "l_linenumber")
    x = saved(x, "lines")  # all constraints are made of it; those that repeat count once
    v = lambda kind: F.col("line") * 10 + kind
    obj = lambda col: F.col(col) * 2 + 2
    address = x.select(v(1).alias("value"), obj("s").alias("object")).unionByName(x.select(v(2).alias("value"), (F.col("p") * 2 + 3).alias("object")))
    address = address.unionByName(x.where("l_linenumber = 7").select(v(1).alias("value"), F.lit(-1).cast("long").alias("object")))
    even, odd = x.where("line % 2 = 0"), x.where("line % 2 = 1")
    store = even.select(v(2).alias("src"), v(1).alias("base"), F.when(F.col("brand") % 6 == 0, 0).otherwise(F.col("brand")).alias("field"))
    load = odd.select(v(1).alias("base"), F.when(F.col("brand") % 5 == 0, 0).otherwise(F.col("brand")).alias("field"), v(3).alias("dst"))
    return pta.Constraints(spark, {"address": address, "field_store": store, "field_load": load, "store": odd.select(v(2).alias("src"), v(1).alias("ptr")), "load": even.select(v(1).alias("ptr"), v(4).alias("dst"))})


def pta_field_facts(spark, d):
    return pta.fields(pta.held(_fields(spark, d), widen=False)).groupBy("base", "field").agg(F.count("*").alias("n"), F.sum("object").alias("total"))


def pta_content_facts(spark, d):
    return pta.contents(pta.held(_fields(spark, d), widen=False)).groupBy("base").agg(F.count("*").alias("n"), F.sum("object").alias("total"))


def pta_loads(spark, d):
    """Number and sum of what every load reads, aggregated once for each class of loads."""
    return pta.solution(_fields(spark, d), widen=False).per_value(*_counted()).where("value % 10 >= 3")


def _calls(spark, d):
    line = table(spark, d, "lineitem")
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), (F.col("l_orderkey") + 1).alias("caller"), F.when(F.col("l_discount") >= 0.02, F.col("l_suppkey") * 3 + 1).alias("target"), "l_returnflag", "l_linestatus")


def cg_nodes(spark, d):
    return G.nodes(_calls(spark, d))


def cg_groups(spark, d):
    return G.with_groups(_calls(spark, d), ["l_returnflag", "l_linestatus"]).groupBy("group_id").agg(F.count("*").alias("n"))


def cg_targets(spark, d):
    e = _calls(spark, d)
    return G.targets(e, e.where("site % 4 = 0"))


def cg_violations(spark, d):
    e = _calls(spark, d)
    return G.violations(e.unionByName(e.where("site % 50 = 3").withColumn("caller", F.col("caller") + 1))).groupBy("problem").agg(F.count("*").alias("n"))


def cg_resolved(spark, d):
    """Sites resolved where a callee's set holds suppliers of even key, which are callable."""
    line, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    site = line.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), F.col("l_orderkey").alias("caller")).agg(F.min("l_partkey").alias("callee"))
    points = line.where("l_linenumber <= 2").select(F.col("l_partkey").alias("value"), F.col("l_suppkey").alias("object")).distinct()
    out = G.resolve(site, points, s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("object"), (F.col("s_suppkey") + 1000).alias("code")))
    return out.select("site", "caller", F.coalesce("target", F.lit(0)).alias("target"))


def cg_reachable(spark, d):
    """Customers that orders' customers reach: each customer calls those of twice and of thrice its key."""
    c = table(spark, d, "customer").select("c_custkey")
    top = c.agg(F.max("c_custkey").alias("top"))
    e = c.withColumn("t", F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 3))).crossJoin(F.broadcast(top)).where("t <= top")
    return G.reachable(e.select((F.col("c_custkey") * 10).alias("site"), F.col("c_custkey").alias("caller"), F.col("t").alias("target")), c.where("c_custkey IN (1, 7)").select(F.col("c_custkey").alias("code")))


def cg_report(spark, d):
    """Counts and distinct pairs as one record."""
    e = _calls(spark, d)
    return dot.record(e.agg(F.count("*").alias("edges"), F.count("target").alias("resolved"), F.countDistinct(F.when(F.col("target").isNotNull(), F.struct("caller", "target"))).alias("pairs"), F.countDistinct("caller").alias("callers")))


def cg_dot(spark, d):
    e = _calls(spark, d).withColumn("label", F.concat_ws("/", "l_returnflag", "l_linestatus"))
    return dot.cg_lines(e.distinct()).select("place", "line")


def _args(spark, d):
    """Call sites of orders: argument per line, names by return flag; bodies by order status."""
    # both are dealt by site into tasks of a bounded size, and all that follows stays in these
    o, line = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("body")), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    a = line.join(o.hint("merge"), "l_orderkey")
    a = a.select(F.col("l_orderkey").alias("site"), "body", (F.col("l_linenumber") - 1).alias("pos"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("p"), (F.col("l_linenumber") % 5).cast("string"))).alias("keyword"), (F.col("l_orderkey") % 11 == 0).alias("expanded"))
    rows = [("F", 0, "p0", "positional_only"), ("F", 1, "p1", "positional"), ("F", 2, "p2", "positional"), ("F", 3, "args", "varargs"), ("F", 4, "p3", "keyword_only"), ("F", 5, "kw", "kwargs"), ("O", 0, "p0", "positional"), ("O", 1, "p1", "positional"), ("O", 2, "p4", "keyword_only"), ("P", 0, "p0", "positional"), ("P", 1, "rest", "varargs")]
    return a, spark.createDataFrame(rows, "body string, formal_pos int, name string, kind string")


def binding_pairs(spark, d):
    # one argument of a site in each place, taken by least keyword where lines repeat
    a, f = _args(spark, d)
    return B.bind(a.groupBy("site", "body", "pos", "expanded").agg(F.min("keyword").alias("keyword")), f)


def binding_missing(spark, d):
    a, f = _args(spark, d)
    return B.missing(a.groupBy("site", "body", "pos", "expanded").agg(F.min("keyword").alias("keyword")), f)


def protocol_dispatch(spark, d):
    op = F.col("opcode")
    i = X.instructions(spark, d)
    return i.groupBy(op, B.family(op).alias("family"), B.operation(op).alias("operation"), F.array_join(B.candidates(op), ",").alias("methods")).agg(F.count("*").alias("n"))


def binary_protocols(spark, d):
    """Methods of binary and comparison operands."""
    k = X.instructions(spark, d).select((F.col("k") % 27).alias("operand")).distinct()
    return k.select("operand", F.array_join(B.binary_methods(F.col("operand")), ",").alias("binary"), F.array_join(B.comparison_methods(F.col("operand")), ",").alias("comparison"))


def selected_methods(spark, d):
    """Which of add and radd are called, by which are there and which may give up."""
    p = table(spark, d, "part")
    wanted = F.array(F.lit("add"), F.lit("radd"))
    pick = lambda c, m: F.when(c, F.array(F.lit(m))).otherwise(F.array().cast("array<string>"))
    there = F.concat(pick(F.col("p_size") % 2 == 0, "add"), pick(F.col("p_size") % 3 == 0, "radd"))
    return p.select("p_partkey", F.array_join(B.selected(F.lit("arithmetic"), wanted, there, pick(F.col("p_partkey") % 2 == 0, "add")), ",").alias("methods"))


def inherited_members(spark, d):
    """Nations inherit from their region, regions from the first; suppliers name members."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    cls = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("class"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("base"), F.lit(0).alias("place"))
    cls = cls.unionByName(n.where("n_regionkey > 0").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("class"), F.lit("r0").alias("base"), F.lit(0).alias("place")).distinct())
    name = F.concat(F.lit("m"), (F.col("s_suppkey") % 7).cast("string"))
    own = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string"))).alias("class"), name.alias("name")).distinct()
    return G.inherited(cls, own)


def cfg_dot(spark, d):
    i = X.instructions(spark, d)
    p = cfg.with_blocks(i)
    return dot.cfg_document(p, cfg.edges(p))


def cdg_dot(spark, d):
    i = X.instructions(spark, d)
    p = cfg.with_blocks(i)
    e = cfg.edges(p)
    return dot.cdg_document(cdg.control_dependence(e, cdg.post_dominance(cfg.blocks(p), e)))


def pipeline_summary(spark, d):
    """Cardinalities of the flow relations as one record."""
    i = X.instructions(spark, d)
    p = cfg.with_blocks(i)
    e = cfg.edges(p)
    n = p.agg(F.countDistinct("code_id").alias("codes"), F.count("*").alias("instructions"), F.count(F.when(F.col("is_last"), 1)).alias("blocks")).crossJoin(F.broadcast(e.agg(F.count("*").alias("edges"))))
    return dot.record(n.select(F.lit(2).alias("schema_version"), "codes", "instructions", F.struct("blocks", "edges").alias("cfg")))


QUERIES = {f.__name__: f for f in (
    pta_copies, pta_widened, pta_statistics, pta_field_facts, pta_content_facts, pta_loads, cg_nodes, cg_groups, cg_targets, cg_violations, cg_resolved, cg_reachable, cg_report, cg_dot, binding_pairs,
    binding_missing, protocol_dispatch, binary_protocols, selected_methods, inherited_members, cfg_dot, cdg_dot, pipeline_summary,
)}

_KEYS = """addr AS (SELECT o_orderkey * 10 + 1 AS v, o_orderkey + 1 AS o, o_custkey FROM orders WHERE o_orderkey % 5 = 0 UNION SELECT o_orderkey * 10 + 1, -1, o_custkey FROM orders WHERE o_orderkey % 97 = 0),
cust AS (SELECT DISTINCT o_custkey * 10 + 2 AS v, o, c_nationkey FROM addr JOIN customer ON c_custkey = o_custkey), nat AS (SELECT DISTINCT c_nationkey * 10 + 3 AS v, o, n_regionkey FROM cust JOIN nation ON n_nationkey = c_nationkey),
reg AS (SELECT DISTINCT n_regionkey * 10 + 4 AS v, o FROM nat), pts AS (SELECT v, o FROM addr UNION SELECT v, o FROM cust UNION SELECT o_custkey * 10 + 2, o FROM addr UNION SELECT v, o FROM nat UNION SELECT v, o FROM reg)"""
_FIELDS = """x AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS line, l_suppkey AS s, l_partkey AS p, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS brand, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT line * 10 + 1 AS v, s * 2 + 2 AS o FROM x UNION SELECT line * 10 + 2, p * 2 + 3 FROM x UNION SELECT line * 10 + 1, -1 FROM x WHERE l_linenumber = 7),
fld AS (SELECT DISTINCT b.o AS base, CASE WHEN brand % 6 = 0 THEN 0 ELSE brand END AS field, CASE WHEN b.o = -1 THEN -1 ELSE y.o END AS o FROM x JOIN a b ON b.v = line * 10 + 1 JOIN a y ON y.v = line * 10 + 2 WHERE line % 2 = 0),
cont AS (SELECT DISTINCT b.o AS base, CASE WHEN b.o = -1 THEN -1 ELSE y.o END AS o FROM x JOIN a b ON b.v = line * 10 + 1 JOIN a y ON y.v = line * 10 + 2 WHERE line % 2 = 1),
fl AS (SELECT line * 10 + 1 AS v, CASE WHEN brand % 5 = 0 THEN 0 ELSE brand END AS field, line * 10 + 3 AS dst FROM x WHERE line % 2 = 1), ld AS (SELECT line * 10 + 1 AS v, line * 10 + 4 AS dst FROM x WHERE line % 2 = 0),
got AS (SELECT dst AS v, -1 AS o FROM fl JOIN a USING (v) WHERE a.o = -1 UNION SELECT dst, f.o FROM fl JOIN a USING (v) JOIN fld f ON f.base IN (a.o, -1) AND (f.field = fl.field OR f.field = 0 OR fl.field = 0) WHERE a.o <> -1
  UNION SELECT dst, -1 FROM ld JOIN a USING (v) WHERE a.o = -1 UNION SELECT dst, c.o FROM ld JOIN a USING (v) JOIN cont c ON c.base IN (a.o, -1) WHERE a.o <> -1)"""
_CALLS = """calls AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_orderkey + 1 AS caller, CASE WHEN l_discount >= 0.02 THEN l_suppkey * 3 + 1 END AS target, l_returnflag, l_linestatus FROM lineitem)"""
_ARGS = """act AS (SELECT l_orderkey AS site, o_orderstatus AS body, l_linenumber - 1 AS pos, min(CASE WHEN l_returnflag = 'A' THEN 'p' || (l_linenumber % 5) END) AS keyword, l_orderkey % 11 = 0 AS expanded FROM (SELECT * FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 5),
form AS (SELECT * FROM (VALUES ('F',0,'p0','positional_only'),('F',1,'p1','positional'),('F',2,'p2','positional'),('F',3,'args','varargs'),('F',4,'p3','keyword_only'),('F',5,'kw','kwargs'),('O',0,'p0','positional'),('O',1,'p1','positional'),('O',2,'p4','keyword_only'),('P',0,'p0','positional'),('P',1,'rest','varargs')) t(body, formal_pos, name, kind)),
has AS (SELECT body, bool_or(kind = 'varargs') AS va, bool_or(kind = 'kwargs') AS kw FROM form GROUP BY body),
hit AS (SELECT a.*, (SELECT count(*) FROM form f WHERE f.body = a.body AND f.kind LIKE 'positional%' AND f.formal_pos = a.pos) AS byp, (SELECT count(*) FROM form f WHERE f.body = a.body AND f.kind IN ('positional', 'keyword_only') AND f.name = a.keyword) AS byk FROM act a),
bound AS (SELECT DISTINCT a.site, a.pos, f.formal_pos FROM hit a JOIN form f USING (body) JOIN has h USING (body) WHERE CASE WHEN a.expanded THEN true
  WHEN a.keyword IS NULL THEN CASE WHEN byp > 0 THEN f.kind LIKE 'positional%' AND f.formal_pos = a.pos WHEN h.va THEN f.kind = 'varargs' ELSE true END
  ELSE CASE WHEN byk > 0 THEN f.kind IN ('positional', 'keyword_only') AND f.name = a.keyword WHEN h.kw THEN f.kind = 'kwargs' ELSE true END END)"""

ORACLES = {
    "pta_copies": f"WITH {_KEYS} SELECT v AS value, count(*) AS n, sum(o)::BIGINT AS total FROM pts GROUP BY v",
    "pta_widened": f"""WITH {_KEYS}, r AS (SELECT v, o, max((o = -1)::INT) OVER (PARTITION BY v) AS u, row_number() OVER (PARTITION BY v ORDER BY o <> -1, o) AS k FROM pts)
SELECT v AS value, count(*) AS n, sum(o)::BIGINT AS total FROM r WHERE u = 0 OR k <= 17 GROUP BY v""",
    "pta_statistics": f"""WITH {_KEYS} SELECT count(*) AS points_to, 0 AS contents, 0 AS fields, count(*) FILTER (WHERE o = -1) AS unknown, count(DISTINCT v) AS values, count(DISTINCT o) AS objects,
  (SELECT count(*) FROM (SELECT v, o FROM addr)) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS constraints FROM pts""",
    "pta_field_facts": f"WITH {_FIELDS} SELECT base, field, count(*) AS n, sum(o)::BIGINT AS total FROM fld GROUP BY base, field",
    "pta_content_facts": f"WITH {_FIELDS} SELECT base, count(*) AS n, sum(o)::BIGINT AS total FROM cont GROUP BY base",
    "pta_loads": f"WITH {_FIELDS} SELECT v AS value, count(*) AS n, sum(o)::BIGINT AS total FROM got GROUP BY v",
    "cg_nodes": f"""WITH {_CALLS} SELECT coalesce(o.code, i.code) AS code, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM (SELECT caller AS code, count(*) AS out_degree FROM calls GROUP BY 1) o FULL JOIN (SELECT target AS code, count(*) AS in_degree FROM calls WHERE target IS NOT NULL GROUP BY 1) i ON o.code = i.code""",
    "cg_groups": f"""WITH {_CALLS}, g AS (SELECT l_returnflag, l_linestatus, dense_rank() OVER (ORDER BY l_returnflag, l_linestatus) AS id FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM calls WHERE target IS NULL))
SELECT CASE WHEN c.target IS NULL THEN g.id ELSE 0 END AS group_id, count(*) AS n FROM calls c LEFT JOIN g USING (l_returnflag, l_linestatus) GROUP BY 1""",
    "cg_targets": f"WITH {_CALLS} SELECT DISTINCT site, target FROM calls WHERE target IS NOT NULL AND site % 4 = 0",
    "cg_violations": f"WITH {_CALLS} SELECT 'several callers' AS problem, count(DISTINCT site) AS n FROM calls WHERE site % 50 = 3 HAVING count(*) > 0",
    "cg_resolved": """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_orderkey AS caller, min(l_partkey) AS callee FROM lineitem GROUP BY 1, 2), p AS (SELECT DISTINCT l_partkey AS v, l_suppkey AS o FROM lineitem WHERE l_linenumber <= 2)
SELECT site, caller, o + 1000 AS target FROM s JOIN p ON v = callee WHERE o % 2 = 0 UNION SELECT site, caller, 0 FROM s LEFT JOIN p ON v = callee WHERE o IS NULL OR o % 2 <> 0""",
    "cg_reachable": """WITH RECURSIVE r AS (SELECT c_custkey AS code FROM customer WHERE c_custkey IN (1, 7) UNION SELECT code * k FROM r, (VALUES (2), (3)) t(k) WHERE code * k <= (SELECT max(c_custkey) FROM customer)) SELECT code FROM r""",
    "cg_report": f"""WITH {_CALLS} SELECT '{{"edges":' || count(*) || ',"resolved":' || count(target) || ',"pairs":' || count(DISTINCT CASE WHEN target IS NOT NULL THEN caller || '/' || target END) || ',"callers":' || count(DISTINCT caller) || '}}' AS record FROM calls""",
    "cg_dot": f"""WITH {_CALLS}, e AS (SELECT DISTINCT site, caller, target, l_returnflag || '/' || l_linestatus AS label FROM calls)
SELECT 0 AS place, '  c' || caller || ';' AS line FROM e UNION SELECT 0, '  c' || target || ';' FROM e WHERE target IS NOT NULL UNION SELECT 1, '  c' || caller || ' -> c' || target || ';' FROM e WHERE target IS NOT NULL
UNION ALL SELECT 2, '  u' || site || ' [label="' || label || '"];' FROM e WHERE target IS NULL UNION ALL SELECT 3, '  c' || caller || ' -> u' || site || ' [style=dashed];' FROM e WHERE target IS NULL""",
    "binding_pairs": f"WITH {_ARGS} SELECT site, pos, formal_pos FROM bound",
    "binding_missing": f"""WITH {_ARGS} SELECT DISTINCT a.site, a.body, f.formal_pos FROM act a JOIN form f USING (body) WHERE f.kind LIKE 'positional%' AND NOT EXISTS (SELECT 1 FROM bound b WHERE b.site = a.site AND b.formal_pos = f.formal_pos)""",
    "protocol_dispatch": f"""WITH {X.instructions_sql()} SELECT opcode, CASE WHEN opcode = 'ConditionalBranch' THEN 'Truthiness' ELSE 'None' END AS family, CASE WHEN opcode = 'ConditionalBranch' THEN 'Truth' ELSE 'DynamicCall' END AS operation,
  CASE WHEN opcode = 'ConditionalBranch' THEN 'bool,len' ELSE '' END AS methods, count(*) AS n FROM instr GROUP BY opcode""",
    "binary_protocols": f"""WITH {X.instructions_sql()}, q AS (SELECT DISTINCT k % 27 AS operand FROM instr), n AS (SELECT *, ['add','and','floordiv','lshift','matmul','mul','mod','or','pow','rshift','sub','truediv','xor'][operand % 13 + 1] AS m FROM q)
SELECT operand, CASE WHEN operand = 26 THEN 'getitem' ELSE CASE WHEN operand >= 13 THEN 'i' || m || ',' ELSE '' END || m || ',r' || m END AS binary, coalesce(['lt,gt','le,ge','eq','ne','gt,lt','ge,le'][operand + 1], '') AS comparison FROM n""",
    "selected_methods": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'add,radd' ELSE 'add' END WHEN p_size % 3 = 0 THEN 'radd' ELSE '' END AS methods FROM part""",
    "inherited_members": """WITH RECURSIVE cls AS (SELECT 'n' || n_nationkey AS class, 'r' || n_regionkey AS base FROM nation UNION SELECT 'r' || n_regionkey, 'r0' FROM nation WHERE n_regionkey > 0),
own AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_nationkey ELSE 'r' || (s_nationkey % 5) END AS class, 'm' || (s_suppkey % 7) AS name FROM supplier),
up AS (SELECT class, class AS base, 0 AS d FROM (SELECT class FROM cls UNION SELECT base FROM cls UNION SELECT class FROM own) UNION SELECT u.class, c.base, u.d + 1 FROM up u JOIN cls c ON c.class = u.base)
SELECT u.class, o.name, min_by(o.class, u.d) AS owner FROM up u JOIN own o ON o.class = u.base GROUP BY u.class, o.name""",
    "cfg_dot": f"""WITH {X.cfg_sql()}, b AS (SELECT code_id, block_id, min(off) AS s, string_agg(off, ' ' ORDER BY off) AS offs FROM placed GROUP BY ALL),
l AS (SELECT code_id, block_id::BIGINT AS place, '  b' || block_id || ' [label="B' || block_id || ' @' || s || '\\n' || offs || '"];' AS line FROM b UNION ALL SELECT code_id, (1::BIGINT << 40) + src * 1048576 + dst, '  b' || src || ' -> b' || dst || ' [label="' || kind || '"];' FROM edges)
SELECT code_id, 'digraph "cfg" {{' || chr(10) || string_agg(line, chr(10) ORDER BY place, line) || chr(10) || '}}' || chr(10) AS document FROM l GROUP BY code_id""",
    "cdg_dot": f"""WITH RECURSIVE {X.cfg_sql()}{X.CDG_SQL} SELECT code_id, 'digraph "cdg" {{' || chr(10) || string_agg('  b' || controller || ' -> b' || dependent || ' [label="' || outcome || '"];', chr(10) ORDER BY controller, dependent, outcome) || chr(10) || '}}' || chr(10) AS document
FROM cdg GROUP BY code_id""",
    "pipeline_summary": f"""WITH {X.cfg_sql()} SELECT '{{"schema_version":2,"codes":' || count(DISTINCT code_id) || ',"instructions":' || count(*) || ',"cfg":{{"blocks":' || count(*) FILTER (WHERE is_last) || ',"edges":' || (SELECT count(*) FROM edges) || '}}}}' AS record FROM placed""",
}
