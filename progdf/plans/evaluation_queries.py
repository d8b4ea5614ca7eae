"""Evaluation, sampling and profiling queries over encoded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdf.operators import evaluate as V

from .encodings import table


def _cases(spark, d) -> DataFrame:
    """A case for each labelled document: its marks are what is expected and forbidden, its length what was found; every seventh has no result."""
    doc, lab = table(spark, d, "documents"), table(spark, d, "labels")
    x = lab.join(doc.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    mark = lambda c, yes, no: F.when(c, F.lit(yes)).otherwise(F.lit(no))
    expected = F.array(mark(F.col("quality") == 1, "good", "bad"), mark(F.col("toxic") == 1, "toxic", "clean"))
    forbidden = F.array(mark(F.col("quality") == 1, "bad", "good"), mark(F.col("toxic") == 1, "clean", "toxic"))
    actual = F.when(F.col("doc_id") % 7 != 0, F.array(mark(F.col("n_chars") > 300, "good", "bad"), F.lit("clean")))
    return x.select("doc_id", "lang", "source", F.array("lang", "source").alias("tags"), expected.alias("expected"), forbidden.alias("forbidden"), actual.alias("actual"))


def score_queries(spark, d):
    return V.score(_cases(spark, d)).select("doc_id", "tp", "fn", "fp", "tn", "sound", "passed")


_RATES = ("precision", "recall", "sound_rate", "pass_rate")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def score_roll_up(spark, d):
    return _rounded(V.roll_up(V.score(_cases(spark, d)), ["lang", "source", "tags"]), *_RATES)


def score_by_lang(spark, d):
    return _rounded(V.finish(V.score(_cases(spark, d)), "lang"), *_RATES)


def candidate_universe(spark, d):
    out = V.candidate_universe(_cases(spark, d), "lang", "source")
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "positive", "negative")


def _chain(spark, d):
    c = table(spark, d, "conversations")
    return c.selectExpr("conv_id", "turn AS src").join(c.selectExpr("conv_id", "turn AS dst"), "conv_id").where("dst > src AND dst <= src + 2")


def edge_verdicts(spark, d):
    """Edges to the next turn are required, to the one after that forbidden; edges of every third turn were not found."""
    e = _chain(spark, d)
    out = V.compare_edges(e.withColumn("required", F.expr("dst = src + 1")), e.where("src % 3 <> 0"), ["conv_id", "src", "dst"])
    return out.groupBy("verdict").agg(F.count("*").alias("n"))


def path_composition(spark, d):
    p = V.simple_paths(_chain(spark, d), 5, ("conv_id",))
    return p.select("conv_id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def path_subpaths(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("path"))
    return V.subpaths(c, ("conv_id",)).select("conv_id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def path_checks(spark, d):
    """Do the turns of a conversation follow each other in the edges of even turns?"""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    paths = c.select(F.col("conv_id").alias("path_id"), F.transform(F.slice("turns", 1, 2), lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))).alias("path"))
    e = _chain(spark, d).where("dst = src + 1 AND conv_id % 3 <> 0").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("src").cast("string")).alias("src"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("dst").cast("string")).alias("dst"))
    return V.paths_hold(paths, e).select("path_id", "holds")


def metric_summary(spark, d):
    return V.metric_summary(table(spark, d, "events"), "value", "event_type")


def value_distribution(spark, d):
    return _rounded(V.distribution(table(spark, d, "events"), "value", "event_type"), "q1", "q2", "q3", "iqr", "mean", "sd", "cv")


def stratum_medians(spark, d):
    return V.stratum_medians(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "doc_id", 3, "lang")


def stratified_sample(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    return V.stratified_sample(doc, "n_chars", "doc_id", 10, 5, doc.where("doc_id % 4 = 0")).select("doc_id", "portion", "place")


def manifest_violations(spark, d):
    return V.manifest_violations(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus", 100).groupBy("problem").agg(F.count("*").alias("n"))


def _runs(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_type").alias("analyzer"), F.concat(F.lit("3."), (10 + k % 5).cast("string")).alias("version"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("portion"), F.when(k % 10 == 0, "failed").otherwise("ok").alias("status"), F.col("user_id").alias("package"), F.col("event_id"), (F.col("event_id") * 37 % 1000).alias("wall_ns"), k.alias("k"))


def campaign_roll_up(spark, d):
    out = V.campaign(_runs(spark, d), "wall_ns", [["analyzer", "version"], ["analyzer"], ["analyzer", "version", "portion"]])
    return out.select("analyzer", F.coalesce("version", F.lit("all")).alias("version"), F.coalesce("portion", F.lit("all")).alias("portion"), "runs", "completed", "total", "most")


def status_histogram(spark, d):
    h = V.histogram(_runs(spark, d), "status", "analyzer")
    return h.select("analyzer", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("histogram"))


def phase_costs(spark, d):
    r = _runs(spark, d).select(F.col("analyzer").alias("phase"), "status", "wall_ns", (F.col("wall_ns") / 2).cast("long").alias("cpu_ns"), F.col("k").alias("rss_start"), (F.col("event_id") % 50).alias("rss_end"), (F.col("k") + 60).alias("rss_peak"))
    return V.phase_costs(r).withColumn("rss_growth", F.col("rss_growth").cast("long"))


def cross_version(spark, d):
    r = _runs(spark, d).withColumn("expected", F.col("package") % 2)
    return V.cross_version(r, "package", "version", "status", "expected")


def version_deltas(spark, d):
    return V.set_deltas(_runs(spark, d).where("package % 3 = cast(substr(version, 4) as int) % 3"), "version", "package")


def package_groups(spark, d):
    return V.package_groups(table(spark, d, "part"), "p_brand", "p_name")


def failure_statuses(spark, d):
    doc = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Out of MEMORY "), "text")).when(F.col("doc_id") % 5 == 1, F.lit("run Timed out")).when(F.col("doc_id") % 5 == 2, F.lit("")).when(F.col("doc_id") % 5 == 3, F.lit("unsupported opcode")).otherwise(F.lit("crash"))
    return doc.select(V.failure_status(text).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def latest_releases(spark, d):
    p = table(spark, d, "part")
    v = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0rc1"))).otherwise(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string")))
    return V.latest_stable(p.select(F.col("p_brand").alias("name"), v.alias("version")))


QUERIES = {f.__name__: f for f in (
    score_queries, score_roll_up, score_by_lang, candidate_universe, edge_verdicts, path_composition, path_subpaths, path_checks, metric_summary, value_distribution, stratum_medians,
    stratified_sample, manifest_violations, campaign_roll_up, status_histogram, phase_costs, cross_version, version_deltas, package_groups, failure_statuses, latest_releases,
)}

_CASES = """cases AS (
  SELECT l.doc_id, lang, source, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS e1, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS e2,
    CASE WHEN l.doc_id % 7 <> 0 THEN CASE WHEN n_chars > 300 THEN 'good' ELSE 'bad' END ELSE '-' END AS a1, CASE WHEN l.doc_id % 7 <> 0 THEN 'clean' ELSE '-' END AS a2
  FROM labels l JOIN documents d USING (doc_id)
), scored AS (
  SELECT doc_id, lang, source, tp, 2 - tp AS fn, CASE WHEN a1 = '-' THEN 0 ELSE 2 - tp END AS fp, CASE WHEN a1 = '-' THEN 2 ELSE tp END AS tn, tp = 2 AS sound, tp = 2 AS passed
  FROM (SELECT *, (e1 = a1)::INT + (e2 = a2)::INT AS tp FROM cases)
)"""
_FINISH = """count(*) AS queries, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(sound::INT)::BIGINT AS n_sound, sum(passed::INT)::BIGINT AS n_passed,
  round(CASE WHEN sum(tp) + sum(fp) = 0 THEN 1.0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fp)) END, 6) AS precision, round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 1.0 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fn)) END, 6) AS recall,
  round(sum(sound::INT)::DOUBLE / count(*), 6) AS sound_rate, round(sum(passed::INT)::DOUBLE / count(*), 6) AS pass_rate"""
_CHAIN = "chain AS (SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 2)"
_RUNS = """runs AS (SELECT event_type AS analyzer, '3.' || (10 + k % 5) AS version, 'p' || (k % 3) AS portion, CASE WHEN k % 10 = 0 THEN 'failed' ELSE 'ok' END AS status, user_id AS package, event_id, event_id * 37 % 1000 AS wall_ns, k
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events))"""

ORACLES = {
    "score_queries": f"WITH {_CASES} SELECT doc_id, tp, fn, fp, tn, sound, passed FROM scored",
    "score_roll_up": f"""WITH {_CASES}, g AS (SELECT *, 'overall' AS dimension, 'all' AS value FROM scored UNION ALL SELECT *, 'lang', lang FROM scored UNION ALL SELECT *, 'source', source FROM scored
  UNION ALL SELECT *, 'tags', lang FROM scored UNION ALL SELECT *, 'tags', source FROM scored) SELECT dimension, value, {_FINISH} FROM g GROUP BY dimension, value""",
    "score_by_lang": f"WITH {_CASES} SELECT lang, {_FINISH} FROM scored GROUP BY lang",
    "candidate_universe": f"WITH {_CASES} SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, 2 * count(*) AS positive, 2 * count(*) AS negative FROM cases GROUP BY ROLLUP (lang, source)",
    "edge_verdicts": f"""WITH {_CHAIN} SELECT CASE WHEN dst = src + 1 THEN CASE WHEN src % 3 <> 0 THEN 'tp' ELSE 'fn' END ELSE CASE WHEN src % 3 <> 0 THEN 'fp' ELSE 'tn' END END AS verdict, count(*) AS n FROM chain GROUP BY 1""",
    "path_composition": f"""WITH RECURSIVE {_CHAIN}, walk AS (SELECT conv_id, [src, dst] AS path FROM chain
  UNION SELECT w.conv_id, list_append(w.path, c.dst) FROM walk w JOIN chain c ON c.conv_id = w.conv_id AND c.src = w.path[-1] WHERE NOT list_contains(w.path, c.dst) AND len(w.path) < 5)
SELECT conv_id, array_to_string(path, '>') AS path FROM walk WHERE len(path) >= 3""",
    "path_subpaths": """WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS p FROM conversations GROUP BY conv_id), i AS (SELECT conv_id, p, unnest(range(1, len(p) - 1)) AS a FROM c), j AS (SELECT *, unnest(range(a + 2, len(p) + 1)) AS b FROM i)
SELECT DISTINCT conv_id, array_to_string(p[a:b], '>') AS path FROM j""",
    "path_checks": """SELECT conv_id AS path_id, count(*) = 1 OR (conv_id % 3 <> 0 AND min(turn) FILTER (WHERE r = 2) = min(turn) FILTER (WHERE r = 1) + 1) AS holds
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2 GROUP BY conv_id""",
    "metric_summary": """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS count, min(value) AS min, median(value) AS median, max(value) AS max, max(value) FILTER (WHERE i = round_even((n - 1) * 0.95, 0)) AS p95 FROM o GROUP BY event_type""",
    "value_distribution": """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type)
SELECT event_type, n, round(a, 6) AS q1, round(b, 6) AS q2, round(c, 6) AS q3, round(c - a, 6) AS iqr, round(m, 6) AS mean, round(s, 6) AS sd, round(s / m, 6) AS cv FROM q""",
    "stratum_medians": """WITH o AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
p AS (SELECT *, CASE WHEN i < n // 3 THEN 0 WHEN i < 2 * n // 3 THEN 1 ELSE 2 END AS portion FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY lang, portion ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY lang, portion) AS m FROM p)
SELECT doc_id, lang, n_chars, portion FROM r WHERE j = m // 2""",
    "stratified_sample": """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), b AS (SELECT k, k * n // 10 AS lo, (k + 1) * n // 10 AS hi FROM range(10) t(k), (SELECT count(*) AS n FROM documents)),
p AS (SELECT doc_id, k AS portion FROM o JOIN b ON i >= lo AND i < hi WHERE doc_id % 4 <> 0) SELECT doc_id, portion, place FROM (SELECT *, row_number() OVER (PARTITION BY portion ORDER BY md5(doc_id::VARCHAR), doc_id) AS place FROM p) WHERE place <= 5""",
    "manifest_violations": """SELECT 'repeated id' AS problem, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'group of another size', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_linestatus HAVING count(*) <> 100) HAVING count(*) > 0""",
    "campaign_roll_up": f"""WITH {_RUNS} SELECT analyzer, coalesce(version, 'all') AS version, coalesce(portion, 'all') AS portion, count(*) AS runs, count(*) FILTER (WHERE status = 'ok') AS completed, sum(wall_ns)::BIGINT AS total, max(wall_ns) AS most
FROM runs GROUP BY GROUPING SETS ((analyzer, version), (analyzer), (analyzer, version, portion))""",
    "status_histogram": f"WITH {_RUNS} SELECT analyzer, string_agg(status || '=' || n, ',' ORDER BY status) AS histogram FROM (SELECT analyzer, status, count(*) AS n FROM runs GROUP BY ALL) GROUP BY analyzer",
    "phase_costs": f"""WITH {_RUNS} SELECT analyzer AS phase, count(*) AS count, count(*) FILTER (WHERE status <> 'ok') AS failures, sum(wall_ns)::BIGINT AS wall_ns, sum(wall_ns // 2)::BIGINT AS cpu_ns, max(k + 60) AS rss_peak,
  max(greatest(event_id % 50 - k, 0)) AS rss_growth FROM runs GROUP BY analyzer""",
    "cross_version": f"""WITH {_RUNS} SELECT package, true AS expected_same, count(DISTINCT status) <= 1 AS outcome_same FROM runs GROUP BY package HAVING count(DISTINCT version) = (SELECT count(DISTINCT version) FROM runs)""",
    "version_deltas": f"""WITH {_RUNS}, v AS (SELECT DISTINCT version, package FROM runs WHERE package % 3 = substr(version, 4)::INT % 3), o AS (SELECT version, lag(version) OVER (ORDER BY version) AS prior, lead(version) OVER (ORDER BY version) AS nxt FROM (SELECT DISTINCT version FROM v))
SELECT o.version, (SELECT count(*) FROM v WHERE v.version = o.version AND package NOT IN (SELECT package FROM v p WHERE p.version = o.prior)) AS added,
  (SELECT count(*) FROM v WHERE v.version = o.prior AND package NOT IN (SELECT package FROM v p WHERE p.version = o.version)) AS removed, (SELECT count(*) FROM v WHERE v.version = o.version) AS total FROM o""",
    "package_groups": """SELECT p_brand, sum(n)::BIGINT AS files, count(*) AS identities, count(*) FILTER (WHERE n > 1) AS collisions FROM (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand""",
    "failure_statuses": """SELECT CASE doc_id % 5 WHEN 0 THEN 'memory' WHEN 1 THEN 'timeout' WHEN 2 THEN 'ok' WHEN 3 THEN 'unsupported' ELSE 'failed' END AS status, count(*) AS n FROM documents GROUP BY 1""",
    "latest_releases": """SELECT p_brand AS name, p_size || '.' || m AS latest FROM (SELECT p_brand, p_size, p_partkey % 12 AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 12 DESC) AS r FROM part WHERE p_partkey % 4 <> 0) WHERE r = 1""",
}
