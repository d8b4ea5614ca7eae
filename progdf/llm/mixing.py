"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source has one constraint: the tokens drawn from it equal its target. Among all document rates from 0 to `most` that meet
the constraints, those of least relative entropy to the corpus (each document once) are exponential tilts: a document of s
tokens has the rate min(most, exp(lambda * s)) with its source's lambda. The dual is convex; each Newton step gathers gradient
and curvature as sums over the documents, here over how many documents of a source have a size, and stays within a bracket
that narrows with every step.

Rates are then rounded into whole copies: the integer part for every document, and one more for some by sequential Poisson
sampling, which takes documents in the order of a hash over the fraction until the source's goal is met. Long documents are
placed first and short ones fill the rest, so a source ends within about half of one of its short documents of its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, forget, fresh, saved, table

#: Weights of the sources in order, repeating; the mix's size; the most that a document is repeated.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Newton steps are planned so many at a time, for all sources at once; a source is done when its tokens are as near to its target.
AT_ONCE, STEPS, NEAR = 4, 64, 1e-10
#: So many sources are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: What a level of documents is to add (rest: by it and those after it; f: expected; s: at most), and the share of its last
#: document that has to lie within that: what is added too much or too little is made up for by the levels after it.
GOALS = ("rest * f0 / (f0 + f1 + f2)", "rest * f1 / (f1 + f2)", "rest")
OVER = ("CASE WHEN s1 + s2 > 0 THEN (f1 + f2) / (s1 + s2) ELSE 0.5 END", "CASE WHEN s2 > 0 THEN f2 / s2 ELSE 0.5 END", "0.5")


def words_in(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): a row for each source of (source, size) rows.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` times all sizes. No target exceeds `most`
    times its source's size; the excess goes to the others by weight. Only the table of sources is ever sorted.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights)).cast("int") + 1).cast("double")
    per = per.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    left = F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~full, F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("nth"), F.col("level")))).over(Window.partitionBy())["level"]
    return per.withColumn("target", F.when(full, F.col("cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "target")


def histogram(docs: DataFrame) -> DataFrame:
    """(key, size, n): how many documents of each source have each size; all that the dual needs."""
    return docs.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n"))


def newton_step(state: DataFrame, counts: DataFrame, most: float) -> DataFrame:
    """state (key, target, x, lo, hi, done) after one step of all sources that are not done.

    x is lambda, between lo and hi. Where Newton's step leaves the bracket, or all documents are at `most`, its middle is next.
    """
    rate = F.least(F.exp(F.col("x") * F.col("size")), F.lit(float(most)))
    tokens = (F.col("n") * F.col("size")).cast("double") * rate
    # the state is named once, so that the plan of several steps grows with their number
    sums = state.join(counts, "key").groupBy("key", "target", "x", "lo", "hi", "done")
    sums = sums.agg(F.sum(F.when(~F.col("done"), tokens)).alias("got"), F.sum(F.when(F.col("done"), None).when(rate < most, tokens * F.col("size")).otherwise(0.0)).alias("slope"))
    g = F.col("got") - F.col("target")
    open_ = ~F.col("done")
    sums = sums.withColumns({"near": F.abs(g) <= NEAR * F.col("target"), "lo": F.when(open_ & (g <= 0), F.col("x")).otherwise(F.col("lo")), "hi": F.when(open_ & (g > 0), F.col("x")).otherwise(F.col("hi")), "to": F.when(F.col("slope") > 0, F.col("x") - g / F.col("slope"))})
    x = F.when(F.col("done") | F.col("near"), F.col("x")).when((F.col("to") > F.col("lo")) & (F.col("to") < F.col("hi")), F.col("to")).otherwise((F.col("lo") + F.col("hi")) / 2)
    return sums.select("key", "target", x.alias("x"), "lo", "hi", (F.col("done") | F.col("near")).alias("done"))


def tilts(docs: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """(key, x): lambda of each source whose target lies between 0 and all that it can give.

    docs: (key, size); sources: (key, source_size, target). One row tells the driver whether steps are left to do.
    """
    counts = saved(histogram(docs), "histogram")
    ratio = F.col("target") / F.col("source_size")
    state = sources.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size")))
    state = state.select("key", "target", F.lit(0.0).alias("x"), F.least(F.lit(0.0), F.log(ratio)).alias("lo"), F.lit(max(0.0, math.log(most))).alias("hi"), F.lit(False).alias("done"))
    state = saved(state, "tilts")
    for _ in range(0, STEPS, AT_ONCE):
        if state.where("NOT done").isEmpty():
            break
        last = state
        for _ in range(AT_ONCE):
            state = newton_step(state, counts, most)
        state = saved(state, "tilts")
        forget(last)
    forget(counts)
    return state.select("key", "x")


def _prefixes(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, last): in each source, the last document in the order of (place, id) of the prefix that stays within its goal.

    goals: (key, goal, over). The document that the goal falls into belongs to the prefix if the share `over` of it does. Sums by source and bin come first; only the documents of the one bin that the goal falls into are sorted. A source of
    n documents has about the root of n bins.
    """
    bins = docs.groupBy("key", "bin").agg(F.sum("size").alias("size"), F.max(F.struct("place", "id")).alias("end"))
    w = Window.partitionBy("key").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("size").over(w)).join(goals, "key")
    whole = bins.where(F.col("upto") <= F.col("goal")).groupBy("key").agg(F.max("end").alias("end"))
    cut = bins.where("upto > goal").groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("base"), "goal", "over")).alias("cut"))
    inside = docs.join(cut.select("key", F.col("cut.bin").alias("bin"), "cut.base", "cut.goal", "cut.over"), ["key", "bin"])
    inside = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("key").orderBy("place", "id").rangeBetween(Window.unboundedPreceding, 0)) + F.col("base"))
    part = inside.where(F.col("upto") - F.col("size") * F.col("over") <= F.col("goal")).groupBy("key").agg(F.max(F.struct("place", "id")).alias("end"))
    return whole.unionByName(part).groupBy("key").agg(F.max("end").alias("last"))


def _rates(size: Column, most: float) -> dict[str, Column]:
    """Rate and its whole copies of a document of `size` tokens, from its source's x, target and source_size."""
    rate = F.when(size == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("source_size"), float(most))
    return {"rate": rate.otherwise(F.least(F.exp(F.col("x") * size), F.lit(float(most))))}


def mix_sources(df: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Every row of df with size, source_size, target, rate and copies.

    df: doc_id, text, source and any other columns, which pass through whatever their names; columns of the names added here
    are replaced. size counts words, 0 for a null or empty text, which has the rate 1 and one copy. A null source is a source
    of its own. A null doc_id hashes as -1. Rows that repeat a doc_id are rounded by their sizes alike. An empty table gives none.
    """
    kept = [c for c in df.columns if c.lower() not in ("size", "source_size", "target", "rate", "copies")]
    own = fresh(df, "mix")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    u = F.conv(F.substring(F.md5(ident.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") + 0.5
    # the columns of df get names of their own, so that none meets a working column
    aside = [F.col(f"`{c}`").alias(f"{own}{i}") for i, c in enumerate(kept)]
    full = df.select(*aside, words_in(F.col("text").cast("string")).alias("size"), key.alias("key"), F.col("source").cast("string").alias("source"), u.alias("u"), ident.alias("id"))
    docs = saved(full.select("key", "source", "size", "u", "id"), "sizes")
    keyed = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    per = docs.groupBy("key").agg(F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*")))).cast("long").alias("bins"))
    sources = saved(source_targets(docs, weights, share, most).withColumn("key", keyed).drop("source").join(per, "key"), "sources")
    plan = saved(sources.join(tilts(docs, sources, most), "key", "left"), "rates")
    few = plan.count() <= BROADCAST_SOURCES
    known = F.broadcast(plan) if few else plan
    level = F.when(F.col("size") > F.col("mean"), 0).when(F.col("size") * 8 > F.col("mean"), 1).otherwise(2)
    copies = {"whole": F.floor("rate").cast("long"), "part": F.col("rate") - F.floor("rate"), "level": level}
    place = F.col("u") / 2**32 / F.col("part")
    rated = docs.where("size > 0").join(known, "key").withColumns(_rates(F.col("size"), most)).withColumns(copies)
    spread = F.col("bins") * (F.col("place") / (1 + F.col("place")))
    rated = rated.withColumn("place", F.when(F.col("part") > 0, place)).withColumn("bin", F.floor(spread).cast("long"))
    rated = saved(rated.select("key", "size", "id", "whole", "part", "level", "place", "bin"), "rated")
    sums = rated.groupBy("key").agg(
        F.sum(F.col("whole") * F.col("size")).alias("sure"),
        *(F.sum(F.when(F.col("level") == k, F.col("part") * F.col("size")).otherwise(0.0)).alias(f"f{k}") for k in range(3)),
        *(F.sum(F.when((F.col("level") == k) & (F.col("part") > 0), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(3)),
    )
    state = saved(sources.join(sums, "key").where("f0 + f1 + f2 > 0").selectExpr("key", "CAST(target - sure AS DOUBLE) rest", "f0", "f1", "f2", "s0", "s1", "s2"), "rests")
    rated_parts = rated.where("part > 0")
    ends, old = [], []
    for k in range(3):
        goals = state.selectExpr("key", f"CASE WHEN s{k} > 0 THEN least(greatest({GOALS[k]}, 0), s{k}) ELSE 0 END AS goal", f"CAST({OVER[k]} AS DOUBLE) AS over")
        here = rated_parts.where(F.col("level") == k)
        last = saved(_prefixes(here, goals), "prefixes")
        ends.append(last.select("key", F.lit(k).alias("level"), "last"))
        got = here.join(last, "key").where(F.struct("place", "id") <= F.col("last")).groupBy("key").agg(F.sum("size").alias("got"))
        old.append(state)
        state = saved(state.join(got, "key", "left").withColumn("rest", F.col("rest") - F.coalesce("got", F.lit(0))).drop("got"), "rests")
    lasts = ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy("key").pivot("level", [0, 1, 2]).agg(F.first("last")).toDF("key", "end0", "end1", "end2")
    last = plan
    plan = saved(plan.join(lasts, "key", "left"), "plan")
    forget(docs, rated, sources, last, state, *old)
    out = full.drop("source").join(F.broadcast(plan) if few else plan, "key").withColumns(_rates(F.col("size"), most)).withColumns(copies)
    end = F.when(F.col("level") == 0, F.col("end0")).when(F.col("level") == 1, F.col("end1")).otherwise(F.col("end2"))
    extra = F.when((F.col("size") > 0) & (F.col("part") > 0) & end.isNotNull() & (F.struct(place.alias("place"), F.col("id")) <= end), 1).otherwise(0)
    back = [F.col(f"{own}{i}").alias(c) for i, c in enumerate(kept)]
    return out.select(*back, "size", "source_size", "target", "rate", (F.col("whole") + extra).cast("long").alias("copies"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken and copies."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _level_sql(k: int, before: str) -> str:
    rest = "(rest" + "".join(f" - got{j}" for j in range(k)) + ")"
    return f"""
goal{k} AS (SELECT key, CASE WHEN s{k} > 0 THEN LEAST(GREATEST({GOALS[k].replace("rest", rest)}, 0), s{k}) ELSE 0 END AS goal, ({OVER[k]})::DOUBLE AS over FROM {before}),
pick{k} AS (SELECT l.key, l.id, l.size FROM (SELECT *, SUM(size) OVER (PARTITION BY key ORDER BY place, id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rated WHERE part > 0 AND level = {k}) l JOIN goal{k} g USING (key) WHERE upto - size * over <= goal),
state{k + 1} AS (SELECT s.*, COALESCE(got, 0) AS got{k} FROM {before} s LEFT JOIN (SELECT key, SUM(size) AS got FROM pick{k} GROUP BY key) USING (key)),"""


OP9_SQL = (
    r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, COALESCE('=' || source, '-') AS key, COALESCE(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(COALESCE(doc_id, -1)::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE AS u, COALESCE(doc_id, -1) AS id FROM documents
), per AS (
  SELECT source, key, SUM(size)::BIGINT AS source_size, SUM(size) * 2.0::DOUBLE AS cap, [3.0, 1.0, 2.0][(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
    ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS nth, AVG(size) FILTER (WHERE size > 0) AS mean FROM sized GROUP BY source, key
), filled AS (
  SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per
), targets AS (
  SELECT *, CASE WHEN cap <= level * weight THEN cap ELSE (SELECT min_by(level, cap / weight) FROM filled WHERE NOT cap <= level * weight) * weight END AS target FROM filled
), counts AS (SELECT key, size, COUNT(*) AS n FROM sized WHERE size > 0 GROUP BY key, size),
newton AS (
  SELECT key, target, 0 AS step, 0.0::DOUBLE AS x, LEAST(0, ln(target / source_size))::DOUBLE AS lo, ln(2)::DOUBLE AS hi, false AS done FROM targets WHERE target > 0 AND target < 2 * source_size
  UNION ALL
  SELECT key, target, step + 1, CASE WHEN abs(g) <= 1e-10 * target THEN x WHEN slope > 0 AND x - g / slope > l AND x - g / slope < h THEN x - g / slope ELSE (l + h) / 2 END, l, h, abs(g) <= 1e-10 * target
  FROM (SELECT *, CASE WHEN g > 0 THEN lo ELSE x END AS l, CASE WHEN g > 0 THEN x ELSE hi END AS h FROM (
    SELECT w.key, w.target, w.step, w.x, w.lo, w.hi, SUM(n * size * LEAST(exp(LEAST(w.x * size, 700)), 2)) - w.target AS g, SUM(CASE WHEN w.x * size < ln(2) THEN n * size * exp(w.x * size) * size ELSE 0 END) AS slope
    FROM newton w JOIN counts c ON c.key = w.key WHERE NOT w.done AND w.step < 64 GROUP BY w.key, w.target, w.step, w.x, w.lo, w.hi))
), tilts AS (SELECT key, arg_max(x, step) AS x FROM newton GROUP BY key),
sources AS (SELECT t.*, x FROM targets t LEFT JOIN tilts USING (key)),
rates AS (
  SELECT z.*, s.source_size, s.target, CASE WHEN z.size > s.mean THEN 0 WHEN z.size * 8 > s.mean THEN 1 ELSE 2 END AS level,
    CASE WHEN z.size = 0 THEN 1 WHEN s.target <= 0 THEN 0 WHEN s.target >= 2 * s.source_size THEN 2 ELSE LEAST(exp(LEAST(s.x * z.size, 700)), 2) END::DOUBLE AS rate
  FROM sized z JOIN sources s USING (key)
), rated AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part, CASE WHEN rate > floor(rate) THEN u / 4294967296.0::DOUBLE / (rate - floor(rate)) END AS place FROM rates WHERE size > 0
), state0 AS (
  SELECT key, MIN(target) - SUM(whole * size) AS rest, """
    + ", ".join(f"SUM(CASE WHEN level = {k} THEN part * size ELSE 0 END) AS f{k}, SUM(CASE WHEN level = {k} AND part > 0 THEN size ELSE 0 END) AS s{k}" for k in range(3))
    + """ FROM rated GROUP BY key HAVING SUM(part * size) > 0
),"""
    + _level_sql(0, "state0")
    + _level_sql(1, "state1")
    + _level_sql(2, "state2")
    + """
picked AS (SELECT DISTINCT key, id, size FROM (SELECT * FROM pick0 UNION ALL SELECT * FROM pick1 UNION ALL SELECT * FROM pick2))
SELECT r.doc_id, r.size, r.source_size, r.target, (floor(r.rate)::BIGINT + (p.id IS NOT NULL)::BIGINT) * r.size AS taken, floor(r.rate)::BIGINT + (p.id IS NOT NULL)::BIGINT AS copies
FROM rates r LEFT JOIN picked p ON p.key = r.key AND p.id = r.id AND p.size = r.size
"""
)
