"""Scoring of query results, roll-ups, distributions, samples and consistency checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from progdf.functions.scratch import Grown, forget, saved


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 1 where b is 0."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def score(cases: DataFrame) -> DataFrame:
    """Adds tp, fn, fp, tn, sound and passed to (expected, forbidden, actual) array columns.

    Expected members that were found are true positives, forbidden ones that were found false positives. A missing result (null) found nothing.
    """
    none = F.array().cast("array<string>")
    e, n, a = (F.coalesce(F.col(c), none) for c in ("expected", "forbidden", "actual"))
    out = cases.withColumns({"tp": F.size(F.array_intersect(e, a)), "fn": F.size(F.array_except(e, a)), "fp": F.size(F.array_intersect(n, a)), "tn": F.size(F.array_except(n, a))})
    return out.withColumns({"sound": F.col("fn") == 0, "passed": (F.col("fn") == 0) & (F.col("fp") == 0)})


def finish(df: DataFrame, *keys: str) -> DataFrame:
    """Counts and precision, recall, sound and pass rate by keys; a ratio of nothing is 1."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("tp", "fn", "fp", "tn")]
    flags = [F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in ("sound", "passed")]
    out = df.groupBy(*keys).agg(F.count("*").alias("queries"), *sums, *flags)
    return out.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "sound_rate": ratio(F.col("n_sound"), F.col("queries")), "pass_rate": ratio(F.col("n_passed"), F.col("queries")),
    })


def roll_up(scored: DataFrame, dimensions: list[str]) -> DataFrame:
    """finish() overall and by each single dimension: (dimension, value, ...). Each query counts in every group it belongs to, tags (arrays) included."""

    def entry(d: str, v: Column) -> Column:
        return F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))

    groups = [F.array(entry("overall", F.lit("all")))]
    for d in dimensions:
        many = scored.schema[d].dataType.typeName() == "array"
        groups.append(F.transform(F.col(d), functools.partial(entry, d)) if many else F.array(entry(d, F.col(d))))
    return finish(scored.withColumn("g", F.explode(F.concat(*groups))).select("*", "g.*"), "dimension", "value")


def candidate_universe(cases: DataFrame, component: str, kind: str) -> DataFrame:
    """Expected and forbidden candidates by component and kind, with totals of both (ROLLUP)."""
    counted = cases.withColumns({"positive": F.size("expected"), "negative": F.size("forbidden")})
    return counted.rollup(component, kind).agg(F.sum("positive").cast("long").alias("positive"), F.sum("negative").cast("long").alias("negative"))


def compare_edges(wanted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, required) rows with found and verdict: a required edge must be found, another must not be."""
    hit = actual.select(*keys).distinct().withColumn("found", F.lit(True))
    out = wanted.join(hit, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return out.withColumn("verdict", F.when(F.col("required"), F.when(F.col("found"), "tp").otherwise("fn")).otherwise(F.when(F.col("found"), "fp").otherwise("tn")))


def paths_hold(paths: DataFrame, edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """paths (path_id, path array) with holds: every consecutive pair is an edge (src, dst), or the whole path is declared."""
    steps = paths.where("size(path) > 1").select("path_id", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("s"))
    steps = steps.select("path_id", "s.src", "s.dst")
    broken = steps.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("path_id").distinct().withColumn("broken", F.lit(True))
    out = paths.join(broken, "path_id", "left").withColumn("holds", F.col("broken").isNull()).drop("broken")
    if declared is not None:
        out = out.join(declared.select("path").distinct().withColumn("told", F.lit(True)), "path", "left").withColumn("holds", F.col("holds") | F.coalesce("told", F.lit(False))).drop("told")
    return out


def simple_paths(edges: DataFrame, longest: int = 8, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path): paths of 3 to `longest` different nodes over (keys, src, dst) edges."""
    first = edges.select(*keys, F.array("src", "dst").alias("path")).distinct()
    step = edges.select(*keys, F.col("src").alias("tail"), F.col("dst").alias("next")).distinct()
    now, out = first, None
    for _ in range(longest - 2):
        now = now.withColumn("tail", F.element_at("path", -1)).join(step, [*keys, "tail"]).where(~F.array_contains("path", F.col("next"))).select(*keys, F.concat("path", F.array("next")).alias("path"))
        out = now if out is None else out.unionByName(now)
    return out


def subpaths(paths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Contiguous parts of 3 nodes or more of each path, each once."""
    n = F.size("path")
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), n - i)), lambda k: F.slice("path", i + 1, k))))
    return paths.where(n >= 3).select(*keys, F.explode(parts).alias("path")).where("size(path) >= 3").distinct()


def contradictions(required: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Paths that are both required and forbidden."""
    return required.select("path").intersect(forbidden.select("path"))


def nearest_rank(df: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """The value at place round((n - 1) * q), half to even, of each group in order."""
    w = Window.partitionBy(*keys)
    at = F.bround((F.count("*").over(w) - 1) * F.lit(q), 0)
    return df.where(F.col(value).isNotNull()).withColumns({"_at": at, "_i": F.row_number().over(w.orderBy(value)) - 1}).where("_i = _at").select(*keys, F.col(value).alias("at_rank"))


def metric_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, min, median, p95 and max by keys; p95 is a nearest rank."""
    base = df.groupBy(*keys).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.median(value).alias("median"), F.max(value).alias("max"))
    return base.join(nearest_rank(df, value, 0.95, *keys).withColumnRenamed("at_rank", "p95"), list(keys))


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Inclusive quartiles, their distance, mean, population deviation and coefficient of variation."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), q.alias("q"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "mean", "sd", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("sd") / F.col("mean")).alias("cv"))


def with_portion(df: DataFrame, size: str, ident: str, parts: int, *keys: str) -> DataFrame:
    """portion, from 0: place of a row in order of size, cut at floor(i * n / parts)."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(size, ident)) - 1, F.count("*").over(w)
    return df.withColumns({"_i": i, "_n": n}).withColumn("portion", F.floor(((F.col("_i") + 1) * parts - 1) / F.col("_n")).cast("int")).drop("_i", "_n")


def stratum_medians(df: DataFrame, size: str, ident: str, parts: int, *keys: str) -> DataFrame:
    """The middle row of each of `parts` strata by size."""
    cut = with_portion(df, size, ident, parts, *keys)
    w = Window.partitionBy(*keys, "portion")
    return cut.withColumns({"_i": F.row_number().over(w.orderBy(size, ident)) - 1, "_n": F.count("*").over(w)}).where("_i = floor(_n / 2)").drop("_i", "_n")


def stratified_sample(df: DataFrame, size: str, ident: str, parts: int, each: int, excluded: DataFrame | None = None) -> DataFrame:
    """`each` rows of every portion by size, in order of a hash of the id; excluded ids are passed over, the next ones stand in."""
    cut = with_portion(df, size, ident, parts)
    if excluded is not None:
        cut = cut.join(excluded.select(ident).distinct(), ident, "left_anti")
    order = F.md5(F.col(ident).cast("string"))
    return cut.withColumn("place", F.row_number().over(Window.partitionBy("portion").orderBy(order, ident))).where(F.col("place") <= each)


def manifest_violations(df: DataFrame, ident: str, group: str, each: int) -> DataFrame:
    """(problem, subject): ids that repeat and groups without exactly `each` rows."""
    again = df.groupBy(ident).count().where("count > 1").select(F.lit("repeated id").alias("problem"), F.col(ident).cast("string").alias("subject"))
    odd = df.groupBy(group).count().where(F.col("count") != each).select(F.lit("group of another size").alias("problem"), F.col(group).cast("string").alias("subject"))
    return again.unionByName(odd)


def campaign(runs: DataFrame, value: str, sets: list[list[str]], status: str = "status") -> DataFrame:
    """Runs, completed runs and the value's sum and greatest, by each set of keys (GROUPING SETS); absent keys are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = runs.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return out.agg(F.count("*").alias("runs"), F.count(F.when(F.col(status) == "ok", 1)).alias("completed"), F.sum(value).alias("total"), F.max(value).alias("most"))


def histogram(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows by value of a column, as a map in each group."""
    per = df.groupBy(*keys, column).count()
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias("histogram"))


def phase_costs(records: DataFrame) -> DataFrame:
    """Count, failures, summed wall and CPU time, greatest peak and greatest growth by phase of profile records."""
    return records.groupBy("phase").agg(
        F.count("*").alias("count"), F.count(F.when(F.col("status") != "ok", 1)).alias("failures"), F.sum("wall_ns").alias("wall_ns"), F.sum("cpu_ns").alias("cpu_ns"),
        F.max("rss_peak").alias("rss_peak"), F.max(F.greatest(F.col("rss_end") - F.col("rss_start"), F.lit(0))).alias("rss_growth"),
    )


def cross_version(df: DataFrame, ident: str, version: str, outcome: str, expected: str) -> DataFrame:
    """ids present in every version, with whether expectation and outcome are the same in all of them."""
    total = df.select(version).distinct().agg(F.count("*").alias("versions"))
    per = df.groupBy(ident).agg(F.countDistinct(version).alias("k"), F.countDistinct(expected).alias("e"), F.countDistinct(outcome).alias("o"))
    return per.join(F.broadcast(total), per.k == total.versions).select(ident, (F.col("e") <= 1).alias("expected_same"), (F.col("o") <= 1).alias("outcome_same"))


def set_deltas(df: DataFrame, version: str, item: str) -> DataFrame:
    """Items that each version adds to and takes from the version before."""
    per = df.groupBy(version).agg(F.array_sort(F.collect_set(item)).alias("items"))
    before = F.coalesce(F.lag("items").over(Window.orderBy(version)), F.array().cast(per.schema["items"].dataType))
    return per.withColumn("before", before).select(version, F.size(F.array_except("items", "before")).alias("added"), F.size(F.array_except("before", "items")).alias("removed"), F.size("items").alias("total"))


def package_groups(files: DataFrame, group: str, identity: str) -> DataFrame:
    """Files, distinct identities, identities that several files share, by group."""
    per = files.groupBy(group, identity).count()
    return per.groupBy(group).agg(F.sum("count").alias("files"), F.count("*").alias("identities"), F.count(F.when(F.col("count") > 1, 1)).alias("collisions"))


def failure_status(stderr: Column) -> Column:
    """Status of a failed run by what it wrote."""
    low = F.lower(stderr)
    return F.when(low.contains("memory") | low.contains("bad_alloc"), "memory").when(low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("unsupported"), "unsupported").when(stderr.isNull() | (stderr == ""), "ok").otherwise("failed")


def latest_stable(releases: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """The greatest version of dotted numbers of each name; others, such as pre-releases, are no candidates."""
    stable = releases.where(F.col(version).rlike(r"^\d+(\.\d+)*$"))
    key = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    return stable.groupBy(name).agg(F.max_by(version, key).alias("latest"))


def process_trees(processes: DataFrame) -> DataFrame:
    """(pid, processes, rss): each process with all below it: their number and memory, of (pid, ppid, rss) rows.

    Every round doubles how far up a process is counted, so rounds grow with the logarithm of the depth; a cycle of parents is an error.
    """
    jump = saved(processes.select("pid", F.col("ppid").alias("up")).join(processes.select(F.col("pid").alias("up")), "up", "left_semi").select("pid", "up"), "parents")
    pairs = Grown(processes.select(F.col("pid").alias("root"), "pid"), "trees")
    for _ in range(64):
        if jump.isEmpty():
            return pairs.read().join(processes.select("pid", "rss"), "pid").groupBy(F.col("root").alias("pid")).agg(F.count("*").alias("processes"), F.sum("rss").alias("rss"))
        # pairs: all ancestors nearer than jump's
        far = saved(pairs.read().join(jump.select(F.col("pid").alias("root"), "up"), "root").select(F.col("up").alias("root"), "pid"), "trees")
        pairs.add(far)
        last, jump = jump, saved(jump.join(jump.select(F.col("pid").alias("up"), F.col("up").alias("next")), "up").select("pid", F.col("next").alias("up")), "parents")
        forget(last)
    raise ValueError("a process is its own ancestor")


def catalog_statistics(cases: DataFrame) -> DataFrame:
    """(category, cases, expected, negative) of a catalog (case, category, expected, negative), and of all together."""
    out = cases.rollup("category").agg(F.grouping("category").alias("all"), F.countDistinct("case").alias("cases"), F.sum("expected").alias("expected"), F.sum("negative").alias("negative"))
    return out.select(F.when(F.col("all") == 1, "all").otherwise(F.col("category")).alias("category"), "cases", "expected", "negative")


def catalog_violations(cases: DataFrame) -> DataFrame:
    """(problem, case): cases that repeat, have no category, or have neither an expected nor a negative candidate."""
    many = cases.groupBy("case").count().where("count > 1").select(F.lit("repeated case").alias("problem"), "case")
    bare = cases.where("category IS NULL").select(F.lit("no category").alias("problem"), "case")
    return many.unionByName(bare).unionByName(cases.where("expected + negative = 0").select(F.lit("no candidate").alias("problem"), "case")).distinct()


def completion(runs: DataFrame, component: str, status: str) -> DataFrame:
    """Runs, completed runs and their share, by component."""
    out = runs.groupBy(component).agg(F.count("*").alias("runs"), F.count(F.when(F.col(status) == "ok", 1)).alias("completed"))
    return out.withColumn("share", F.when(F.col("runs") == 0, 1.0).otherwise(F.col("completed") / F.col("runs")))


def ablation(runs: DataFrame, variant: str, ident: str, value: str, base: str) -> DataFrame:
    """Each variant's sum of a value over the cases that the base variant has too, and the base's over the same cases."""
    b = runs.where(F.col(variant) == base).groupBy(ident).agg(F.sum(value).alias("_base"))
    per = runs.groupBy(variant, ident).agg(F.sum(value).alias("_own")).join(b, ident)
    return per.groupBy(variant).agg(F.count("*").alias("cases"), F.sum("_own").alias("total"), F.sum("_base").alias("base_total"))
