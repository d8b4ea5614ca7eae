"""Near-duplicate documents by SetSketch registers.

A sketch holds `registers` exponentially spaced, truncated minima: register i is floor(1 - log_base(x_i)) with x_i the least of
one exponential variable per shingle, so sketches merge by maximum and two registers agree with about the Jaccard similarity.
Bands of registers give candidate pairs, a joint likelihood of the registers and the set sizes drops the hopeless ones, and
every link is confirmed on the full shingle sets.

Equal sets form one class first. Within a band's bucket, members are compared with one leader a round, and later only members of
different components are compared, so a bucket of n near copies costs about n comparisons and not n * n. What is still
apart after two rounds is gathered into families by likelihood, taken five deviations below the threshold, and compared there
in blocks on full sets: documents outside a family's largest component with all of its members. A block gives out no more
links than it has components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, forget, fresh, mix, saved, shingles, slices, stored_bytes, table, tidy, Words
from .graph import components, merged

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: A class of at most so many ids is broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000
#: The table of documents that go is broadcast up to this many bytes as it is stored.
BROADCAST_BYTES = 16 << 20
#: Rows of a bucket, and shingles of a family, that one task compares at a time.
BLOCK, ELEMENTS = 512, 200_000
#: Pairs of sketches whose likelihood is estimated at once.
CANDIDATES = 20_000


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (r[:m] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[m:] >> np.uint64(32)).astype(np.uint32)


def minima(h: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Least of m 32-bit hash functions over each row's shingles; 2**32 - 1 for an empty row."""
    mul, add = (x[:, None] for x in _seeds(m))
    low = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    out = np.full((len(bounds) - 1, m), 0xFFFFFFFF, np.uint32)
    for i in range(len(bounds) - 1):
        for a in range(bounds[i], bounds[i + 1], 2048):
            v = low[None, a : min(a + 2048, bounds[i + 1])] * mul
            v += add
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(13)
            np.minimum(out[i], v.min(axis=1), out=out[i])
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch register values of uniform minima."""
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def likely(same: np.ndarray, more: np.ndarray, less: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the counts of equal, greater and lesser registers and the set sizes."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    top = np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros_like(top), top.copy()
    g = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = score(a) > score(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2


def sketch(df: DataFrame, words: int, m: int) -> DataFrame:
    """(doc_id, version, n, d1, d2, regs): a hash of the text, set size, a 128-bit digest of the set and its registers, of (doc_id, text) rows."""

    def run(batches):
        for batch in batches:
            ids, versions, texts = batch.columns
            for a, b in slices(texts):
                h, bounds = shingles(Words(texts.slice(a, b - a)), words)
                regs = registers(minima(h, bounds, m))
                sums = [np.append(np.uint64(0), np.cumsum(mix(h + np.uint64(s)))) for s in (11, 23)]
                d = [(c[bounds[1:]] - c[bounds[:-1]]).view(np.int64) for c in sums]
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, (b - a + 1) * m * 2, m * 2, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(regs))])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), versions.slice(a, b - a), pa.array(np.diff(bounds)), pa.array(d[0]), pa.array(d[1]), raw], ["doc_id", "version", "n", "d1", "d2", "regs"])

    text = F.col("text").cast("string")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).mapInArrow(tidy(run), "doc_id long, version long, n long, d1 long, d2 long, regs binary")


def _matrix(column, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, m)


def bands(classes: DataFrame, m: int, rows: int, count: int) -> DataFrame:
    """(key, rep): one row for each band of a class; equal registers in a band give equal keys."""

    def run(batches):
        for batch in batches:
            regs = _matrix(batch.column(1), m)
            key = np.zeros((len(regs), count), np.uint64) + np.arange(1, count + 1, dtype=np.uint64)
            for j in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, j : rows * count : rows].astype(np.uint64))
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep)], ["key", "rep"])

    return classes.select("rep", "regs").mapInArrow(tidy(run), "key long, rep long")


def _estimated(pairs: DataFrame, classes: DataFrame, m: int, least: float) -> DataFrame:
    """(a, b, est) of the pairs whose likelihood estimate is at least `least`."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _matrix(batch.column(4), m), _matrix(batch.column(5), m)
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            est = likely((a == b).sum(1), (a > b).sum(1), (a < b).sum(1), na, nb)
            keep = np.flatnonzero(est >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(est[keep])], ["a", "b", "est"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(tidy(run), "a long, b long, est double")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full shingle sets."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t_{x}"))

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(2), batch.column(3)):
                part = batch.slice(lo, hi - lo)
                sets = [shingles(Words(part.column(i)), words) for i in (2, 3)]
                rows = [np.repeat(np.arange(part.num_rows), np.diff(b)) for _, b in sets]
                h, row = np.concatenate([x for x, _ in sets]), np.concatenate(rows)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=part.num_rows)
                union = np.diff(sets[0][1]) + np.diff(sets[1][1]) - both
                keep = pa.array(np.flatnonzero((both > 0) & (100 * both >= percent * union)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(tidy(run), "a long, b long")


def _linked(root: np.ndarray, i: int, j: int) -> bool:
    """Give the component of row j the number of row i's; false if they have one number already."""
    if root[i] == root[j]:
        return False
    root[root == root[j]] = root[i]
    return True


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin in sorted rows."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = t[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _whole(batches, keys: list[str]):
    """Tables of whole groups of the sorted rows in Arrow batches; what is held beyond a batch is one group."""
    kept = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if kept and all(kept[0][k][0] == t[k][t.num_rows - 1] for k in keys):
            kept.append(t)
            continue
        t = pa.concat_tables([*kept, t])
        last = int(_starts(t, keys)[-1])
        if last:
            yield t.slice(0, last).combine_chunks()
        kept = [t.slice(last)]
    if kept:
        yield pa.concat_tables(kept).combine_chunks()


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _alike(entries: DataFrame, classes: DataFrame, m: int, percent: int, least: float) -> DataFrame:
    """(a, b): links by likelihood between components that share a bucket, no more of them than components.

    entries: (key, rep, comp) of buckets with several components. Those outside a bucket's largest component are dealt to every
    block of its members, and a block compares their registers with all others.
    """
    per = entries.groupBy("key", "comp").agg(F.count("*").alias("k"))
    # a table of its own lets the join split a bucket of very many members
    size = saved(per.groupBy("key").agg(F.ceil(F.sum("k") / BLOCK).cast("int").alias("blocks"), F.max(F.struct("k", "comp")).alias("top")), "sizes")
    rows = entries.join(size, "key").join(classes.select("rep", "n", "regs"), "rep")
    data = ("rep", "comp", "n", "regs")
    stored = rows.select("key", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), *data, F.lit(False).alias("asks"))
    asking = rows.where(F.col("comp") != F.col("top.comp")).select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *data, F.lit(True).alias("asks"))

    def links(t: pa.Table) -> list[tuple[int, int]]:
        rep, n, asks = (t[c].to_numpy() for c in ("rep", "n", "asks"))
        regs, starts = _matrix(t["regs"], m), _starts(t, ["key", "block"])
        # number of each row's component in its bucket; those already linked here share one, and are not compared again
        names, root = np.unique(t["comp"].to_numpy(), return_inverse=True)
        root = root + len(names) * np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rep))))
        found, waiting, held = [], [], 0

        def decide():
            i, j, same, more, less = (np.concatenate(x) for x in zip(*waiting, strict=True))
            good = np.flatnonzero(likely(same, more, less, n[j].astype(float), n[i].astype(float)) >= least)
            found.extend((rep[x], rep[y]) for x, y in zip(i[good], j[good], strict=True) if _linked(root, x, y))
            waiting.clear()

        for lo, hi in zip(starts, np.append(starts[1:], len(rep)), strict=True):
            own = lo + np.flatnonzero(~asks[lo:hi])
            for i in lo + np.flatnonzero(asks[lo:hi]):
                ok = own[(root[own] != root[i]) & (100 * np.minimum(n[own], n[i]) >= percent * np.maximum(n[own], n[i]))]
                same = (regs[ok] == regs[i]).sum(1)
                near = same >= (least - 0.02) * m
                ok, same = ok[near], same[near]
                if len(ok):
                    more = (regs[ok] > regs[i]).sum(1)
                    waiting.append((np.full(len(ok), i), ok, same, more, m - same - more))
                    held += len(ok)
                if held >= CANDIDATES:
                    decide()
                    held = 0
        if waiting:
            decide()
        return found

    def run(batches):
        for t in _whole(batches, ["key", "block"]):
            yield from _pairs(links(t)).to_batches()

    # dealt anew: else all blocks of a bucket would stay together; many small buckets go through Python at once
    dealt = stored.unionByName(asking).repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _within(members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): exact links between components of a family, no more of them than components in a pair of blocks.

    members: (family, rep, comp, n, text). Documents outside a family's largest component are compared on full shingle
    sets with all members of the family, by blocks of bounded size of the one and of the other.
    """
    per = members.groupBy("family", "comp").agg(F.sum("n").alias("k"))
    size = per.groupBy("family").agg(F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("top"))
    size = size.withColumns({"blocks": F.ceil(F.col("all") / ELEMENTS).cast("int"), "turns": F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.k")) / ELEMENTS).cast("int"))})
    rows = members.join(saved(size, "sizes"), "family")
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = ("rep", "comp", "text")
    stored = rows.select("family", dealt("blocks").alias("block"), every("turns").alias("turn"), *data, F.lit(False).alias("asks"))
    asking = rows.where(F.col("comp") != F.col("top.comp")).select("family", every("blocks").alias("block"), dealt("turns").alias("turn"), *data, F.lit(True).alias("asks"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rep, asks = t["rep"].to_numpy(), t["asks"].to_numpy()
        found = []
        if asks.any() and not asks.all():
            text = t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"]
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            parts = [shingles(Words(text.slice(a, b - a)), words) for a, b in slices(text)]
            n = np.concatenate([np.diff(b) for _, b in parts])
            at = np.append(0, np.cumsum(n))
            _, ids = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            _, root = np.unique(t["comp"].to_numpy(), return_inverse=True)
            own = np.flatnonzero(~asks & (n > 0))
            held = np.concatenate([ids[at[j] : at[j + 1]] for j in own]) if len(own) else np.zeros(0, np.int64)
            bounds = np.append(0, np.cumsum(n[own]))[:-1]
            flag = np.zeros(len(ids) + 1, np.int32)
            for i in np.flatnonzero(asks & (n > 0)) if len(own) else ():
                if (root[own] == root[i]).all():
                    continue
                mine = ids[at[i] : at[i + 1]]
                flag[mine] = 1
                both = np.add.reduceat(flag[held], bounds)
                flag[mine] = 0
                good = (root[own] != root[i]) & (100 * both >= percent * (n[i] + n[own] - both))
                found += [(rep[i], rep[j]) for j in own[good] if _linked(root, i, j)]
        return _pairs(found)

    # dealt anew: else all blocks of a family would stay together
    return stored.unionByName(asking).repartition("family", "block", "turn").groupBy("family", "block", "turn").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, m: int = 200, rows: int = 5, versions: bool = False) -> DataFrame:
    """Components of near-duplicate documents.

    df: doc_id, text, any other columns (ignored). words: shingle length. percent: least similarity, in hundredths.
    m, rows: registers and registers in a band; at a similarity of exactly 0.8, m=200 and rows=5 overlook a pair of two
    lone documents with probability (1 - 0.8**5)**40 = 1.2e-7.
    Gives doc_id, n_shingles, component_id, kept for every row. Null and empty texts have no shingles and stay alone.
    Rows that repeat a doc_id are documents of their own texts, but what is linked with one is linked with the other. A row
    without doc_id has component_id null and is kept. versions: adds version, a hash of the row's text. An empty table gives none.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    base = saved(sketch(df, words, m), "sketch")
    classes = saved(
        base.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("regs").alias("regs")),
        "classes",
    )
    count = m // rows
    keys = bands(classes, m, rows, count)
    shared = saved(keys.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("leader")).where("members > 1"), "shared")
    multi = saved(keys.join(shared, "key").select("key", "rep", "leader"), "buckets")
    least = percent / 100 - 5 * np.sqrt(0.16 / m)
    reps = saved(multi.select("rep").distinct(), "reps")
    few = reps.count() <= BROADCAST_IDS
    ids = (F.broadcast(reps) if few else reps).withColumnRenamed("rep", "doc_id")
    texts = saved(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi").distinct(), "texts")

    def best(pairs: DataFrame) -> DataFrame:
        """Of the estimated pairs, each document's likeliest."""
        w = F.max(F.struct(F.col("est"), (-F.col("b")).alias("nb"), F.col("b"))).alias("top")
        return pairs.groupBy("a").agg(w).select("a", "top.b")

    star = multi.where("rep != leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    found = saved(confirmed(best(_estimated(star, classes, m, least)), texts, words, percent), "found")
    links = [found]
    comp = saved(components(found), "components")

    def apart() -> DataFrame:
        """(key, rep, comp, lead) of buckets that hold several components; lead is another leader, by chance, in each."""
        entries = multi.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
        lead = F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep", "comp")).alias("lead")
        mixed = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), lead).where("lo < hi")
        return saved(entries.join(saved(mixed.select("key", "lead"), "mixed"), "key"), "apart")

    entries = apart()
    pairs = entries.where("comp != lead.comp").select(F.col("rep").alias("a"), F.col("lead.rep").alias("b")).distinct()
    links.append(saved(confirmed(best(_estimated(pairs, classes, m, least)), texts, words, percent), "found"))
    forget(entries)
    before, comp = comp, saved(merged(comp, links[1]), "components")
    forget(before)
    # what is left: families by likelihood, and all links within them by full sets
    entries = apart()
    alike = saved(_alike(entries.drop("lead"), classes, m, percent, least), "alike")
    family = saved(merged(comp, alike).withColumnRenamed("component", "family"), "families")
    open_ones = alike.select(F.col("a").alias("node")).join(family, "node").select("family").distinct()
    members = family.join(open_ones, "family", "left_semi").join(comp, "node", "left").select("family", F.col("node").alias("rep"), F.coalesce("component", "node").alias("comp"))
    members = members.join(classes.select("rep", "n"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    links.append(saved(_within(members, words, percent), "found"))
    forget(entries, alike, family)
    before, comp = comp, saved(merged(comp, links[2]), "components")
    forget(before, shared, multi, reps, texts, *links)
    node = base.join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    own = node.select("doc_id", *["version"] * versions, F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """df with one document of each group of near duplicates, that of least doc_id; rows without doc_id or without words stay.

    Of rows that repeat both doc_id and text one stays; rows of one doc_id with different texts are decided on each by itself.
    """
    found = saved(near_duplicates(df, words, percent, versions=True), "groups").where("doc_id IS NOT NULL")
    key = ["doc_id", "version"]
    gone = found.groupBy(*key).agg(F.max(~F.col("kept")).alias("gone"), F.count("*").alias("n")).where("gone OR n > 1").select(*key, "gone")
    gone = saved(gone, "gone")
    small = stored_bytes(gone) <= BROADCAST_BYTES
    own = fresh(df, "each")
    gone = gone.toDF(*[f"{own}{c}" for c in ("id", "version", "gone")])
    rows = df.withColumns({f"{own}id": F.col("doc_id").cast("long"), f"{own}version": F.xxhash64(F.col("text").cast("string"))})
    rows = rows.join(F.broadcast(gone) if small else gone, [f"{own}id", f"{own}version"], "left").where(f"{own}gone IS NULL OR NOT {own}gone")
    once, again = rows.where(f"{own}gone IS NULL"), rows.where(f"{own}gone IS NOT NULL").dropDuplicates([f"{own}id", f"{own}version"])
    return once.unionByName(again).select(*df.columns)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles with a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


__all__ = ["near_duplicates", "one_of_each", "op1_minhash_dedup"]
