"""Approximate nearest neighbours by learned partitions.

A graph of near neighbours of a sample is cut into parts of about equal size that keep neighbours together. A small classifier
learns the part of a vector, softly: also the parts of its neighbours. Every vector is indexed under its likeliest part; a
query goes to several of the likeliest, where all vectors are scored exactly and in double precision. How many is measured on
sample vectors that nothing was learned from, so that the wanted recall is met. Parts are dealt to blocks of bounded size, so
neither a large part nor many equal vectors meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, saved, table

#: Distinct vectors that the index is fitted on, those of least hash, the last fifth only to measure; parts at most, as each has to have some
#: dozens of sample vectors; vectors of a block.
SAMPLE, PARTS, BLOCK = 7500, 160, 8192
#: Recall of the nearest neighbours that the number of parts for a query is chosen for.
RECALL, NEAREST = 0.95, 5
DEGREE, HIDDEN, EPOCHS = 10, 128, 40


def usable(df: DataFrame, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v, norm2): rows with an id and a vector without null or non-finite components that is not zero."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(ident).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(F.col(ident).cast("long").alias("vec_id"), v.alias("v"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _graph(x: np.ndarray, degree: int) -> np.ndarray:
    near = np.empty((len(x), min(degree, max(0, len(x) - 1))), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near[a : a + 512] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else 0
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Part of each vector: halving along principal directions first, then moves to the part of most neighbours while there is room."""
    part, todo = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, low, count = todo.pop()
        if count == 1 or len(rows) < 2:
            part[rows] = low
            continue
        y = x[rows] - x[rows].mean(0)
        d = np.linalg.eigh(y.T @ y)[1][:, -1]
        order = rows[np.argsort(y @ d, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        todo += [(order[:cut], low, left), (order[cut:], low + left, count - left)]
    room = int(np.ceil(slack * len(x) / parts))
    both = [(np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()), (near.ravel(), np.repeat(np.arange(len(x)), near.shape[1]))]
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        for a, b in both:
            np.add.at(votes, (a, part[b]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier with one hidden layer that gives a vector's parts by probability."""

    def __init__(self, w1, b1, w2, b2):
        self.w = (w1, b1, w2, b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray) -> Router:
        rng = np.random.default_rng(3)
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, target.shape[1]), (target.shape[1],)]
        w = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        scale = np.sqrt(x.shape[1])
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                a = x[at] * scale
                h = np.maximum(a @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                dz = (p - target[at]) / len(at)
                dh = (dz @ w[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((a.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    g = g + 1e-4 * w[k] if w[k].ndim == 2 else g
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    w[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(w[0] * scale, *w[1:])


def fit(x: np.ndarray, parts: int, recall: float = RECALL) -> tuple[Router, int]:
    """A router learned from sample vectors, and the number of parts with which unseen ones reach the recall."""
    x = unit(x)
    seen = x[: max(1, len(x) - len(x) // 5)]
    parts = max(1, min(parts, len(seen) // 4))
    near = _graph(seen, DEGREE)
    part = balanced_parts(seen, near, parts)
    target = np.zeros((len(seen), parts))
    np.add.at(target, (np.arange(len(seen)), part), max(1, near.shape[1]) / 2)
    np.add.at(target, (np.repeat(np.arange(len(seen)), near.shape[1]), part[near].ravel()), 1)
    router = Router.fit(seen, target / target.sum(1, keepdims=True))
    unseen = np.arange(len(seen), len(x))
    if not len(unseen):
        return router, parts
    s = x[unseen] @ x.T
    s[np.arange(len(unseen)), unseen] = -2
    true = np.argsort(-s, axis=1)[:, :NEAREST]
    z = router.logits(x)
    rank = np.argsort(np.argsort(-z[unseen], axis=1), axis=1)
    at = np.take_along_axis(rank, z.argmax(1)[true], 1)
    return router, next(p for p in range(1, parts + 1) if (at < p).mean() >= recall or p == parts)


def parts_for(n: int) -> int:
    """Parts of an index of n vectors: the root of half of them, so that a router and a part cost about the same; PARTS at most."""
    return max(1, min(PARTS, round((n / 2) ** 0.5)))


def train(vectors: DataFrame, sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL) -> tuple[int, Router | None, int]:
    """(dimensions, router, probes) of the commonest length's vectors, learned from the `sample` distinct ones of least hash.

    parts: by the number of vectors unless it is given.
    """
    top = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return 0, None, 0
    rows = vectors.where(F.size("v") == top["d"]).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(sample).toArrow()
    return top["d"], *fit(matrix(rows["v"]), parts or parts_for(top["count"]), recall)


def _routed(vectors: DataFrame, router: Router, probes: int, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """(vec_id, v, parts): the likeliest parts of each vector, and further ones until they hold `least` vectors by their sizes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = router.logits(unit(matrix(batch.column(1))))
            best = np.argsort(-z, axis=1, kind="stable").astype(np.int32)
            count = np.full(len(best), min(probes, z.shape[1]))
            if sizes is not None:
                count = np.minimum(np.maximum(count, (np.cumsum(sizes[best], axis=1) < least).sum(1) + 1), z.shape[1])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(best[np.arange(z.shape[1]) < count[:, None]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "parts"])

    return vectors.mapInArrow(run, "vec_id long, v array<double>, parts array<int>")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision, the same for equal vectors whatever stands beside them."""
    return np.einsum("ij,ij->i", q, x) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x)))


def _best(query_id, q, vec_id, x, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of x to each query, ties to smaller ids, without the query's own row."""
    out = []
    ux = unit(x)
    for a in range(0, len(q), 64):
        s = unit(q[a : a + 64]) @ ux.T
        s[query_id[a : a + 64, None] == vec_id] = -np.inf
        for i in range(len(s)):
            n = min(k, len(x))
            least = np.partition(s[i], len(x) - n)[len(x) - n]
            # all that may be among them in spite of rounding, then the exact measure
            at = np.flatnonzero(s[i] >= least - 1e-9) if np.isfinite(least) else np.flatnonzero(np.isfinite(s[i]))
            exact = cosines(np.broadcast_to(q[a + i], (len(at), q.shape[1])), x[at])
            order = np.lexsort((vec_id[at], -exact))[:k]
            out.append((np.full(len(order), query_id[a + i]), vec_id[at][order], exact[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(df: DataFrame, queries: DataFrame, k: int = NEAREST, recall: float = RECALL, sample: int = SAMPLE, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine found for each query, nearest first, ties to smaller vec_id.

    df, queries: vec_id, embedding, other columns ignored. A vector that is null, zero or holds a null or non-finite
    component takes no part, and so does one whose length is not the commonest. A row is never its own neighbour; where ids
    repeat, all rows of the query's id are left out, equal rows of another id count once, and a repeated query is asked once.
    """
    arrow_rows(df.sparkSession)
    vectors = saved(usable(df).distinct(), "vectors")
    dims, router, probes = train(vectors, sample, parts, recall)
    if router is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = saved(_routed(vectors.where(F.size("v") == dims), router, 1).select("vec_id", "v", F.col("parts")[0].alias("part")), "index")
    size = index.groupBy("part").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    size = saved(size, "parts")
    sizes = np.zeros(PARTS if parts is None else parts, np.int64)
    for r in size.collect():  # a row for each part, of which there is a fixed number at most
        sizes[r["part"]] = r["n"]
    size = F.broadcast(size)
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    stored = index.join(size, "part").select("part", block.alias("block"), "vec_id", "v")
    asked = _routed(usable(queries).where(F.size("v") == dims).dropDuplicates(["vec_id"]), router, probes, sizes, 2 * k + 2).select("vec_id", "v", F.explode("parts").alias("part"))
    asked = asked.join(size, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            found = _best(left["query_id"].to_numpy(), matrix(left["q"]), right["vec_id"].to_numpy(), matrix(right["v"]), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    found = asked.groupBy("part", "block").cogroup(stored.groupBy("part", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all embeddings to those whose vec_id is divisible by 50."""
    df = table(spark, sf_dir, "embeddings")
    return nearest(df, df.where("vec_id % 50 = 0"))
