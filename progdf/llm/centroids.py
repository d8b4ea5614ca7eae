"""Centroid clustering of vectors on exact integers, with ball trees that give whole balls to a centroid.

Every partition cuts its vectors into blocks of at most BLOCK and makes a metric tree of each: nodes halve their vectors along the line
between two far ones and hold radius, count and integer sum. Trees are stored once. A round takes all centroids down every tree:
where the nearest centroid of a ball's centre is nearer by more than twice the radius than another, the triangle inequality rules that
other one out for the whole ball; a ball with one centroid left adds its count and sum without looking at its vectors, others go on to
their halves, and leaves compare their vectors exactly. Bounds are in floating point with a margin that exceeds their error, so what
is ruled out is strictly farther and results are those of comparing all vectors with all centroids. A round sends 65 numbers for each cluster and
partition through a shuffle and as many for each cluster to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, forget, saved, table, tidy

#: Vectors of a tree, and of a leaf, at most.
BLOCK, LEAF = 1024, 16
#: Components in absolute value stay below, so that squared distances of up to 64 of them fit into 63 bits.
BOUND = 1 << 27
#: Errors of distances in floating point are far below: absolute, relative.
MARGIN = 1e-5, 1e-9
#: Bytes of an Arrow batch: a row is a tree of up to 340 kB.
BATCH_BYTES = 32 << 20


def integer_vectors(df: DataFrame, size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * component) of vectors with `size` components, none null or non-finite; other rows take no part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.where((F.size("embedding") == size) & fine).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def starts(vectors: DataFrame, k: int = 8, salt: str = "3:") -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt and id, in that order; fewer if there are fewer. Rows that repeat an id are ordered by their components, rows without id come last."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(by.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _edges(n: int, level: int) -> np.ndarray:
    """Bounds of the nodes of a level: each node's vectors are halved."""
    return (n * np.arange((1 << level) + 1, dtype=np.int64)) >> level


def _farthest(dist: np.ndarray, edge: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Place of the farthest vector of each node."""
    top = np.maximum.reduceat(dist, edge[:-1])
    at = np.flatnonzero(dist == top[node])
    return at[np.unique(node[at], return_index=True)[1]]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class Tree:
    """A metric tree over vectors in its own order; nodes level by level from the root, halves of node j of a level are 2j and 2j + 1 of the next."""

    def __init__(self, points: np.ndarray, depth: int, radius: np.ndarray, sums: np.ndarray):
        self.points, self.depth, self.radius, self.sums = points, depth, radius, sums

    @staticmethod
    def grown(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree of points (n x d integers, n > 0) and the order that it puts them into."""
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(n / leaf))))
        order, radius, sums = np.arange(n), [], []
        for level in range(depth + 1):
            edge = _edges(n, level)
            own, node = points[order], np.repeat(np.arange(1 << level), np.diff(edge))
            total = np.add.reduceat(own, edge[:-1], axis=0)
            away = own - (total / np.diff(edge)[:, None])[node]
            dist = _norms(away)
            radius.append(np.maximum.reduceat(dist, edge[:-1]))
            sums.append(total)
            if level < depth:
                a = own[_farthest(dist, edge, node)]
                b = own[_farthest(_norms((own - a[node]).astype(np.float64)), edge, node)]
                along = np.einsum("ij,ij->i", away, (b - a).astype(np.float64)[node])
                order = order[np.lexsort((along, node))]
        return Tree(points[order], depth, np.concatenate(radius), np.concatenate(sums)), order

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]]:
        """What each centroid gets: (cluster, count, sum, bounds) of whole balls, and (cluster, None, None, place) of single vectors."""
        n, k = len(self.points), len(centroids)
        node, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(self.depth + 1):
            edge, at = _edges(n, level), (1 << level) - 1 + node
            count = edge[node + 1] - edge[node]
            centre = self.sums[at] / count[:, None]
            dist = np.stack([_norms(centre - c) for c in centroids], axis=1)
            dist[~alive] = np.inf
            reach = 2 * self.radius[at] + dist.min(axis=1)
            alive &= dist <= (reach * (1 + MARGIN[1]) + MARGIN[0])[:, None]
            whole = alive.sum(axis=1) == 1
            yield alive[whole].argmax(axis=1), count[whole], self.sums[at[whole]], np.stack([edge[node[whole]], edge[node[whole] + 1]])
            node, alive = node[~whole], alive[~whole]
            if level < self.depth:
                node, alive = np.stack([2 * node, 2 * node + 1], axis=1).ravel(), np.repeat(alive, 2, axis=0)
        edge = _edges(n, self.depth)
        length = edge[node + 1] - edge[node]
        place = np.repeat(edge[node] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        alive = np.repeat(alive, length, axis=0)
        best, cluster = np.full(len(place), np.iinfo(np.int64).max), np.zeros(len(place), np.int64)
        for z, c in enumerate(centroids):  # a tie stays with the smaller number
            mine = np.flatnonzero(alive[:, z])
            d = squared(self.points[place[mine]], c)
            nearer = d < best[mine]
            best[mine[nearer]], cluster[mine[nearer]] = d[nearer], z
        yield cluster, None, None, place

    def totals(self, centroids: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
        """Add what each centroid gets to count (k) and sums (k x d)."""
        for cluster, n, total, place in self.assigned(centroids):
            np.add.at(count, cluster, 1 if n is None else n)
            np.add.at(sums, cluster, self.points[place] if total is None else total)

    def clusters(self, centroids: np.ndarray) -> np.ndarray:
        """The centroid of each vector."""
        out = np.zeros(len(self.points), np.int64)
        for cluster, n, _, place in self.assigned(centroids):
            if n is None:
                out[place] = cluster
            else:
                for z, a, b in zip(cluster.tolist(), *place.tolist(), strict=True):
                    out[a:b] = z
        return out


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = points - centroid
    return np.einsum("ij,ij->i", away, away)


TREES = "vec_id array<long>, n long, points binary, depth int, radius binary, sums binary"


def trees(vectors: DataFrame, block: int = BLOCK, size: int = 64) -> DataFrame:
    """A row for each tree: ids and vectors in its order, radius and sum of each node. Raises where a component is beyond BOUND."""
    names = [x.split()[0] for x in TREES.split(", ")]

    def row(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        if len(points) and np.abs(points).max() >= BOUND:
            raise OverflowError(f"components of {BOUND} and more have squared distances beyond 63 bits")
        tree, order = Tree.grown(points)
        cells = ids.take(pa.array(order)).to_pylist(), len(points), tree.points.astype(np.int32).tobytes(), tree.depth, tree.radius.tobytes(), tree.sums.tobytes()
        kinds = pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names)

    def run(batches):
        ids, points, held = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                while part.num_rows:
                    take = part.slice(0, block - held)
                    ids.append(take.column(0))
                    points.append(take.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64))
                    held, part = held + take.num_rows, part.slice(take.num_rows)
                    if held == block:
                        yield row(pa.concat_arrays(ids), np.concatenate(points))
                        ids, points, held = [], [], 0
        if held:
            yield row(pa.concat_arrays(ids), np.concatenate(points))

    return vectors.select("vec_id", "v").mapInArrow(tidy(run), TREES)


def _read(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for r in range(batch.num_rows):
        at = {name: batch.column(j)[r] for j, name in enumerate(batch.schema.names)}
        shape = lambda name, kind: np.frombuffer(at[name].as_py(), kind)  # noqa: B023, E731
        yield at["vec_id"].values, Tree(shape("points", np.int32).reshape(-1, size).astype(np.int64), at["depth"].as_py(), shape("radius", np.float64), shape("sums", np.int64).reshape(-1, size))


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum/count) of what each gets; those that get nothing stay."""
    k, size = centroids.shape

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for _, tree in _read(batch, size):
                tree.totals(centroids, count, sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(count), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = forest.mapInArrow(tidy(run), "cluster long, n long, sums array<long>").where("n > 0")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in cells.collect():  # k * size numbers
        out[r["cluster"], r["j"]] = r["x"] // r["n"]
    return out


def placed(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector: its nearest centroid, ties to the smaller number, and the squared distance."""
    size = centroids.shape[1]

    def run(batches):
        for batch in batches:
            for ids, tree in _read(batch, size):
                cluster = tree.clusters(centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(squared(tree.points, centroids[cluster]))], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(tidy(run), "vec_id long, cluster int, distance long")


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(df: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    df: vec_id, embedding, other columns ignored. Vectors that are null, of another size or with a null or non-finite component have no
    row. Rows that repeat an id or a vector are vectors of their own; a null id stays null. With fewer than k vectors there are as many centroids as
    vectors; an empty table gives none. A component of 2**27 or more after scaling raises, as does a sum beyond 63 bits.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    vectors = integer_vectors(df, size, scale)
    centroids = starts(vectors, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    forest = saved(trees(vectors, size=size), "trees")
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    rows = saved(placed(forest, centroids), "clusters")
    forget(forest)
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    own = F.array(*[F.lit(inertia.get(z, 0)).cast("long") for z in range(len(centroids))])
    sha = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()])
    return rows.select("vec_id", "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), sha[F.col("cluster")].alias("centroid_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 8 clusters after 10 rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    steps = ["""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
    "cells AS MATERIALIZED (SELECT r, i, v[i] AS x FROM kept, range(1, 65) t(i))",
    f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS k FROM kept QUALIFY k < {k})",
    "c0 AS MATERIALIZED (SELECT k, i, v[i] AS x FROM first, range(1, 65) t(i))"]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (SELECT r, k, sum((cells.x - c.x) * (cells.x - c.x)) AS d FROM cells JOIN c{n} c USING (i) GROUP BY r, k),
    a{n} AS MATERIALIZED (SELECT r, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN cells USING (r) GROUP BY k, i),
    c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{n} c LEFT JOIN m{n} USING (k, i))""")
    steps.append(f"shas AS (SELECT k, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN shas USING (k)"""


#: DuckDB SQL that compares all vectors with all centroids in each round.
OP11_SQL = _sql()
