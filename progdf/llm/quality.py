"""Quality of documents by a generalised additive model with pairwise interactions.

Cyclic boosting gives each feature in turn one shallow tree over its bins, for many rounds, and adds the tree's steps to the feature's
lookup table; then pairs of features that explain what is left get tables of their own the same way. A score is the sum of a
few table entries, so scoring is bin lookups and additions on whole columns. Labels serve for fitting alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_rows, held_out, saved, shingles, slices, table, tidy, Words

#: Most labelled rows that a model is fitted on: those of least hash.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, PATIENCE = 300, 150, 0.1, 4, 25
#: Least score of a document that is kept.
LEAST = 0.7

FEATURES = (
    "log_words", "word_bytes", "word_bytes_sd", "high_bytes", "upper", "digits", "stops", "marks", "bangs", "distinct", "repeated3", "log_lines", "line_words",
    "bare_words", "marked_words", "short_words", "top_word", "upper_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_STOPS, _MARKS = _class(".,;:?'\"()-"), _class("#$%&*+/<=>@[\\]^_`{|}~")


def features(column) -> np.ndarray:
    """One row of FEATURES for each text, from its whole bytes; null and empty texts give zeros."""
    w = Words(column)
    raw, rows = w.bytes, w.rows
    bounds = np.minimum(w.offsets, len(raw))
    size = np.maximum(1, np.diff(w.offsets))

    def per(flags: np.ndarray, at: np.ndarray = bounds) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return (c[at[1:]] - c[at[:-1]]).astype(float)

    n = np.diff(w.first).astype(float)
    some = np.maximum(1, n)
    length = (w.end - w.start).astype(float)
    c = np.append(0.0, np.cumsum(length))
    c2 = np.append(0.0, np.cumsum(length**2))
    mean = (c[w.first[1:]] - c[w.first[:-1]]) / some
    var = np.maximum(0, (c2[w.first[1:]] - c2[w.first[:-1]]) / some - mean**2)
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    letters = np.maximum(1, per(upper | lower))
    lines = per(raw == 10) + 1
    one, b1 = shingles(w, 1)
    three, b3 = shingles(w, 3)
    marks = _MARKS[raw]
    cm = np.append(0, np.cumsum(marks))
    alnum = np.append(0, np.cumsum(upper | lower | (raw >= 128) | ((raw >= 48) & (raw <= 57))))
    cu = np.append(0, np.cumsum(upper))
    cl = np.append(0, np.cumsum(lower))
    bare = alnum[w.end] == alnum[w.start]
    top = np.zeros(rows)
    if len(w.hash):
        order = np.lexsort((w.hash, w.row))
        h, r = w.hash[order], w.row[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
        np.maximum.at(top, r[new], np.diff(np.append(new, len(h))).astype(float))
    out = np.stack([
        np.log1p(n), mean, np.sqrt(var), per(raw >= 128) / size, per(upper) / letters, per((raw >= 48) & (raw <= 57)) / size, per(_STOPS[raw]) / some, per(marks) / some, per(raw == 33) / some,
        np.diff(b1) / some, 1 - np.diff(b3) / np.maximum(1, n - 2), np.log1p(lines), n / lines,
        per(bare, w.first) / some, per(cm[w.end] > cm[w.start], w.first) / some, per(length <= 3, w.first) / some, top / some,
        per((cu[w.end] - cu[w.start] > 1) & (cl[w.end] == cl[w.start]), w.first) / some,
    ], axis=1)
    out[n == 0] = 0
    return out


def measured(df: DataFrame) -> DataFrame:
    """(doc_id, feature columns) of every row of df's doc_id and text."""
    arrow_rows(df.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                x = features(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text").mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, reg: float = 1.0) -> np.ndarray:
    """Newton steps of a tree of a few leaves over ordered bins with gradient and curvature sums g and h."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + reg)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = np.arange(a + 1, b)
            if len(k):
                gain = value(a, k) + value(k, b) - value(a, b)
                i = int(gain.argmax())
                best = max(best, (gain[i], int(k[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return step


def _tree2(g: np.ndarray, h: np.ndarray, reg: float = 1.0) -> np.ndarray:
    """The best tree over a grid that cuts one axis and then each part along the other."""
    best, step = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        ca, cb = np.cumsum(a, 0), np.cumsum(b, 0)
        for k in range(a.shape[0] - 1):
            out, gain = np.empty_like(a), 0.0
            for part, (x, y) in ((slice(0, k + 1), (ca[k], cb[k])), (slice(k + 1, None), (ca[-1] - ca[k], cb[-1] - cb[k]))):
                s = _tree(x, y, 2, reg)
                out[part] = s
                gain += float((s * x).sum() - 0.5 * (s * s * y).sum())
            if gain > best:
                best, step = gain, out.T if turn else out
    return step


class Gam:
    """Bins, lookup tables of features and of pairs, and an intercept."""

    def __init__(self, edges, start: float, tables, pair_edges, pairs):
        self.edges, self.start, self.tables, self.pair_edges, self.pairs = edges, start, tables, pair_edges, pairs

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, t in enumerate(self.tables):
            out += t[np.searchsorted(self.edges[j], x[:, j], side="right")]
        grid = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for p, _ in self.pairs for j in p}
        for (i, j), t in self.pairs:
            out += t[grid[i], grid[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of 0/1 labels; every fifth row, in the order given, decides when to stop. Without rows of both labels, a constant."""
    edges, pair_edges = _edges(x, BINS) if len(x) else [np.zeros(0)] * len(FEATURES), _edges(x, PAIR_BINS) if len(x) else [np.zeros(0)] * len(FEATURES)
    mean = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, float(np.log(mean / (1 - mean))), [np.zeros(len(e) + 1) for e in edges], pair_edges, [])
    if len(set(y.tolist())) < 2:
        return model
    check = np.arange(len(y)) % 5 == 4
    fitted = ~check
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    f = np.full(len(y), model.start)
    sig = lambda v: 1 / (1 + np.exp(-v))
    loss = lambda v: float(np.mean(np.logaddexp(0, np.where(y[check] > 0, -v[check], v[check])))) if check.any() else 0.0

    def boost(rounds: int, turns: list, places: list, tables: list) -> None:
        nonlocal f
        least, since, kept, kept_f = loss(f), 0, [t.copy() for t in tables], f.copy()
        for _ in range(rounds):
            for k, tree in enumerate(turns):
                p = sig(f[fitted])
                at, shape = places[k], tables[k].shape
                g = np.bincount(at[fitted], y[fitted] - p, tables[k].size).reshape(shape)
                h = np.bincount(at[fitted], p * (1 - p), tables[k].size).reshape(shape)
                step = RATE * tree(g, h)
                tables[k] += step
                f = f + step.ravel()[at]
            now = loss(f)
            if now < least - 1e-6:
                least, since, kept, kept_f = now, 0, [t.copy() for t in tables], f.copy()
            elif (since := since + 1) >= PATIENCE:
                break
        for t, best in zip(tables, kept, strict=True):
            t[...] = best
        f = kept_f

    boost(ROUNDS, [lambda g, h: _tree(g, h, LEAVES)] * len(bins), bins, model.tables)
    # the pairs whose best tree explains most of what is left
    grid = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    p = sig(f[fitted])
    gains = []
    for i in range(len(grid)):
        for j in range(i):
            shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
            at = grid[i] * shape[1] + grid[j]
            g = np.bincount(at[fitted], y[fitted] - p, shape[0] * shape[1]).reshape(shape)
            h = np.bincount(at[fitted], p * (1 - p), shape[0] * shape[1]).reshape(shape)
            gains.append((float((_tree2(g, h) * g).sum()), i, j, at, shape))
    chosen = sorted(gains, key=lambda v: (-v[0], v[1], v[2]))[:PAIRS]
    model.pairs = [((i, j), np.zeros(shape)) for _, i, j, _, shape in chosen]
    boost(PAIR_ROUNDS, [_tree2] * len(chosen), [at for *_, at, _ in chosen], [t for _, t in model.pairs])
    return model


def train(df: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Gam:
    """Fit on the documents of df that have a label and are not held out, at most `rows` of them, those of least hash.

    Of rows that repeat a doc_id the one with the least features counts.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels")  # at most `rows` rows
    some = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left_semi")
    one = measured(some).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("f")).select("doc_id", "f.*")
    data = one.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select(*FEATURES, "quality").toPandas()  # at most `rows` rows
    order = np.random.default_rng(5).permutation(len(data))
    return fit(data[list(FEATURES)].to_numpy(float)[order], (data["quality"] == 1).to_numpy(float)[order])


def scored(df: DataFrame, model: Gam) -> DataFrame:
    """df with a column score; every other column passes through."""
    df = df.drop("score").withColumn("text", F.col("text").cast("string"))
    names = df.columns
    held = df.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    arrow_rows(df.sparkSession)

    def run(batches):
        for batch in batches:
            text = batch.column(names.index("text"))
            for a, b in slices(text):
                s = held.value.score(features(text.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(s)], [*names, "score"])

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, StructField("score", DoubleType())]))


def quality_scores(df: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, least: float = LEAST) -> DataFrame:
    """df with score, from 0 to 1, and predicted, 1 if score >= least.

    df: doc_id, text and any other columns, which pass through; columns of the names added here are replaced. labels: doc_id,
    quality (0 or 1), others ignored; null labels teach nothing, and of several labels of a document the greatest counts. Null
    and empty texts are scored as texts without words; repeated rows stay. Without labels every score is 0.5.
    """
    return scored(df.drop("predicted"), train(df, labels, rows)).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    out = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
