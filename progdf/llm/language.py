"""Language of words and documents by a linear-chain conditional random field.

Each word has hashed features: its affixes, its letter n-grams and its places in the lexicons of the languages. Weights of the features and
of the transitions are learned together by maximum likelihood; forward-backward gives every word its probabilities, so a
text that switches languages has words of several. A document's language is the one with most of its words' probability.

Sequences are cut into chunks for speed only: a chunk's transfer matrix carries what comes before it and after it, so the
probabilities are those of the whole text. Loops run over places in a chunk, numpy over all chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, give_back, held_out, slices, table, tidy, Words

#: Documents that a model is learned from, those of least hash; a longer text is used whole.
TRAIN_DOCS = 2000
BITS, CHUNK = 16, 64
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.05, 1e-6
#: A word is in a language's lexicon if it was seen so often, in so large a share in that language.
SEEN, SHARE = 3, 0.8
UNKNOWN = "und"


class LowerWords(Words):
    """Words with the capitals of Latin-1 lowered too, and whether they hold a letter."""

    def __init__(self, column):
        super().__init__(column, lower=False)
        raw = self.bytes
        low = raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        if len(raw) > 1:
            after = np.flatnonzero(raw[:-1] == 0xC3) + 1
            after = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
            low[after] += 32
        self.low = low
        if hasattr(self, "_prefix"):
            del self._prefix
        self.hash = self.spans(self.start, self.end)
        letters = np.append(0, np.cumsum((raw >= 128) | ((low >= 97) & (low <= 122))))
        self.lettered = letters[self.end] > letters[self.start]


class Features:
    """Feature numbers of the distinct words of a run of texts: (numbers, bounds) by word, and each word's place."""

    def __init__(self, w: LowerWords, lexicon: tuple[np.ndarray, np.ndarray], labels: int):
        self.hash, first, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        start, end = w.start[first], w.end[first]
        length = end - start
        mask = np.uint64((1 << BITS) - 1)
        numbers, owners = [], []

        def add(kind: int, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
            h = w.spans(a, b) + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))
            numbers.append(((h ^ (h >> np.uint64(29))) & mask).astype(np.int32))
            owners.append(of.astype(np.int32))

        every = np.arange(len(start), dtype=np.int32)
        for n in (1, 2, 3, 4):
            k = every[length >= n]
            add(n, start[k], start[k] + n, k)
            add(8 + n, end[k] - n, end[k], k)
        for n in (2, 3):
            count = np.maximum(0, length - n + 1)
            of = np.repeat(every, count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[of]
            add(16 + n, at, at + n, of)
        known, member = lexicon
        if len(known):
            place = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
            hit = known[place] == self.hash
            numbers.append(((1 << BITS) + np.where(hit, member[place], labels)).astype(np.int32))
            owners.append(every)
        owner, number = np.concatenate(owners), np.concatenate(numbers)
        owners.clear()
        numbers.clear()
        order = np.argsort(owner, kind="stable").astype(np.int32)
        self.numbers = number[order]
        self.bounds = np.searchsorted(owner[order], np.arange(len(start) + 1))
        self.lettered = w.lettered[first]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Score of every distinct word for every label; words without a letter favour none."""
        out = np.zeros((len(self.hash), weights.shape[1]), np.float32)
        if len(self.numbers):
            out = np.add.reduceat(weights[self.numbers], np.minimum(self.bounds[:-1], len(self.numbers) - 1), axis=0)
            out[~self.lettered | (np.diff(self.bounds) == 0)] = 0
        return out


def probabilities(scores: np.ndarray, first: np.ndarray, transfer: np.ndarray) -> np.ndarray:
    """Forward-backward: every word's label probabilities. first: bounds of the texts in the rows of scores."""
    k, n = scores.shape[1], np.diff(first)
    out = np.zeros_like(scores)
    per = -(-n // CHUNK)
    chunks = int(per.sum())
    if not chunks:
        return out
    text = np.repeat(np.arange(len(n)), per)
    rank = np.arange(chunks) - np.repeat(np.cumsum(per) - per, per)
    start = first[text] + rank * CHUNK
    size = np.minimum(CHUNK, first[text + 1] - start)
    grid = np.minimum(start[:, None] + np.arange(CHUNK), len(scores) - 1)
    inside = np.arange(CHUNK) < size[:, None]
    e = np.exp(scores - scores.max(1, keepdims=True))[grid]
    # the transfer matrix of each chunk
    m = np.broadcast_to(np.eye(k, dtype=np.float32), (chunks, k, k)).copy()
    for t in range(CHUNK):
        go = inside[:, t]
        if not go.any():
            break
        x = (m[go] @ transfer) * e[go, t][:, None, :]
        m[go] = x / x.max((1, 2), keepdims=True)
    # what comes into a chunk from before and from behind, chunk by chunk of every text
    before, behind = np.full((chunks, k), 1 / k, np.float32), np.ones((chunks, k), np.float32)
    by_rank = [np.flatnonzero(rank == r) for r in range(int(rank.max()) + 1)] if rank.max() < 64 else np.split(np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank))[:-1])
    for at in by_rank[1:]:
        x = np.einsum("ci,cij->cj", before[at - 1], m[at - 1])
        before[at] = x / x.sum(1, keepdims=True)
    for at in by_rank[:0:-1]:
        x = np.einsum("cij,cj->ci", m[at], behind[at])
        behind[at - 1] = x / x.sum(1, keepdims=True)
    alpha, a = np.empty((CHUNK, chunks, k), np.float32), before
    for t in range(CHUNK):
        x = (a @ transfer) * e[:, t]
        a = np.where(inside[:, t, None], x / x.sum(1, keepdims=True), a)
        alpha[t] = a
    b = behind
    gamma = np.empty((chunks, CHUNK, k), np.float32)
    for t in range(CHUNK - 1, -1, -1):
        g = alpha[t] * b
        gamma[:, t] = g / g.sum(1, keepdims=True)
        x = (e[:, t] * b) @ transfer.T
        b = np.where(inside[:, t, None], x / x.sum(1, keepdims=True), b)
    out[grid[inside]] = gamma[inside]
    return out


class Crf:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]):
        self.labels, self.weights, self.transitions, self.lexicon = labels, weights, transitions, lexicon

    def words(self, column) -> tuple[LowerWords, np.ndarray]:
        """The words of a run of texts and their label probabilities."""
        w = LowerWords(column)
        if not len(w.hash) or not self.labels:
            return w, np.zeros((len(w.hash), len(self.labels)), np.float32)
        f = Features(w, self.lexicon, len(self.labels))
        return w, probabilities(f.sums(self.weights)[f.word], w.first, np.exp(self.transitions))

    def texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(label, share) of each text: the language with most of the probability of its words with letters; -1 without such words."""
        w, p = self.words(column)
        total = np.zeros((w.rows, max(1, len(self.labels))))
        if p.size:
            for j in range(p.shape[1]):
                total[:, j] = np.bincount(w.row, p[:, j] * w.lettered, w.rows)
        n = total.sum(1)
        best = total.argmax(1)
        share = np.divide(total[np.arange(w.rows), best], n, out=np.zeros(w.rows), where=n > 0)
        return np.where(n > 0, best, -1), np.clip(share, 0, 1)


def _lexicon(w: LowerWords, label: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    h, word = np.unique(w.hash, return_inverse=True)
    counts = np.stack([np.bincount(word[label[w.row] == j], minlength=len(h)) for j in range(labels)], axis=1)
    total = counts.sum(1)
    keep = (total >= SEEN) & (counts.max(1) >= SHARE * total)
    return h[keep], counts[keep].argmax(1)


def fit(texts: pa.Array, label: np.ndarray, labels: list[str]) -> Crf:
    """Learn from whole texts in one language each, by stochastic gradient ascent with adaptive steps."""
    k = len(labels)
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    weights = np.zeros(((1 << BITS) + k + 1, k), np.float32)
    transitions = np.zeros((k, k), np.float32)
    if k < 2 or not len(texts):
        return Crf(labels, weights, transitions, empty)
    w = LowerWords(texts)
    lexicon = _lexicon(w, label, k)
    f = Features(w, lexicon, k)
    # chunks of the training texts are sequences of their own
    n = np.diff(w.first)
    per = -(-n // CHUNK)
    text = np.repeat(np.arange(len(n)), per)
    start = w.first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * CHUNK
    size = np.minimum(CHUNK, w.first[text + 1] - start)
    gw, gt = np.full(weights.shape, 1e-4, np.float32), np.full((k, k), 1e-4, np.float32)
    rng = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(start))
        for lo in range(0, len(order), BATCH):
            c = order[lo : lo + BATCH]
            at = np.minimum(start[c, None] + np.arange(CHUNK), len(w.hash) - 1)
            inside = np.arange(CHUNK) < size[c, None]
            used, place = np.unique(f.word[at[inside]], return_inverse=True)
            count = f.bounds[used + 1] - f.bounds[used]
            of = np.repeat(np.arange(len(used)), count)
            numbers = f.numbers[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + f.bounds[used][of]]
            own = np.stack([np.bincount(of, weights[numbers, j], len(used)) for j in range(k)], axis=1)
            own[~f.lettered[used]] = 0
            e = np.ones((len(c), CHUNK, k))
            e[inside] = np.exp(own - own.max(1, keepdims=True))[place]
            t = np.exp(transitions.astype(float))
            y = label[text[c]]
            alpha, a = np.empty((CHUNK + 1, len(c), k)), np.full((len(c), k), 1 / k)
            alpha[0] = a
            for s in range(CHUNK):
                x = (a @ t) * e[:, s]
                a = np.where(inside[:, s, None], x / x.sum(1, keepdims=True), a)
                alpha[s + 1] = a
            b, gamma, step = np.ones((len(c), k)), np.empty((len(c), CHUNK, k)), np.zeros((k, k))
            for s in range(CHUNK - 1, -1, -1):
                g = alpha[s + 1] * b
                gamma[:, s] = g / g.sum(1, keepdims=True)
                eb = e[:, s] * b
                pair = alpha[s][:, :, None] * t * eb[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                go = inside[:, s] & (s > 0)
                step -= pair[go].sum(0)
                step[np.arange(k), np.arange(k)] += np.bincount(y[go], minlength=k)
                x = eb @ t.T
                b = np.where(inside[:, s, None], x / x.sum(1, keepdims=True), b)
            miss = -gamma[inside]
            miss[np.arange(len(miss)), np.repeat(y, size[c])] += 1
            by_word = np.stack([np.bincount(place, miss[:, j], len(used)) for j in range(k)], axis=1)
            by_word[~f.lettered[used]] = 0
            some, inverse = np.unique(numbers, return_inverse=True)
            grad = np.stack([np.bincount(inverse, by_word[of, j], len(some)) for j in range(k)], axis=1) / len(c) - DECAY * weights[some]
            gw[some] += grad**2
            weights[some] += RATE * grad / np.sqrt(gw[some])
            step /= len(c)
            gt += step**2
            transitions += (RATE * step / np.sqrt(gt)).astype(np.float32)
    return Crf(labels, weights, transitions, lexicon)


def train(df: DataFrame, docs: int = TRAIN_DOCS) -> Crf:
    """Learn from the texts that are not held out and have a lang, at most `docs` of them, by hash.

    Of rows that repeat a doc_id the one with the least lang and text counts. A language that none of them has is never predicted.
    """
    arrow_rows(df.sparkSession)
    rows = df.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # ids of the sample come first, so that only its texts are moved
    ids = rows.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs)
    one = rows.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r"))
    got = one.orderBy("doc_id").select("doc_id", "r.text", "r.lang").toArrow()  # at most `docs` rows
    langs = got["lang"].to_pylist()
    labels = sorted(set(langs))
    texts = got["text"].combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    model = fit(texts, np.array([labels.index(x) for x in langs], np.int64), labels)
    del got, texts
    give_back()
    return model


def languages(df: DataFrame, model: Crf | None = None, docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of df.

    df: doc_id, text, lang (to learn from only), other columns ignored. A text that is null or has no letter is `und` with score
    0. Otherwise score is the share of the predicted language in the probability of the words. A null doc_id stays null and
    is not held out; repeated rows stay. Where nothing can be learned every text is `und`; of the languages only those of the
    sample learned from, `docs` documents at most, are ever predicted.
    """
    spark = df.sparkSession
    model = model or train(df, docs)
    held = spark.sparkContext.broadcast(model)  # its size is fixed, but for the lexicon of the bounded sample
    arrow_rows(spark)

    def run(batches):
        crf = held.value
        names = np.array([*crf.labels, UNKNOWN], object)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.column(1).slice(a, b - a)
                best, share = crf.texts(part)
                for i in np.flatnonzero(best >= 0):
                    if not any(map(str.isalpha, part[int(i)].as_py())):
                        best[i], share[i] = -1, 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    out = df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def switches(text: str, model: Crf) -> list[tuple[str, str, float]]:
    """(word, language, probability) of the words of one text."""
    w, p = model.words(pa.array([text]))
    raw = text.encode()
    return [(raw[a:b].decode(errors="replace"), model.labels[j], float(q[j])) for a, b, q in zip(w.start, w.end, p, strict=True) for j in [int(q.argmax())]]


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return languages(table(spark, sf_dir, "documents"))
