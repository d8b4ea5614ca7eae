"""Periodic runs of words in whole texts, by bit-parallel comparison of a text with itself at a lag.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word extends keeping
period q, of `exponent` * q words and `least` words or more.

The words of a text are numbered, and bit i of plane j is bit j of the number of word i; a plane is one large integer. At lag q every plane
is XORed with itself shifted by q and the mismatches are ORed: a zero at i says that words i and i + q are identical. A stretch of t zeros
is isolated by ANDing the complement with itself shifted by 1, 2, 4 ... words, so each lag takes O(log t) operations on integers.

Lags go up to a quarter of the text. Those under SMALL are all compared. Of greater ones, in [2**k, 2**(k+1)), a run has to pass through a
word whose number is a multiple of the anchors' spacing and match from there for 2**k words: lags without such a word have no run, the
others go through the planes. What an anchor finds within a run that has a smaller period q0 for q + q0 words more belongs to that run (the theorem
of Fine and Wilf) and is no reason to compare. Nothing is capped; a text takes O(words * log(words)) and what its runs need.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, slices, table, tidy

#: Least number of periods and of words in a run.
EXPONENT, LEAST = 4, 6
#: Lags below are compared without looking for anchors.
SMALL = 16
#: Words after an anchor that are looked at before the planes are.
AHEAD = 64


def planes(ids: np.ndarray) -> list[int]:
    """Bit planes of word numbers, the lowest bits first."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> j) & 1, bitorder="little").tobytes(), "little") for j in range(bits)]


def _ones(x: int) -> np.ndarray:
    """Places of the set bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))


def stretches(bit_planes: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of the maximal stretches of `least` or more words that equal the words `lag` after them."""
    mismatch = 0
    for p in bit_planes:
        mismatch |= p ^ (p >> lag)
    long = ~mismatch & ((1 << (n - lag)) - 1)
    have = 1
    while have < least and long:
        step = min(have, least - have)
        long &= long >> step
        have += step
    if not long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _ones(long & ~(long << 1)), _ones(long & ~(long >> 1)) + least


def _anchored(ids: np.ndarray, k: int, top: int, exponent: int, reach: np.ndarray) -> np.ndarray:
    """Lags from 2**k to under 2**(k+1), `top` at most, at which words from some anchor on are repeated; reach: for each place how far runs from there or before it explain lags."""
    n, low = len(ids), 1 << k
    lags = np.arange(low, min(2 * low, top + 1))
    anchors = np.arange(0, n - low, low * (exponent - 2))
    padded = np.append(ids, np.full(2 * low + AHEAD, -1, ids.dtype))
    found: list[np.ndarray] = []
    rows = max(1, (1 << 21) // len(lags))
    for i in range(0, len(anchors), rows):
        a = anchors[i : i + rows]
        r, c = np.nonzero(padded[a[:, None] + lags] == ids[a][:, None])
        p, q = a[r], lags[c]
        open_ = p + q > reach[p]
        p, q = p[open_], q[open_]
        for ahead in range(1, min(low, AHEAD)):
            if not len(p):
                break
            same = padded[p + ahead] == padded[p + q + ahead]
            p, q = p[same], q[same]
        found.append(np.unique(q))
    return np.unique(np.concatenate(found)) if found else lags[:0]


def find_runs(ids: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of word numbers (0 and up), by start, then period. exponent: 3 at least."""
    if exponent < 3:
        raise ValueError("anchors need an exponent of 3 or more")
    n = len(ids)
    bit_planes = planes(ids)
    out: list[np.ndarray] = []
    ends = np.zeros(n + 1, np.int64)  # greatest end of the runs found so far that start here
    reach = np.zeros(n + 1, np.int64)  # the same of end - period
    top, k = n // exponent, 0
    while (1 << k) <= top:
        low = 1 << k
        lags = range(low, min(2 * low, top + 1)) if low < SMALL else _anchored(ids, k, top, exponent, np.maximum.accumulate(reach)).tolist()
        for q in lags:
            start, end = stretches(bit_planes, n, q, max((exponent - 1) * q, least - q))
            if not len(start):
                continue
            end = end + q
            own = np.maximum.accumulate(ends)[start] < end  # else a run of a smaller period holds it
            start, end = start[own], end[own]
            np.maximum.at(ends, start, end)
            np.maximum.at(reach, start, end - q)
            out.append(np.stack([start, end - start, np.full(len(start), q, np.int64)], axis=1))
        k += 1
    if not out:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: just the characters at which bytes are split."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbers(words: list[bytes]) -> np.ndarray:
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length/period; of equal ones the first, then that of the smallest period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op12_periodic_runs takes: one document in ten, by the CRC-32 of its id, repeats its words from some place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def _rows(df: DataFrame, cols: Callable, schema: str) -> DataFrame:
    """cols(doc_ids, texts) for some hundred kB of text at a time."""
    arrow_rows(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b in slices(text):
                yield pa.RecordBatch.from_arrays(cols(ids.slice(a, b - a), text.slice(a, b - a).to_pylist()), names)

    return df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text").mapInArrow(tidy(run), schema)


def periodic_runs(df: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(doc_id, start, length, period): a row for each run of every whole text, in words.

    df: doc_id, text, other columns ignored. Null, empty and blank texts have no runs; null and repeated doc_ids stay, a row of df each.
    """

    def cols(ids, texts):
        found = [find_runs(numbers(words_of(t)), exponent, least) for t in texts]
        at = pa.array(np.repeat(np.arange(len(texts)), [len(x) for x in found]))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return [ids.take(at), *(pa.array(rows[:, j]) for j in range(3))]

    return _rows(df, cols, "doc_id long, start long, length long, period long")


def collapsed(df: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_dropped): every text with each run cut to its first period. Texts without runs stay as they are, null included; in others the words that stay are joined by one space."""

    def one(text):
        words = words_of(text)
        runs = find_runs(numbers(words), exponent, least)
        if not len(runs):
            return text, 0
        gone = dropped(len(words), runs)
        return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass"), int(gone.sum())

    def cols(ids, texts):
        rows = [one(t) for t in texts]
        return [ids, pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())]

    return _rows(df, cols, "doc_id long, text string, n_dropped long")


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(df: DataFrame, alter: Callable[[int | None, list[bytes]], list[bytes]] = lambda _, words: words) -> DataFrame:
    """A row for each row of df: number of runs, the strongest run, SHA-256 of the list of runs and of the collapsed text.

    alter(doc_id, words) gives the words that count. Null texts have no words; without runs the strongest one is null in all its columns and
    the digest of the list is that of an empty text. Null and repeated doc_ids stay; other columns are ignored.
    """

    def one(doc_id, text):
        words = alter(doc_id, words_of(text))
        runs = find_runs(numbers(words))
        gone = dropped(len(words), runs).tolist()
        best = strongest(runs) or (None,) * 3
        listed = "".join([f"{s},{n},{p}\n" for s, n, p in runs.tolist()])
        kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
        return len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    def cols(ids, texts):
        rows = [one(i, t) for i, t in zip(ids.to_pylist(), texts, strict=True)]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return [ids, *(pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds))]

    return _rows(df, cols, DIGESTS)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one in ten with a repeated end."""
    return digests(table(spark, sf_dir, "documents"), planted)
