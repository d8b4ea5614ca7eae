"""Shared helpers: scratch tables, row keys, vectorised word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch.
ARROW_ROWS = 500
#: Learned operators train where crc32(doc_id) mod 4 is not this.
HELD_OUT = 2

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xBF58476D1CE4E5B9)
_K3 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x100000001B3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where the setting is absent and all runs on one machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "progdf-checkpoints")
    return d.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/progdf/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._progdf_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a table made by saved(), as it is stored."""
    jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(df._progdf_path)
    return p.getFileSystem(jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def forget(*dfs: DataFrame) -> None:
    """Delete tables made by saved() that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_progdf_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def arrow_rows(spark: SparkSession) -> None:
    """Rows in an Arrow batch sent to Python: long texts come few at a time. One number for all, as the session has one setting for all its plans."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A beginning of column names that no column of df has."""
    n = 0
    while any(c.lower().startswith(f"_{name}{n}_") for c in df.columns):
        n += 1
    return f"_{name}{n}_"


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, forget=lambda: None):
    """A mapInArrow function that forgets what it kept and gives memory back to the system when its partition ends: Python workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return wrapped


def held_out(doc_id) -> F.Column:
    """True on rows that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("_POWERS", _BASE), ("_INVERSES", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _POWERS, _INVERSES


def slices(*columns, most: int = 1 << 19):
    """(from, to) of runs of rows with about `most` bytes of text in all columns; a longer row is a run of its own."""
    offsets = sum(text_offsets(c) for c in columns)
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def text_offsets(column) -> np.ndarray:
    buf = column.buffers()[1]
    if buf is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if str(column.type).startswith("large") else np.int32
    return np.frombuffer(buf, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column, offsets: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of an Arrow string column, without a copy."""
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


class Words:
    """Words of a run of texts: byte ranges, row numbers and 64-bit hashes, all as arrays.

    lower: A-Z count as a-z in the hashes. Null and empty texts have no words.
    """

    def __init__(self, column, lower: bool = True):
        offsets = text_offsets(column)
        self.bytes = raw = text_bytes(column, offsets)
        self.rows = len(column)
        self.offsets = offsets = offsets - offsets[0]
        space = np.ones(len(raw) + 2, bool)
        np.logical_or(raw == 32, (raw >= 9) & (raw <= 13), out=space[1:-1])
        wordy = ~space
        begins = wordy[1:] & ~wordy[:-1]  # at byte i: a word starts there
        begins[offsets[(offsets > 0) & (offsets < len(raw))]] |= wordy[1:][offsets[(offsets > 0) & (offsets < len(raw))]]
        ends = wordy[:-1] & ~wordy[1:]
        ends[offsets[(offsets > 0) & (offsets < len(raw))]] |= wordy[:-1][offsets[(offsets > 0) & (offsets < len(raw))]]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)  # words before each text
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        low = raw
        if lower:
            low = raw.copy()
            low[(raw >= 65) & (raw <= 90)] += 32
        self.low = low
        self.hash = self.spans(self.start, self.end)

    def prefix(self) -> np.ndarray:
        if not hasattr(self, "_prefix"):
            power, _ = _powers(len(self.low) + 1)
            self._prefix = np.zeros(len(self.low) + 1, np.uint64)
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * power[: len(self.low)], out=self._prefix[1:])
        return self._prefix

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, independent of where they stand."""
        p = self.prefix()
        _, inverse = _powers(len(self.low) + 1)
        return mix((p[end] - p[start]) * inverse[start] + (end - start).astype(np.uint64) * _K1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: (hashes, row bounds). A text with fewer words, one at least, has its whole sequence as one."""
    n = np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(bounds[-1]) - bounds[row] + words.first[row]
    last = words.first[row + 1]
    h = np.zeros(len(at), np.uint64)
    padded = np.append(words.hash, np.zeros(k, np.uint64))
    for j in range(k):
        h = mix(h * _K1 + np.where(at + j < last, padded[at + j], np.uint64(0)) + np.uint64(j + 1))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        h, row = h[new], row[new]
    bounds = np.searchsorted(row, np.arange(len(n) + 1))
    return h, bounds
