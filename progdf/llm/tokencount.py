"""Token counts of whole texts by a two-tier lookup of pre-tokens, for SentencePiece models of kind BPE.

A pre-token is a run of spaces with what follows it up to the next space or line feed, or a run of line feeds with what follows it. No
piece of the vocabulary goes over such a boundary (checked when a model is read), so the merges of BPE never do, and the tokens of a
text are those of its pre-tokens, one after the other.

First tier: the lengths of the pre-tokens that are frequent in all texts, broadcast; at most COUNTERS entries of at most LONGEST
characters. They are found by mergeable Misra-Gries summaries: each partition keeps COUNTERS counters whatever its size, summaries are
merged FAN at a time, and every pre-token with more than a (COUNTERS + 1)th of all occurrences is among them. Second tier: what a worker
misses it encodes once and keeps, up to CACHED entries. Pre-tokens are never shuffled and no count depends on what the tables hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, forget, saved, slices, table, text_offsets, tidy

#: Counters of a summary, and entries of the broadcast table at most.
COUNTERS = 4096
#: Summaries merged at a time.
FAN = 16
#: Pre-tokens that a worker remembers beside the table; then it begins anew.
CACHED = 1 << 18
#: Characters that are looked up at a time, about.
PIECE = 1 << 19
#: Characters of a pre-token that is remembered; a longer one is encoded each time.
LONGEST = 48
#: Texts with more tokens are marked.
LIMIT = 4096

_SPACE = "▁"
_CUT = re.compile(f"(?<=[^{_SPACE}\n])[{_SPACE}\n]")
_PRE = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|\n+[^{_SPACE}\n]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(row, piece): texts as the model reads them, a mark before each and for each space, cut into pieces where a pre-token begins."""
    for row, text in enumerate(texts):
        if not text:
            continue
        marked, start = _SPACE + text.replace(" ", _SPACE), 0
        while start < len(marked):
            cut = _CUT.search(marked, start + PIECE)
            end = cut.start() if cut else len(marked)
            yield row, marked[start:end]
            start = end


def pre_tokens(text: str) -> list[str]:
    return [t for _, piece in pieces([text]) for t in _PRE.findall(piece)]


class Encoder:
    """Lengths of pre-tokens as the library gives them."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("this model has pieces that go over the boundaries of pre-tokens")
        feed = self.library.piece_to_id("<0x0A>")
        if self.library.encode("\n a  b\n", num_threads=1)[1] != feed or self.library.normalize(" a  b ").replace(_SPACE, " ") != "  a  b ":
            raise ValueError("this model changes white space or has no bytes")

    def lengths(self, tokens: list[str]) -> list[int]:
        """The library puts a mark before a text, which is the pre-token's own first one; others stand after a line feed, a token that nothing is merged over."""
        own = [len(t) > 1 and t[0] == _SPACE for t in tokens]
        ids = self.library.encode([t[1:] if o else "\n" + t for t, o in zip(tokens, own, strict=True)], num_threads=1)
        return [len(x) if o else len(x) - 2 for x, o in zip(ids, own, strict=True)]


class Lengths(dict):
    """Pre-token to number of tokens: the table's entries stay, what is missing is encoded and kept in a bounded second tier."""

    def __init__(self, encoder: Encoder, frequent: dict[str, int], cached: int = CACHED):
        super().__init__(frequent)
        self.encoder, self.frequent, self.cached, self.misses = encoder, frequent, cached, 0

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        held, size = [], 0
        for row, piece in pieces(texts):
            held.append((row, _PRE.findall(piece)))
            size += len(piece)
            if size >= PIECE:
                self._add(held, out)
                held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        if len(self) > len(self.frequent) + self.cached:
            self.clear()
            self.update(self.frequent)
        missing = list({t for _, tokens in held for t in tokens}.difference(self))
        if missing:
            self.update(zip(missing, self.encoder.lengths(missing), strict=True))
            self.misses += len(missing)
        for row, tokens in held:
            out[row] += sum(map(self.__getitem__, tokens))
        for t in missing:
            if len(t) > LONGEST:
                del self[t]


#: The lengths that this worker knows, of the last table that it has seen.
_KNOWN: dict[str, Lengths] = {}


def _lengths(key: str, model: bytes, tokens: list[str], counts: list[int]) -> Lengths:
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Lengths(Encoder(model), dict(zip(tokens, counts, strict=True)))
    return _KNOWN[key]


def reduced(counts: Counter, keep: int = COUNTERS) -> Counter:
    """At most `keep` counters: if there are more, all lose what the first one that goes has, so that summaries stay mergeable."""
    if len(counts) <= keep:
        return counts
    less = sorted(counts.values(), reverse=True)[keep]
    return Counter({k: v - less for k, v in counts.items() if v > less})


SUMMARY = "part long, tokens array<string>, counts array<long>"


def _row(part: int, counts: Counter) -> pa.RecordBatch:
    items = sorted(counts.items())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([[k for k, _ in items]], pa.list_(pa.string())), pa.array([[v for _, v in items]], pa.list_(pa.int64()))], ["part", "tokens", "counts"])


def summaries(df: DataFrame, keep: int = COUNTERS) -> DataFrame:
    """(part, tokens, counts): for each partition of df (text) one row of its frequent pre-tokens, counted over all its whole texts."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            text = batch.column(0)
            for a, b in slices(text):
                for _, piece in pieces(text.slice(a, b - a).to_pylist()):
                    counts.update([t for t in _PRE.findall(piece) if len(t) <= LONGEST])
                    if len(counts) > 16 * keep:
                        counts = reduced(counts, keep)
        yield _row(TaskContext.get().partitionId(), reduced(counts, keep))

    return df.selectExpr("CAST(text AS STRING) text").mapInArrow(tidy(run), SUMMARY)


def frequent(df: DataFrame, keep: int = COUNTERS) -> list[str]:
    """Frequent pre-tokens of all texts, at most `keep` of them, in the order of their names. Summaries are merged FAN at a time on the executors."""

    def merge(key, rows):
        counts: Counter = Counter()
        for tokens, n in zip(rows["tokens"].to_pylist(), rows["counts"].to_pylist(), strict=True):
            counts.update(dict(zip(tokens, n, strict=True)))
        return pa.Table.from_batches([_row(key[0].as_py(), reduced(counts, keep))])

    now = saved(summaries(df, keep), "summaries")
    while now.count() > 1:
        # parts are numbered from 0 without great gaps, so every round leaves a FANth of them
        new = saved(now.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(merge, SUMMARY), "summaries")
        forget(now)
        now = new
    row = now.first()  # at most `keep` entries
    forget(now)
    return list(row["tokens"]) if row else []


def token_counts(df: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text: tokens as the library counts them, without begin and end.

    df: doc_id, text, other columns ignored. A null text is empty and has 0 tokens; a null doc_id stays null; repeated rows stay, equal
    texts have equal counts; an empty table gives none. Strings of special tokens are ordinary text. over_limit: more than `limit` tokens.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    with open(path or default_path(), "rb") as f:
        model = f.read()
    common = frequent(df)
    encoder = Encoder(model)
    held = spark.sparkContext.broadcast((model, common, encoder.lengths(common)))  # the model and COUNTERS short strings at most
    key = str(held._jbroadcast.id()) + spark.sparkContext.applicationId

    def run(batches):
        lengths = _lengths(key, *held.value)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b in slices(text):
                n_bytes = np.diff(text_offsets(text.slice(a, b - a)))
                n_tokens = lengths.counts(text.slice(a, b - a).to_pylist())
                over = [n > limit for n in n_tokens]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents by piece_bpe_32k.model."""
    return token_counts(table(spark, sf_dir, "documents"))
