"""BPE encoding by a per-prefix table, and decoding.

For every prefix of a word there is one token that its encoding ends with: the longest token that is a suffix of the prefix and
may stand after the last token of what comes before. An automaton over the vocabulary finds the suffixes, a test on the
merges tells whether two tokens may be neighbours, and back-pointers give the ids. The result is exactly that of the merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, slices, table, tidy

#: Pieces of text kept by a worker, twice over, and pairs of tokens: about 50 and 30 MB.
PIECES, PAIRS = 75_000, 200_000
END = "\x00"
#: Characters whose classes, composition and lower case every version of Unicode has alike: Latin, Greek, Cyrillic, punctuation.
PLAIN = [*range(0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(more)) for b in range(256)]


class Encoder:
    """Encodes and decodes with a tokenizer file of words with ends, lower-cased and with white space dropped."""

    def __init__(self, source: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        small = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "pre_tokenizer": split, "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normal, self.split = small.normalizer, small.pre_tokenizer
        self._classes(split["pattern"]["Regex"])
        self.letters = byte_letters()
        vocab = model["vocab"]
        # order of a token: its merge's place, -1 for single letters; halves: what it is merged from
        self.order, self.halves, self.merge = dict.fromkeys(vocab.values(), -1), {}, {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            t = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = k
            self.order[t], self.halves[t] = k, (vocab[a], vocab[b])
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.sizes = [0] * (max(vocab.values()) + 1)
        self.find = ahocorasick.Automaton()
        for text, t in vocab.items():
            self.sizes[t] = len(self.marked(text))
            if self.order[t] >= 0 or len(self.marked(text)) == 1 + text.endswith(self.suffix):
                if self._whole(t):
                    self.find.add_word(self.marked(text), (t, len(self.marked(text))))
        self.find.make_automaton()

    def _classes(self, pattern: str) -> None:
        """The pattern for plain characters, with the library's own classes, and one that finds what is not plain."""
        plain, letters, digits, spaces, known = [], [], [], [], frozenset(map(chr, PLAIN))
        for c in map(chr, PLAIN):
            # Python and the library have to agree on the character's normal form, which has to be plain, too
            form = self.plain_normal(f"a{c}a")
            if self.normal.normalize_str(f"a{c}a") != re.sub(r"[\t-\r \x85\xa0]+", " ", form) or not known.issuperset(form):
                continue
            plain.append(c)
            pieces = [x for x, _ in self.split.pre_tokenize_str(f"a{c}a")]
            if pieces == [f"a{c}a"]:
                letters.append(c)
            elif pieces == ["a", "a"]:
                spaces.append(c)
            elif [x for x, _ in self.split.pre_tokenize_str(c + c)] == [c, c]:
                digits.append(c)
        group = lambda x: "".join(map(re.escape, x))
        p = pattern.replace("[\\p{L}]", f"[{group(letters)}]").replace("[\\p{N}]", f"[{group(digits)}]")
        self.piece = re.compile(p.replace("\\s\\p{L}\\p{N}", group(spaces + letters + digits)))
        self.odd = re.compile(f"[^{group(plain)}]")

    def marked(self, token: str) -> str:
        """The token with the word's end as one letter."""
        return token[: -len(self.suffix)] + END if token.endswith(self.suffix) else token

    def _whole(self, t: int) -> bool:
        """Does a token's own text encode to the token? Only such a token ever occurs."""
        return t not in self.halves or (self.may_meet(*self.halves[t], below=self.order[t]) and all(self._whole(x) for x in self.halves[t]))

    def may_meet(self, a: int, b: int, below: int | None = None) -> bool:
        """Do the merges leave tokens a and b side by side? Undoes their merges, the latest first, on either side of the border.

        below: the border itself is merged by that merge, and by none before it.
        """
        key = a << 32 | b
        if below is None and (known := self.pairs.get(key)) is not None:
            return known
        order, halves, limit, good = self.order, self.halves, float("inf") if below is None else below, True
        while True:
            k = self.merge.get((a, b))
            if k is not None and k < limit:
                good = False
                break
            x, y = order[a], order[b]
            if x < 0 and y < 0:
                break
            if x > y:  # a was the last to be made: a merge over the border had to come before it
                limit, a = min(limit, x), halves[a][1]
            else:  # the left-most of equal merges comes first
                limit, b = min(limit, y + 1), halves[b][0]
        if below is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = good
        return good

    def ids(self, word: str) -> list[int]:
        """Token ids of one piece of text, by its prefixes."""
        if not (word.isascii() and word.isprintable()):
            letters = self.letters
            word = "".join([letters[b] for b in word.encode("utf-8", "surrogatepass")])
        size = len(word) + 1
        last: list[int] = [-1] * (size + 1)
        pairs = self.pairs
        # hits come by where they end, the longest first
        for end, (t, n) in self.find.iter(word + END):
            if last[end + 1] < 0:
                if n <= end:
                    before = last[end + 1 - n]
                    if before < 0:
                        continue
                    good = pairs.get(before << 32 | t)
                    if good is None:
                        good = self.may_meet(before, t)
                    if not good:
                        continue
                last[end + 1] = t
        out, at, sizes = [], size, self.sizes
        while at > 0:
            t = last[at]
            if t < 0:
                raise ValueError(f"no encoding of {word!r}")
            out.append(t)
            at -= sizes[t]
        out.reverse()
        return out

    def word(self, word: str) -> tuple[str, str]:
        """(ids joined by spaces, tokens joined by spaces) of one piece, kept for later; when the table is full, what was not used lately goes."""
        found = self.older.get(word)
        if found is None:
            names, ids = self.names, self.ids(word)
            found = " ".join(map(str, ids)), " ".join([names[i] for i in ids])
        if len(self.known) >= PIECES:
            self.older, self.known = self.known, {}
        self.known[word] = found
        return found

    def plain_normal(self, text: str) -> str:
        """Composed and lower-cased; every capital sigma alike."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text as the library cuts it: by the library itself where a character is not plain."""
        if text.isascii():
            return self.piece.findall(text.lower())
        if self.odd.search(text) is None:
            return self.piece.findall(self.plain_normal(text))
        return [x for x, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]

    def encode(self, text: str) -> list[tuple[str, str]]:
        """(ids, tokens) of the pieces of a whole text; a special token's own text is that token."""
        if self.cut is not None and "<|" in text:
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += self.encode_plain(text[at : m.start()])
                out.append((str(self.special[m[0]]), m[0]))
                at = m.end()
            return out + self.encode_plain(text[at:])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[tuple[str, str]]:
        out = []
        for w in self.pieces(text):
            out.append(self.known.get(w) or self.word(w))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the file names no decoder, so tokens are joined by spaces."""
        return " ".join([self.names[i] for i in ids if i in self.names])


_made: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """One encoder for each file in a worker."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(source)
    return _made[key]


def forgotten() -> None:
    """Empty a worker's tables of pieces; the encoder itself stays for the next partition."""
    for enc in _made.values():
        enc.known, enc.older = {}, {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _texts(df: DataFrame, path: str | None, cols: Callable, schema: str) -> DataFrame:
    """cols(encoded texts) of every whole text, some hundred kB of text at a time."""
    spark = df.sparkSession
    arrow_rows(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())  # the vocabulary's size is fixed
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        enc = encoder(source.value)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for a, b in slices(text):
                own = cols(enc.encode(x or "") for x in text.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *own], names)

    return df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(text AS STRING) text").mapInArrow(tidy(run, forgotten), schema)


def encoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every whole text. Null texts are empty and give no ids; null and repeated doc_ids stay, other columns are ignored."""

    def cols(texts):
        rows = [np.array(" ".join([w[0] for w in words]).split(), np.int32) for words in texts]
        bounds = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows)))]

    return _texts(df, path, cols, "doc_id long, ids array<int>")


def decoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): what the ids column of df decodes to; ids unknown to the vocabulary are skipped, null ids give null."""
    with open(path or default_path(), encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = encoder(source.value)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.selectExpr("CAST(doc_id AS LONG) doc_id", "CAST(ids AS ARRAY<INT>) ids").mapInArrow(tidy(run, forgotten), "doc_id long, text string")


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, in one pass; nulls and repeated rows as in encoded()."""
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def cols(texts):
        n, ids, back = [], [], []
        for words in texts:
            x = " ".join([w[0] for w in words])
            n.append(x.count(" ") + 1 if x else 0)
            ids.append(sha(x))
            back.append(sha(" ".join([w[1] for w in words])))
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

    return _texts(df, path, cols, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of all documents."""
    return digests(table(spark, sf_dir, "documents"))
