"""Repeated lines or paragraphs: keep the earliest ranked occurrence, remove the others, keep the original offsets.

A unit is normalised (A-Z to a-z, runs of white space to one space) and hashed to 128 bits; digests are grouped over all
documents. Occurrences rank by doc_id, then by place in the text.

So that repeated passages go wherever they begin and end in a line, units of `passage` words are treated alike: a window of
that many words that stands earlier, in the same normal form, goes. Runs of half that length, chosen by least hash so that
every window has one, its mark, tell which windows can repeat; only these are grouped.

Both are found in the original text, and what they remove is united.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import WORD, Words, _powers, arrow_rows, forget, fresh, mix, saved, slices, table, tidy

#: Least words of a passage that goes wherever it stands.
PASSAGE = 50
SEPARATOR = {"line": "\n", "paragraph": "\n\n"}
ADDED = ("n_units", "n_lines", "n_passages", "n_removed", "removed")
KEY = ["doc_id", "version"]
_LOWER = {c: c + 32 for c in range(65, 91)}
_SPACES = {c: 32 for c in (9, 10, 11, 12, 13)}
_NORMAL = _LOWER | _SPACES


def normal(unit: str) -> list[str]:
    """Words of a unit, A-Z lowered."""
    return [w for w in unit.translate(_NORMAL).split(" ") if w]


def place() -> F.Column:
    """What occurrences rank by."""
    return F.struct("doc_id", "version", "pos")


def units(texts: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """(doc_id, version, pos, start, end, d1, d2) of each unit of (doc_id, version, text) rows with so many words; offsets are code points."""
    sep = SEPARATOR[unit]
    names = ("doc_id", "version", "pos", "start", "end", "d1", "d2")

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                rows: list[tuple] = []
                for i, v, text in zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in range(3)), strict=True):
                    at = 0
                    for pos, x in enumerate(text.split(sep)):
                        words = normal(x)
                        if len(words) >= max(1, min_words):
                            d = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                            rows.append((i, v, pos, at, at + len(x), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
                        at += len(x) + len(sep)
                cols = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return texts.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def repeated_units(texts: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(doc_id, version, lines): the later occurrences of units as structs (start, end, keeper) in order."""
    found = saved(units(texts, unit, min_words), "units")
    # partial minima are made before the shuffle; a table of its own lets the join split a unit of a great many documents
    first = found.groupBy("d1", "d2").agg(F.min(place()).alias("first"), F.max(place()).alias("last")).where("first <> last").drop("last")
    first = saved(first, "first")
    later = found.join(first, ["d1", "d2"]).where(place() != F.col("first")).select(*KEY, "start", "end", F.col("first.doc_id").alias("keeper"))
    out = saved(later.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end", "keeper"))).alias("lines")), "lines")
    forget(found, first)
    return out


def _runs(words: Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on; those that pass a text's end mean nothing."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hash * power[:n], out=p[1:])
    return mix((p[k:] - p[:-k]) * inverse[: n - k + 1])


def _windows(column, size: int):
    """(words, whether a window of size words begins at each word, where the first of its least shorter runs begins, hashes of the shorter runs)."""
    w = Words(column)
    half = size // 2
    g = _runs(w, half)
    n = len(w.hash) - size + 1
    if n < 1:
        return w, np.zeros(0, bool), np.zeros(0, np.int64), g
    least = np.lib.stride_tricks.sliding_window_view(g, size - half + 1).argmin(axis=1) + np.arange(n)
    return w, w.row[:n] == w.row[size - 1 :], least, g


def _texts(batch):
    """(ids, versions, texts) of a batch in runs of little text."""
    text = batch.column(2)
    for a, b in slices(text):
        yield *(batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (0, 1)), text.slice(a, b - a), (a, b)


def _same(w: Words, whole: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of each run of windows that follow each other and have their mark in the same place.

    Such windows are never equal to each other, and there are size - size // 2 + 1 of them at most.
    """
    at = np.flatnonzero(whole)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
    start = np.flatnonzero(new)
    return at[start], np.diff(np.append(start, len(at)))


def _equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): places ordered by the keys, equal ones by place, and where in that order each new key begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _marks(size: int):
    """Rows (doc_id, version, mark, n): the least hashes of the runs of windows of size words, each once for a text with the number of its runs."""

    def run(batches):
        for batch in batches:
            for ids, versions, text, _ in _texts(batch):
                w, whole, least, g = _windows(text, size)
                if whole.any():
                    at, _ = _same(w, whole, least)
                    row, mark = w.row[at], g[least[at]].view(np.int64)
                    order, new = _equal(row, mark)
                    row, mark, n = row[order][new], mark[order][new], np.diff(np.append(new, len(order)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], versions[row], mark, n)], ["doc_id", "version", "mark", "n"])

    return run


RUN = "doc_id long, version long, pos long, places array<long>, len long, mark long, context long, windows array<long>"


def _found(size: int):
    """Rows RUN of the runs of windows whose mark is among the row's repeated ones; context is a hash of all their words.

    Runs of a text with the same words, which a repeated pair of words has by hundreds, are one row with all their places, of which pos is the first.
    """
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(batches):
        for batch in batches:
            marks = batch.column(3)
            for ids, versions, text, (a, b) in _texts(batch):
                w, whole, least, g = _windows(text, size)
                if not whole.any():
                    continue
                at, n = _same(w, whole, least)
                hot = np.isin(g[least[at]], marks.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                at, n = at[hot], n[hot]
                if not len(at):
                    continue
                power, inverse = _powers(len(w.hash) + 1)
                p = np.append(np.uint64(0), np.cumsum(w.hash * power[: len(w.hash)]))
                context = mix((p[at + n + size - 1] - p[at]) * inverse[at] + n.astype(np.uint64))
                order, new = _equal(w.row[at], g[least[at]], n, context)
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), pa.array((at - w.first[w.row[at]])[order]))
                at, n, context = (x[order[new]] for x in (at, n, context))
                bounds = np.append(0, np.cumsum(n))
                each = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - at, n)
                windows = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_runs(w, size)[each].view(np.int64)))
                cols = (ids[w.row[at]], versions[w.row[at]], at - w.first[w.row[at]], places, n, g[least[at]].view(np.int64), context.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), windows], names)

    return run


def repeated_passages(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, passages): for each text with repeated windows, its runs of windows as structs for _spans().

    Runs of windows with the same words are one class, which its earliest member stands for; the windows of classes alone are
    compared one by one, and only where several classes share a mark. So a passage that a great many documents have costs
    each of them a row for some ten windows, and its windows are compared once; words that repeat within a text cost it no
    more rows than they have different runs.
    """
    kind = ["mark", "len", "context"]
    marks = saved(texts.mapInArrow(tidy(_marks(size)), "doc_id long, version long, mark long, n long"), "marks")
    again = saved(marks.groupBy("mark").agg(F.sum("n").alias("n")).where("n > 1").select("mark"), "again")
    hot = saved(marks.join(again, "mark").groupBy(*KEY).agg(F.collect_set("mark").alias("marks")), "hot")
    forget(marks, again)
    runs = saved(texts.join(hot, KEY).select(*KEY, "text", "marks").mapInArrow(tidy(_found(size)), RUN), "runs")
    forget(hot)
    classes = saved(runs.groupBy(*kind).agg(F.min(F.struct("doc_id", "version", "pos", "windows")).alias("first")), "classes")
    several = saved(classes.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "several")
    each = classes.join(several, "mark").select(*kind, "first.doc_id", "first.version", F.col("first.pos").alias("start"), F.posexplode("first.windows").alias("o", "window"))
    each = each.withColumn("pos", F.col("start") + F.col("o"))
    at = saved(each.groupBy("mark", "window").agg(F.min(place()).alias("at"), F.max(place()).alias("last")).where("at <> last").drop("last"), "first")
    earlier = each.join(at, ["mark", "window"]).where(place() != F.col("at"))
    earlier = saved(earlier.groupBy(*kind).agg(F.collect_list(F.struct(F.col("o").cast("long").alias("o"), "at")).alias("earlier")), "earlier")
    forget(at, several)
    known = classes.select(*kind, F.struct("first.doc_id", "first.version", "first.pos").alias("first")).join(earlier, kind, "left")
    # a table of its own lets the join split a class of a great many members
    known = saved(known, "known")
    later = runs.drop("windows").join(known, kind).withColumn("leads", place() == F.col("first")).where("NOT leads OR earlier IS NOT NULL OR size(places) > 1")
    own = lambda x: (x["doc_id"] == F.col("doc_id")) & (x["version"] == F.col("version"))
    nearer = F.transform("earlier", lambda x: F.struct(x["o"].alias("o"), x["at"]["doc_id"].alias("keeper"), own(x["at"]).alias("own"), x["at"]["pos"].alias("at")))
    run = F.struct("places", "len", "leads", F.col("first.doc_id").alias("keeper"), own(F.col("first")).alias("own"), F.col("first.pos").alias("at"), nearer.alias("earlier"))
    out = saved(later.groupBy(*KEY).agg(F.collect_set(run).alias("passages")), "passages")
    forget(runs, classes, earlier, known)
    return out


def _spans(runs, size: int) -> list[tuple[int, int, int]]:
    """Words [from, to) to remove and the keeper, for each window of the runs that stands earlier, in order; only the first place of a run leads.

    Where a window overlaps its own first occurrence, only what lies after that goes.
    """
    out = []
    for r in runs:
        nearer = {x["o"]: (x["keeper"], x["own"], x["at"]) for x in r["earlier"] or ()}
        for k, pos in enumerate(r["places"]):
            for o in range(r["len"]):
                found = nearer.get(o) or (None if r["leads"] and k == 0 else (r["keeper"], r["own"], r["at"] + o))
                if found:
                    keeper, own, at = found
                    p = pos + o
                    out.append((max(p, at + size) if own else p, p + size, keeper))
    return sorted(set(out))


def _united(spans) -> list[list[int]]:
    """Runs [from, to, keeper] of words that go; a word of several spans counts to the first."""
    runs: list[list[int]] = []
    done = 0
    for a, b, keeper in spans:
        a = max(a, done)
        if b > a:
            if runs and runs[-1][1] == a and runs[-1][2] == keeper:
                runs[-1][1] = b
            else:
                runs.append([a, b, keeper])
            done = b
    return runs


def _cut(text: str, lines, spans, sep: int) -> tuple[str, list[tuple], int]:
    """text without its repeated units and passages, both as (start, end, keeper) in order, and the number of passages."""
    gone, words = [], [m.span() for m in re.finditer(WORD, text)] if spans else []
    passages = [(words[a][0], words[b - 1][1], k) for a, b, k in _united(spans)]
    # a unit goes with the separator after it, those at the end with the one before
    tail = len(text)
    for x in reversed(lines):
        if x["end"] == tail:
            tail = x["start"] - sep
            gone.append((max(0, tail), x["end"]))
        else:
            gone.append((x["start"], x["end"] + sep))
    rest, at = [], 0
    for a, b in sorted(gone + [p[:2] for p in passages]):
        if a > at:
            rest.append(text[at:a])
        at = max(at, b)
    return "".join([*rest, text[at:]]), sorted([(x["start"], x["end"], x["keeper"]) for x in lines] + passages), len(passages)


def remove_repeats(df: DataFrame, unit: str = "line", min_words: int = 1, passage: int = PASSAGE) -> DataFrame:
    """Every row of df with the later occurrences of its repeated units and passages removed; passage 0 looks for units alone.

    df: doc_id, text and any other columns, which pass through unchanged, whatever their names; columns of the names added here
    are replaced. unit: "line" or "paragraph"; units of fewer than min_words words stay.
    Adds n_units (lines or paragraphs of the original), n_lines (units removed), n_passages (passages removed), n_removed (their
    sum) and removed, an array of n_removed structs (start, end, keeper): code points in the original text, and the document that
    keeps the unit or passage; a unit may lie within a passage. A null text stays null and an empty one empty. A row without
    doc_id is left as it is and removes nothing elsewhere. Rows that repeat both doc_id and text count as one document and
    change alike; rows that repeat a doc_id alone rank by a hash of the text. Without rows there is nothing to do.
    """
    arrow_rows(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in ADDED]
    own, sep = fresh(df, "repeats"), SEPARATOR[unit]
    text, ident = df["text"].cast("string"), df["doc_id"].cast("long")
    texts = df.select(ident.alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = repeated_units(texts, unit, min_words)
    if passage:
        passages = repeated_passages(texts, passage)
        drop = saved(lines.join(passages, KEY, "full_outer"), "cuts")
        forget(lines, passages)
    else:
        kind = "array<struct<places: array<bigint>, len: bigint, leads: boolean, keeper: bigint, own: boolean, at: bigint, earlier: array<struct<o: bigint, keeper: bigint, own: boolean, at: bigint>>>>"
        drop = saved(lines.withColumn("passages", F.lit(None).cast(kind)), "cuts")
        forget(lines)
    drop = drop.toDF(*[f"{own}{c}" for c in drop.columns])
    # the text twice: as it is read, and in the place of the column
    rows = df.select(*[text.alias(c) if c.lower() == "text" else df[c] for c in kept], ident.alias(f"{own}doc_id"), F.xxhash64(text).alias(f"{own}version"))
    rows = rows.join(drop, [f"{own}doc_id", f"{own}version"], "left")
    rows = rows.select(*kept, F.coalesce(F.size(F.split("text", sep)).cast("long"), F.lit(0).cast("long")).alias(f"{own}units"), f"{own}lines", f"{own}passages")
    span = StructType([StructField(c, LongType()) for c in ("start", "end", "keeper")])
    schema = StructType([*(f if f.name.lower() != "text" else StructField(f.name, StringType()) for f in rows.schema.fields[: len(kept)]), *(StructField(c, LongType()) for c in ADDED[:4]), StructField("removed", ArrayType(span))])
    at, n, many = [c.lower() for c in kept].index("text"), len(kept), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "keeper")]))

    def run(batches):
        for batch in batches:
            cols, counted, hit = batch.columns[:n], batch.column(n), pc.or_(batch.column(n + 1).is_valid(), batch.column(n + 2).is_valid())
            mask = hit.to_pylist()
            found = []
            for t, x, y in zip(*(c.filter(hit).to_pylist() for c in (cols[at], batch.column(n + 1), batch.column(n + 2))), strict=True):
                rest, out, k = _cut(t, x or [], _spans(y or [], passage), len(sep))
                found.append((rest, [dict(zip(("start", "end", "keeper"), z, strict=True)) for z in out], k))
            it = iter(found)
            every = [next(it) if m else (None, [], 0) for m in mask]
            if found:
                cols[at] = pc.replace_with_mask(cols[at], hit, pa.array([x[0] for x in found], cols[at].type))
            total, few_ = pa.array([len(x[1]) for x in every], pa.int64()), pa.array([x[2] for x in every], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, counted, pc.subtract(total, few_), few_, total, pa.array([x[1] for x in every], many)], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines and passages: doc_id, text, the counts, and removed as start:end:keeper, joined by commas."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["keeper"].cast("string"))), ",")
    return out.select("doc_id", "text", *ADDED[:4], spans.alias("removed"))


OP6_SQL = rf"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
lines AS (SELECT doc_id, UNNEST(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs
), placed AS (
  SELECT doc_id, pos, length(line) AS size, COALESCE(SUM(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS unit FROM lines
), marked AS (
  SELECT *, unit <> '' AND ROW_NUMBER() OVER (PARTITION BY unit ORDER BY doc_id, pos) > 1 AS gone, FIRST_VALUE(doc_id) OVER (PARTITION BY unit ORDER BY doc_id, pos) AS keeper FROM placed
), cut_lines AS (
  SELECT doc_id, start, start + size AS stop, keeper, COALESCE(bool_and(gone) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true) AS tail, gone FROM marked
), pieces AS (SELECT doc_id, UNNEST(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM docs),
spots AS (SELECT *, SUM(length(token)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop FROM pieces),
words AS (
  SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, stop - length(token) AS start, stop, translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
  FROM spots WHERE NOT regexp_full_match(token, '[\x20\x09-\x0D]+')
), texts AS (SELECT doc_id, list(word ORDER BY pos) AS ws FROM words GROUP BY doc_id),
windows AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1:pos + {PASSAGE}], ' ')) AS h FROM (SELECT doc_id, ws, UNNEST(range(0, len(ws) - {PASSAGE - 1})) AS pos FROM texts)),
ranked AS (SELECT doc_id, pos, FIRST_VALUE(doc_id) OVER w AS keeper, FIRST_VALUE(pos) OVER w AS first_pos FROM windows WINDOW w AS (PARTITION BY h ORDER BY doc_id, pos)),
spans AS (
  SELECT DISTINCT doc_id, CASE WHEN keeper = doc_id THEN greatest(pos, first_pos + {PASSAGE}) ELSE pos END AS a, pos + {PASSAGE} AS b, keeper FROM ranked WHERE NOT (keeper = doc_id AND first_pos = pos)
), apart AS (
  SELECT doc_id, greatest(a, COALESCE(MAX(b) OVER (PARTITION BY doc_id ORDER BY a, b, keeper ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a, b, keeper FROM spans
), joined AS (
  SELECT *, SUM(CASE WHEN a = before AND keeper = same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS run
  FROM (SELECT *, LAG(b) OVER w AS before, LAG(keeper) OVER w AS same FROM apart WHERE b > a WINDOW w AS (PARTITION BY doc_id ORDER BY a))
), runs AS (SELECT doc_id, MIN(a) AS a, MAX(b) AS b, MIN(keeper) AS keeper FROM joined GROUP BY doc_id, run),
passages AS (SELECT r.doc_id, x.start, y.stop, r.keeper FROM runs r JOIN words x ON x.doc_id = r.doc_id AND x.pos = r.a JOIN words y ON y.doc_id = r.doc_id AND y.pos = r.b - 1),
listed AS (
  SELECT doc_id, COUNT(*) FILTER (WHERE line) AS n_lines, COUNT(*) FILTER (WHERE NOT line) AS n_passages, string_agg(start || ':' || stop || ':' || keeper, ',' ORDER BY start, stop, keeper) AS removed
  FROM (SELECT doc_id, start, stop, keeper, true AS line FROM cut_lines WHERE gone UNION ALL SELECT doc_id, start, stop, keeper, false FROM passages) GROUP BY doc_id
), cuts AS (
  SELECT doc_id, CASE WHEN tail THEN greatest(start - 1, 0) ELSE start END AS a, CASE WHEN tail THEN stop ELSE stop + 1 END AS b FROM cut_lines WHERE gone UNION ALL SELECT doc_id, start, stop FROM passages
), gaps AS (
  SELECT doc_id, a, COALESCE(MAX(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind FROM cuts
  UNION ALL SELECT d.doc_id, length(text), COALESCE(m.b, 0) FROM docs d LEFT JOIN (SELECT doc_id, MAX(b) AS b FROM cuts GROUP BY doc_id) m USING (doc_id)
), rest AS (SELECT g.doc_id, string_agg(substring(text, CAST(behind + 1 AS BIGINT), CAST(a - behind AS BIGINT)), '' ORDER BY behind) AS kept FROM gaps g JOIN docs USING (doc_id) WHERE a > behind GROUP BY g.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.doc_id IS NULL THEN d.text ELSE COALESCE(r.kept, '') END AS text, COALESCE(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_units,
  COALESCE(n_lines, 0) AS n_lines, COALESCE(n_passages, 0) AS n_passages, COALESCE(n_lines + n_passages, 0) AS n_removed, COALESCE(removed, '') AS removed
FROM documents d LEFT JOIN rest r USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""
