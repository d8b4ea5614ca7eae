"""The training-data operators on small tables: brute force, round trips, edge cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from progdf.llm import audio, bpe, common, graph, html, language, licences, minhash, mixing, neighbours, quality, substring

random.seed(4)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 6))) for _ in range(400)]


def prose(n, rng=random):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, extra=True):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double")


@pytest.fixture(scope="module")
def edge_docs(spark):
    return docs(spark, [None, "", " \t\n", "one", "one", prose(3000), "Ärger\x00 <|endoftext|> 漢字", "A\nB\nA", prose(40)])


def empty(df):
    return df.where("false")


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append(frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng, texts = random.Random(1), []
    for _ in range(12):
        base = prose(60, rng).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += ["", None, "a", "A", "a b", "b a"]
    want, sizes = brute_components(texts, 2, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), 2, 80).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_near_duplicates_of_odd_tables(spark, edge_docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(edge_docs).collect()}
    assert len(got) == 9 and got[4].component_id == 3 and got[0].kept and got[1].kept
    assert minhash.near_duplicates(empty(edge_docs)).count() == 0
    twice = edge_docs.unionByName(edge_docs)
    assert minhash.one_of_each(twice).count() == 8


def test_rows_that_repeat_an_id_are_decided_each(spark):
    a, b, c = prose(40), prose(40), prose(40)
    d = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (6, c, 5), (6, c + " x", 6), (None, a, 7), (None, a, 8)], "doc_id long, text string, gone long")
    got = sorted((r.doc_id or 0, r.text) for r in minhash.one_of_each(d).collect())
    assert got == sorted([(0, a), (0, a), (3, a), (5, b), (6, c), (6, c + " x")]) and minhash.one_of_each(d).columns == d.columns
    assert minhash.one_of_each(d.where("false")).count() == 0


def test_estimates_are_near_the_similarity():
    a, b = set(range(1000)), set(range(200, 1200))
    h = lambda s: np.sort(common.mix(np.array(sorted(s), np.uint64)))
    r = [minhash.registers(minhash.minima(h(s), np.array([0, len(s)]), 2000))[0] for s in (a, b)]
    est = minhash.likely(*[np.array([f(r[0], r[1]).sum()]) for f in (np.equal, np.greater, np.less)], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(est - 800 / 1200) < 0.05


def test_components_after_further_links_are_those_of_all_links(spark):
    rng = random.Random(11)
    first, more = ([(rng.randrange(300), rng.randrange(300)) for _ in range(n)] for n in (90, 60))
    of = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    got = sorted(map(tuple, graph.merged(graph.components(of(first)), of(more)).collect()))
    assert got == sorted(map(tuple, graph.components(of(first + more)).collect()))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_sorted_rows_are_cut_into_whole_groups(size):
    rng = random.Random(size)
    rows = sorted((rng.choice([1, 2, 5]), rng.randrange(4), i) for i in range(40)) + [(9, 0, i) for i in range(40, 60)]
    batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in x], "block": [r[1] for r in x], "at": [r[2] for r in x]}) for x in (rows[i : i + size] for i in range(0, len(rows), size))]
    parts = list(minhash._whole(iter(batches), ["key", "block"]))
    assert [tuple(r.values()) for t in parts for r in t.to_pylist()] == rows
    seen = [{(r["key"], r["block"]) for r in t.to_pylist()} for t in parts]
    assert sum(map(len, seen)) == len(set().union(*seen))
    assert sum(len(minhash._starts(t, ["key", "block"])) for t in parts) == len({r[:2] for r in rows})


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 60), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got[30] == 0 and got[60] == 40 and set(got.values()) == {0, 40}


def test_quality_separates_and_takes_odd_rows(spark, edge_docs):
    rng = random.Random(2)
    good = [prose(80, rng) + "." for _ in range(150)]
    bad = [" | ".join(prose(40, rng).split()) for _ in range(150)]
    texts = [x for p in zip(good, bad, strict=True) for x in p]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    out = [r for r in quality.quality_scores(d, labels).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.predicted == 1) == (r.doc_id % 2 == 0) for r in out]) > 0.95
    again = quality.quality_scores(edge_docs, labels).collect()
    assert len(again) == 9 and all(0 <= r.score <= 1 for r in again)
    assert quality.quality_scores(empty(edge_docs), empty(labels)).count() == 0
    assert {r.score for r in quality.quality_scores(edge_docs, empty(labels)).collect()} == {0.5}


def test_quality_scores_are_sums_of_tables(spark):
    rng = random.Random(7)
    texts = [prose(rng.randint(1, 90), rng) + rng.choice(["", ".", " | x #"]) for _ in range(200)]
    d = docs(spark, texts)
    model = quality.train(d, spark.createDataFrame([(i, int("|" not in t)) for i, t in enumerate(texts)], "doc_id long, quality int"))
    x = quality.features(pa.array(texts))
    got = {r.doc_id: r.score for r in quality.scored(d.withColumn("predicted", F.lit("old")), model).collect()}
    for i in range(200):
        at = lambda edges, k: sum(e <= x[i, k] for e in edges[k])  # noqa: B023, E731
        raw = model.start + sum(t[at(model.edges, k)] for k, t in enumerate(model.tables)) + sum(t[at(model.pair_edges, j), at(model.pair_edges, k)] for (j, k), t in model.pairs)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-raw)))
    assert len(set(got.values())) > 3


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert np.mean((m.score(x[3000:]) > 0.5) == y[3000:]) > 0.9


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:130] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(float)
    n = np.linalg.norm(y, axis=1)
    hits = 0
    for q, found in got.items():
        s = y @ y[q] / n / n[q]
        s[q] = -2
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(600), -s.round(12)))[:5].tolist()))
    assert len(got) == 12 and hits >= 0.9 * 60
    assert [v for v, _ in got[0]] == [100, 101, 102, 103, 104]
    assert neighbours.nearest(empty(df), empty(df)).count() == 0


def test_neighbours_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 9), (1, [0.0, 1.0], 9), (2, [1.0, 0.0], 9), (2, [1.0, 0.0], 9), (3, [1.0, 1.0], 9), (None, [1.0, 2.0], 9), (4, [1.0, None], 9), (5, [float("inf"), 1.0], 9), (6, [2.0, 0.0], 9)], "vec_id long, embedding array<double>, score long")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest(df, df.where("vec_id IN (1, 2)")).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 2] == [(2, 1, 1), (2, 2, 6), (2, 3, 3)] and [g[3] for g in got if g[0] == 2] == [1.0, 1.0, round(0.5**0.5, 9)]
    assert [g[2] for g in got if g[0] == 1][:2] in ([2, 6], [3, 2]) and len([g for g in got if g[0] == 1]) == 3


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(3)
    for n in (2, 5, 7, 30):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 4)))], "vec_id long, embedding array<double>")
        assert neighbours.nearest(df, df.where("vec_id = 0"), parts=8).count() == min(5, n - 1)


def test_mulaw_and_alaw_tables():
    m, a = audio.mulaw_table(), audio.alaw_table()
    assert m[0xFF] == 0 and m[0x80] == 32124 and m[0x00] == -32124 and a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256
    assert sorted(set(m.tolist())) == sorted(set((-m).tolist())) and len(set(a.tolist())) == 256


def test_adpcm_blocks_are_those_of_a_scalar_decoder():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5 * 32, dtype=np.uint8)
    data.reshape(5, 32)[:, 2] %= 89
    want = []
    for b in data.reshape(5, 32):
        v, i = int.from_bytes(bytes(b[:2]), "little", signed=True), int(b[2])
        want.append(v)
        for n in [x for byte in b[4:] for x in (byte & 15, byte >> 4)]:
            step = int(audio.IMA_STEPS[i])
            d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            v = max(-32768, min(32767, v - d if n & 8 else v + d))
            i = max(0, min(88, i + int(audio.IMA_MOVES[n & 7])))
            want.append(v)
    assert audio.ima_decode(data.tobytes(), 32).tolist() == want
    assert audio.pcm(audio.wav(data.tobytes(), audio.IMA, bits=4, block=32))[1].tolist() == want


def scalar_pcm(codec, data):
    """PCM of a payload, sample by sample."""
    if codec == audio.MULAW:
        return [(-1 if ~c & 128 else 1) * ((((~c & 15) << 3) + 132 << (~c >> 4 & 7)) - 132) for c in data]
    if codec == audio.ALAW:
        out = []
        for c in data:
            c ^= 0x55
            e, m = c >> 4 & 7, (c & 15) << 4
            v = m + 8 if e == 0 else (m + 264) << (e - 1)
            out.append(v if c & 128 else -v)
        return out
    out = []
    for k in range(0, len(data), audio.IMA_BLOCK):
        out += audio.ima_decode(data[k : k + audio.IMA_BLOCK], audio.IMA_BLOCK).tolist()
    return out


def scalar_doubled(x):
    """Twice the rate: sums over the taps, sample by sample."""
    at = lambda i: x[min(max(i, 0), len(x) - 1)]
    half, out = audio.TAPS // 2 - 1, []
    for i in range(len(x)):
        for taps in audio.phases(2, 1):
            y = sum(int(t) * at(i + k - half) for k, t in enumerate(taps))
            out.append(max(-32768, min(32767, (y + audio.SCALE // 2) // audio.SCALE)))
    return out


def test_audio_round_trip(spark, edge_docs):
    d = docs(spark, [None, "", " \t\n", "one", "one", prose(300), "Ärger\x00 <|endoftext|> 漢字", prose(150), prose(200), prose(90)])
    codecs, by_text = set(), {}
    for r in audio.described(d.unionByName(d)).join(d, "doc_id").collect():
        raw = (r.text or "").encode()
        whole = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        codec = (audio.MULAW, audio.ALAW, audio.IMA)[zlib.crc32(whole) % 3]
        media = audio.wav(whole, codec, bits=4, block=audio.IMA_BLOCK) if codec == audio.IMA else audio.wav(whole, codec)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        x = scalar_doubled(scalar_pcm(codec, whole))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        want = f"{codec}:{len(x)}:{sum(v * v for v in x) // len(x)}:{crossings}:{max(map(abs, x))}:{zlib.crc32(np.array(x, '<i2').tobytes()):08x}"
        assert r.feature == want and by_text.setdefault(r.text or "", r.feature) == r.feature
        codecs.add(codec)
    assert codecs == {audio.MULAW, audio.ALAW, audio.IMA}
    assert audio.described(edge_docs.unionByName(edge_docs)).count() == 18
    bad = spark.createDataFrame([(1, b"junk"), (2, None), (3, audio.wav(b"\x80" * 8, audio.ALAW)), (4, audio.wav(b"\x01" * 200, audio.IMA, bits=4, block=96)), (None, audio.wav(b"", audio.PCM))], "doc_id long, media binary")
    got = {r.doc_id: r for r in audio.decoded(bad).collect()}
    assert got[1].error and got[2].pcm is None and got[2].error is None and len(got[3].pcm) == 32 and got[4].error is None and got[None].pcm == b""
    assert audio.described(empty(edge_docs)).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(4000)
    for rate, to in ((8000, 16000), (8000, 44100), (16000, 8000), (11025, 8000)):
        y = audio.resample(np.rint(9000 * np.sin(2 * np.pi * 440 * t / rate)).astype(np.int16), rate, to)
        want = 9000 * np.sin(2 * np.pi * 440 * np.arange(len(y)) / to)
        assert len(y) == 4000 * to // rate and np.abs(y - want)[100:-100].max() < 150


def test_language_of_held_out_documents(spark, edge_docs):
    rng = random.Random(5)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))
    rows = [(i, say("aeiouklm" if i % 2 else "zxcvbnie", 30), "uk" if i % 2 else "zx") for i in range(300)] + [(900, None, "uk"), (901, "12 ...", "zx"), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.languages(d).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id < 300]
    assert np.mean([r.lang_pred == ("uk" if r.doc_id % 2 else "zx") for r in held]) > 0.95
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert language.languages(empty(d)).count() == 0
    odd = edge_docs.withColumns({"lang_pred": F.lit("x"), "held_out": F.lit(1)})
    rows = language.languages(odd.unionByName(odd), model=language.train(d)).collect()
    assert len(rows) == 18 and all(r.lang_pred in ("uk", "zx", "und") and 0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert len({(r.doc_id, r.lang_pred, r.score) for r in rows}) == 9 and {r.lang_pred for r in language.languages(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_backward_is_that_of_the_whole_text():
    rng = np.random.default_rng(0)
    scores, first, t = rng.normal(size=(400, 3)).astype(np.float32), np.array([0, 0, 3, 203, 400]), np.exp(rng.normal(size=(3, 3))).astype(np.float32)
    p = language.probabilities(scores, first, t)
    for a, b in ((0, 3), (3, 203), (203, 400)):
        e = np.exp(scores[a:b].astype(float))
        fwd, back = [np.full(3, 1 / 3) @ t * e[0]], [np.ones(3)]
        for s in range(1, b - a):
            fwd.append(fwd[-1] @ t * e[s] / fwd[-1].sum())
        for s in range(b - a - 1, 0, -1):
            x = t @ (e[s] * back[0])
            back.insert(0, x / x.sum())
        g = np.array(fwd) * np.array(back)
        assert np.abs(g / g.sum(1, keepdims=True) - p[a:b]).max() < 1e-4


def test_repeated_lines(spark, edge_docs):
    line = prose(25)
    d = docs(spark, [line + "\nown one", "head\n" + line.upper().replace(" ", "  ") + "\ntail", line + "\n" + line, None, ""])
    got = {r.doc_id: r for r in substring.remove_repeats(d).collect()}
    assert got[0].text == line + "\nown one" and got[1].text == "head\ntail" and got[2].text == "" and got[2].n_removed == 2
    x = got[1].removed[0]
    assert (x.keeper, ("head\n" + line.upper().replace(" ", "  ") + "\ntail")[x.start : x.end]) == (0, line.upper().replace(" ", "  "))
    assert got[3].text is None and got[4].text == "" and got[0].component_id == "x"
    assert [r.doc_id for r in substring.remove_repeats(edge_docs.unionByName(edge_docs)).where("n_removed > 0").orderBy("doc_id").collect()] == [4, 4, 7, 7]
    assert substring.remove_repeats(empty(edge_docs)).count() == 0


def test_short_lines_go_as_well(spark):
    own = [prose(30) for _ in range(4)]
    d = docs(spark, [f"Share This  page\n{x}" if i % 2 else f"{x}\nshare this page\n\n" for i, x in enumerate(own)] + ["of two\n" + prose(30), prose(30) + "\nof two"])
    got = {r.doc_id: r for r in substring.remove_repeats(d).collect()}
    assert got[0].text == own[0] + "\nshare this page\n\n" and [got[i].text for i in (1, 2, 3)] == [own[1], own[2] + "\n\n", own[3]]
    assert got[3].removed[0].keeper == 0 and (got[4].n_lines, got[5].n_lines) == (0, 1) and "of two" not in got[5].text
    few = {r.doc_id: r.n_lines for r in substring.remove_repeats(d, min_words=3, passage=0).collect()}
    assert few == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


def test_repeated_paragraphs(spark):
    a, b = prose(9), prose(9)
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, [f"{a}\n{b}\n\n{b}\n\n\n\nx", f"y\n\n{a}\n{b}\n\n{b}"]), unit="paragraph").collect()}
    assert got[0].n_removed == 0 and got[0].n_units == 4 and got[1].text == "y" and got[1].n_lines == 2


def test_passages_within_lines_go(spark):
    rng = random.Random(8)
    shared, a, b = prose(70, rng), prose(60, rng), prose(30, rng)
    short = "\n".join(prose(6, rng) for _ in range(12))
    line = prose(25, rng)
    texts = [f"{line}\n{a} {shared} {b}", f"ä {line}\n{line}\n{b} x {shared.upper()} end", f"{a[::-1]}\n{short}\nown", f"head\nA{short}\ntail", "w " * 120, prose(49, rng) + " y"]
    texts += [texts[5][:-1] + "z", texts[5][:-2]]
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, texts)).collect()}
    assert [got[i].n_removed for i in (0, 2, 5, 6, 7)] == [0] * 5
    assert re.sub(" +", " ", got[1].text) == f"ä {line}\n{b} x end" and got[4].text.split() == ["w"] * 50
    assert [(x.keeper, texts[1][x.start : x.end]) for x in got[1].removed] == [(0, line), (0, shared.upper())] and (got[1].n_lines, got[1].n_passages) == (1, 1)
    first = short.split()[0]
    assert (got[3].n_lines, got[3].n_passages) == (11, 1) and got[3].text == f"head\nA{first} \ntail".replace(" \n", got[3].text[len(f"head\nA{first}") : -4])


def brute_repeats(texts, size):
    """Every window and line against all before it."""
    words = [[(m[0].translate({c: c + 32 for c in range(65, 91)}), *m.span()) for m in re.finditer(common.WORD, t)] for t in texts]
    seen, lines, out = {}, {}, []
    for d, w in enumerate(words):
        for p in range(len(w) - size + 1):
            seen.setdefault(tuple(x[0] for x in w[p : p + size]), (d, p))
    for d, t in enumerate(texts):
        gone, at, cut = set(), 0, set()
        for k, x in enumerate(t.split("\n")):
            unit = " ".join(y[0] for y in words[d] if at <= y[1] < at + len(x))
            if unit and lines.setdefault(unit, (d, k)) != (d, k):
                gone.add(k)
            at += len(x) + 1
        w = words[d]
        hit = set()
        for p in range(len(w) - size + 1):
            fd, fp = seen[tuple(x[0] for x in w[p : p + size])]
            if (fd, fp) != (d, p):
                hit |= set(range(max(p, fp + size) if fd == d else p, p + size))
        # what stays, by words: those that neither a line nor a window takes
        starts = np.cumsum([0] + [len(x) + 1 for x in t.split("\n")])
        cut = {i for i, x in enumerate(w) if int(np.searchsorted(starts, x[1], side="right")) - 1 in gone}
        out.append([x[0] for i, x in enumerate(w) if i not in hit | cut])
    return out


def test_repeats_are_those_of_all_pairs(spark):
    rng, size = random.Random(4), 8
    pool = [prose(rng.randint(3, 30), rng) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(pool).split() if rng.random() < 0.6 else prose(rng.randint(1, 20), rng).split()
            parts.append(" ".join(x[rng.randint(0, 3) :]) + rng.choice(["\n", " ", "  ", "\n\n"]))
        texts.append("".join(parts))
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, texts), passage=size).collect()}
    low = {c: c + 32 for c in range(65, 91)}
    assert [re.findall(common.WORD, got[i].text.translate(low)) for i in range(60)] == brute_repeats(texts, size)
    for i, t in enumerate(texts):  # offsets tell what went
        keep = np.ones(len(t), bool)
        for x in got[i].removed:
            keep[x.start : x.end] = False
            assert x.keeper <= i
        assert re.findall(common.WORD, "".join(c if k else " " for c, k in zip(t, keep, strict=True))) == re.findall(common.WORD, got[i].text)
        assert got[i].n_removed == len(got[i].removed) == got[i].n_lines + got[i].n_passages


def test_repeats_of_odd_tables(spark):
    line = prose(5)
    d = spark.createDataFrame([(None, line, 1, 2), (1, line, 3, 4), (1, line, 3, 4), (1, line + "\nx", 5, 6), (2, None, 7, 8), (3, "", 9, 9)], "doc_id long, text string, _gone long, version long")
    out = substring.remove_repeats(d)
    assert out.columns[:4] == d.columns
    rows = sorted((r.doc_id or 0, r.text or "-", r._gone, r.version, r.n_removed) for r in out.collect())
    one = [r for r in rows if r[0] == 1]
    assert rows[0] == (0, line, 1, 2, 0) and rows[-2:] == [(2, "-", 7, 8, 0), (3, "-", 9, 9, 0)] and len(one) == 3
    # the two texts of one id rank by their hashes: the line stays in one of them
    assert sorted({(r[1], r[4]) for r in one}) in ([("-", 1), (line + "\nx", 0)], sorted([(line, 0), ("x", 1)]))


PAGE = "<html><body><header>Site</header><nav><a href=x>a</a></nav><div class='cookie-notice'>We use cookies here</div><div id=content><h1>Title</h1><p>First &amp; long para of text\n here.</p><p>Second para <a href=x>link</a> with text.</p></div><aside>side text</aside><section id=comments><p>I like this very much</p></section><footer>foot</footer></body></html>"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<", ""), ("plain", "plain"), ("<p>a &lt; b", "a < b"), (PAGE, "Title\nFirst & long para of text here.\nSecond para link with text."),
    ("<article><h1>T</h1><p><b>one<br><p>two</p><script>x('</p>')</script></article><footer>f", "T\none\ntwo"), ("<div>" * 4000 + "deep", "deep"),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


PARAS = ["A first paragraph of some length, with <a href=x>a link</a> in it.", "Ok.", "Another one that is rather longer than the first, so that its density is high, as prose has it."]
BODY = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in PARAS)
TEXT = "\n".join(["Title", *(re.sub("<[^>]*>", "", x) for x in PARAS)])
MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul>"


@pytest.mark.parametrize("page", [
    f"<div class='page has-sidebar'><article>{BODY}</article></div>",
    f"<div id='search-content'><main>{BODY}</main></div><div class=sidebar><p>Some words beside it</p></div>",
    f"<form id=aspnetForm><div>{MENU}</div><div class=story>{BODY}</div></form><footer>foot</footer>",
    f"<nav>{MENU}</nav><div id=wrap><div class=social-page>{BODY}</div></div>",
    f"<body>{MENU}<div>{BODY}</div><div class='cookie-notice'><p>We use cookies to make this better for you and for us.</p></div>",
    f"<main><article>{BODY}</article></main><section class=comments><article class=comment><p>I like this</p></article><article><p>So do I, much more than anybody else here</p></article></section>",
    f"<header><h1>Site</h1>{MENU}</header><article><header>{BODY[:14]}</header>{BODY[14:]}<footer>By me</footer></article><aside><article><p>Read this as well</p></article></aside>",
    f"<table><tr><td>{MENU}<td>{BODY}</table>",
    f"<article>{BODY}<div class=AdSlot>Buy now</div><div hidden>x</div></article><p>Stray words outside</p>",
    f"<!--><div class='ad'>x</div>--><article>{BODY.replace('</p>', '')}</article>",
])
def test_main_text_of_layouts(page):
    assert html.main_text(page).removeprefix("-->\n") == TEXT


def test_densities_are_those_of_the_definition():
    rng = random.Random(2)

    def build(depth):
        if not depth or rng.random() < 0.2:
            return prose(rng.randint(1, 30), rng)
        return "".join(f"<{(t := rng.choice(['div', 'div', 'section', 'a', 'ul', 'em']))}{rng.choice(['', ' class=menu'])}>{build(depth - 1)}</{t}>" for _ in range(rng.randint(1, 4))) + prose(rng.randint(0, 5), rng)

    def counts(n):
        c = t = lc = lt = 0
        for x in n.parts:
            if isinstance(x, str):
                c += len(" ".join(x.split()))
            else:
                a = counts(x)
                c, t, lc, lt = c + a[0], t + 1 + a[1], lc + a[2], lt + a[3] + (x.name == "a" or x.foreign)
        return (c, t, c, t) if n.foreign else (c, t, c if n.name == "a" else lc, lt)

    def density(c, t, lc, lt, share):
        if c <= lc:
            return 0
        base = np.log(c / (c - lc) * lc + share * c + np.e)
        return c / max(1, t) * np.log(c / max(1, lc) * max(1, t) / max(1, lt)) / np.log(base + 1)

    for _ in range(60):
        nodes = html.measure(html.parse(f"<body>{build(4)}</body>"))
        whole = counts(nodes[0])
        share, sums = whole[2] / max(1, whole[0]), []
        for n in nodes:
            assert n.density == pytest.approx(density(*counts(n), share))
            own = [(len(" ".join(x.split())), 0, 0, 0) if isinstance(x, str) else counts(x) for x in n.parts if not (isinstance(x, str) and (n.foreign or n.name == "a"))]
            sums.append(sum(density(*x, share) for x in own))
        best, low = html.main_node(nodes)
        assert best.total == pytest.approx(max(sums)) and (low == 0 or low == min(x.density for x in [best, *above(best)]))


def above(n):
    while (n := n.parent) is not None:
        yield n


@pytest.mark.parametrize("page", ['<a "' * 100_000, "<b>" * 60_000 + "</i>" * 60_000, "<b>" * 9000 + "<li>x" * 20_000, "<" * 500_000, "<!--" * 100_000, "<div class=ad>" * 30_000 + "x", "<article>" * 30_000 + "x", "<span>" * 4000 + "<p>a</p>" * 20_000, "<a " + "= " * 100_000 + '"x'])
def test_hostile_pages_take_linear_time(page):
    t = time.process_time()
    html.main_text(page)
    assert time.process_time() - t < 5


def test_main_texts_keeps_other_columns(spark):
    d = spark.createDataFrame([(1, "u", "<p>x y", "old", "t"), (1, "u", "<p>x y", "old", "t"), (1, None, None, None, None)], "page_id long, url string, html string, text string, _text string")
    out = html.main_texts(d)
    assert out.columns == ["page_id", "url", "html", "_text", "text", "n_chars"]
    assert sorted((r.text, r.n_chars, r._text or "", r.html or "") for r in out.collect()) == [("", 0, "", ""), ("x y", 3, "t", "<p>x y"), ("x y", 3, "t", "<p>x y")]
    assert html.main_texts(empty(d)).count() == 0 and html.main_texts(d, "_text").where("text = 't'").count() == 2


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_is_that_of_the_library(reference_tokenizer):
    with open(bpe.default_path(), encoding="utf-8") as f:
        enc = bpe.Encoder(f.read())
    rng = random.Random(3)
    texts = ["", " \n", "Hello WORLD's it's 123 ...!!! <|endoftext|> Ab<|startoftext|>c", "ΑΣ ΟΔΟΣ İstanbul ß ﬁ é 漢字 😀", "a" * 3000, "thethethe" * 50, "a\x1cb\x00c"]
    names = [n.replace("</w>", "") for n in enc.names.values()]
    texts += ["".join(rng.choice(names) for _ in range(5)) for _ in range(2000)]
    for t in texts:
        want = reference_tokenizer.encode(t, add_special_tokens=False).ids
        got = [int(i) for w in enc.encode(t) for i in w[0].split()]
        assert got == want and enc.decode(got) == reference_tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_of_every_character(reference_tokenizer):
    """Each code point alone, between letters, twice, beside a digit and a sign."""
    with open(bpe.default_path(), encoding="utf-8") as f:
        enc = bpe.Encoder(f.read())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    near = [c for c in chars if ord(c) < 0x3000]
    texts = [f"{c} a{c}B {c}{c}1{c}!{c}" for c in near] + ["".join(f"{c} a{c}B {c}1{c}!{c} " for c in chars[a : a + 64]) for a in range(0, len(chars), 64)]
    for t, want in zip(texts, reference_tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [int(i) for w in enc.encode(t) for i in w[0].split()] == want.ids, t


def test_bpe_columns(spark, edge_docs, reference_tokenizer):
    ids = bpe.encoded(edge_docs)
    assert {r.doc_id: r.ids for r in ids.collect()} == {r.doc_id: reference_tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in edge_docs.collect()}
    back = {r.doc_id: r.text for r in bpe.decoded(ids).collect()}
    assert all(back[r.doc_id] == reference_tokenizer.decode(reference_tokenizer.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in edge_docs.collect())
    assert bpe.digests(empty(edge_docs)).count() == 0


def test_mix_meets_targets(spark, edge_docs):
    rng = random.Random(6)
    d = docs(spark, [prose(rng.randint(1, 60), rng) for _ in range(600)])
    out = mixing.mix_sources(d).collect()
    assert sum(r.target for r in {r.source: r for r in out}.values()) == pytest.approx(1.5 * sum(r.size for r in out))
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.01 * own[0].target + 60 and all(0 <= r.copies <= 2 for r in own)
        assert own[0].target <= 2 * own[0].source_size
        # the rates meet the constraint themselves, and those below the most are tilted by one lambda
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target)
        tilt = [np.log(r.rate) / r.size for r in own if 0 < r.rate < 2 and r.size]
        assert np.ptp(tilt) < 1e-9 if tilt else own[0].target == 2 * own[0].source_size
        assert all(np.floor(r.rate) <= r.copies <= np.ceil(r.rate) for r in own)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix_sources(d).collect()) == sorted((r.doc_id, r.copies) for r in out)
    assert mixing.mix_sources(edge_docs.unionByName(edge_docs)).count() == 18 and mixing.mix_sources(empty(edge_docs)).count() == 0


def test_mix_rates_are_those_of_least_entropy():
    """No feasible change of the rates has less relative entropy."""
    rng = np.random.default_rng(1)
    size, most = rng.integers(1, 400, 300).astype(float), 2.0
    for target in (0.3 * size.sum(), 1.4 * size.sum(), 1.97 * size.sum()):
        lo, hi = -5.0, 5.0
        for _ in range(200):
            x = (lo + hi) / 2
            lo, hi = (lo, x) if (np.minimum(most, np.exp(np.minimum(x * size, 50))) * size).sum() > target else (x, hi)
        r = np.minimum(most, np.exp(x * size))
        entropy = lambda r: (r * np.log(np.maximum(r, 1e-300)) - r + 1).sum()
        for _ in range(200):
            d = rng.normal(size=300) * 1e-3
            d[(r >= most) & (d > 0)] *= -1
            d -= (r < most) * size * (d @ size) / ((r < most) * size @ size)
            new = r + d
            if (new >= 0).all() and (new <= most).all():
                assert entropy(new) >= entropy(r) - 1e-9


def test_mix_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(i, "a b c " * (i + 1), "s" + str(i % 2), i, 2 * i, 3 * i, 4 * i, 5 * i, 6 * i) for i in range(20)], "doc_id long, text string, source string, mean long, whole long, rest long, key long, x long, part long")
    out = mixing.mix_sources(d.withColumn("rate", F.lit("old")))
    assert out.columns[:9] == d.columns and all((r.mean, r.whole, r.rest, r.key, r.x, r.part) == tuple(r.doc_id * k for k in range(1, 7)) for r in out.collect())


def test_licences(spark, edge_docs):
    d = docs(spark, ["x y z w v u t s\nLicensed under the Apache License, Version 2.0.", "LICENSED under the apache license version 2 0", prose(30), None, licences.TEMPLATES["MIT"].replace(". ", ".\n")])
    got = {r.doc_id: [(m.line, m.licence) for m in r.licences] for r in licences.licence_scan(d).collect()}
    assert got[0] == [(2, "Apache-2.0 (reference)")] and got[1] == [(1, "Apache-2.0 (reference)")] and got[2] == [] and got[3] == [] and (0, "MIT") in got[4]
    assert licences.licence_scan(edge_docs).count() == 9 and licences.licence_scan(empty(edge_docs)).count() == 0


def test_licences_of_repeated_rows_and_null_ids(spark):
    t = "Licensed under CC BY-NC 4.0."
    d = spark.createDataFrame([(None, t, 1), (7, t, 2), (7, t, 3), (7, None, 4)], "doc_id long, text string, licences long")
    got = sorted((r.doc_id or 0, sorted(m.licence for m in r.licences)) for r in licences.licence_scan(d).collect())
    assert len(got) == 4 and got[0][0] == 0 and [g for g in got if g[0] == 7].count((7, ["CC-BY-NC-4.0 (short)"])) == 3 and got[0][1] == []


def test_licences_of_common_families(spark):
    lines = ["Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."]
    lines += [licences.TEMPLATES[k] for k in ("BSD-2-Clause", "BSD-3-Clause", "LGPL-3.0 (header)", "AGPL-3.0 (header)", "Apache-2.0")]
    want = ["CC-BY-NC-4.0 (short)", "CC-BY-4.0 (short)", "CC-BY-NC-ND-4.0 (reference)", "BSD-2-Clause", "BSD-3-Clause", "LGPL-3.0 (header)", "AGPL-3.0 (header)", "Apache-2.0"]
    best = {r.doc_id: max((m.dice, m.licence) for m in r.licences) for r in licences.licence_scan(docs(spark, lines)).collect()}
    assert best == {i: (100, k) for i, k in enumerate(want)}


def test_licences_over_lines_and_within_lines(spark):
    t = licences.TEMPLATES
    wrapped = lambda k, n, mark="": "\n".join(mark + " ".join(t[k].split()[i : i + n]) for i in range(0, len(t[k].split()), n))
    rng = random.Random(5)
    texts = [f"{prose(30, rng)}\n\n{wrapped('MIT', 9)}\n\n{prose(40, rng)}", f"{prose(20, rng)}\n{prose(20, rng)}\n{wrapped('Apache-2.0 (header)', 7, '# ')}\nimport x {prose(50, rng)}", prose(60, rng) + " Licensed under CC BY-NC 4.0. " + prose(60, rng)]
    texts += [prose(9, rng) + "\nLicensed under CC BY-NC 4.0.\nx", f"{prose(9, rng)}\n{wrapped('ISC', 8)}\n{prose(99, rng)}\n{wrapped('ISC', 12)}\nz z z z", prose(20, rng) + " permission is hereby granted free of charge " + prose(90, rng)]
    got = {r.doc_id: [(m.line, m.licence, m.dice) for m in r.licences] for r in licences.licence_scan(docs(spark, texts)).collect()}
    assert got[0] == [(3, "MIT", 100)] and (3, "Apache-2.0 (header)", 100) in got[1] and got[2] == [(1, "CC-BY-NC-4.0 (short)", 100)]
    again = texts[4].split("\n").index(wrapped("ISC", 12).split("\n")[0]) + 1
    assert got[3] == [(2, "CC-BY-NC-4.0 (short)", 100)] and got[4] == [(2, "ISC", 100), (again, "ISC", 100)] and got[5] == []


def test_words_split_as_the_pattern_does():
    texts = ["Ab  cd\nab\x0bcd", None, "", "x", " é ü\x85 "]
    w = common.Words(pa.array(texts))
    raw = "".join(t or "" for t in texts).encode()
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in texts for x in re.findall(common.WORD, t or "")]
