"""Centroids, periodic runs, token counts, parts of the vector index, and densities that decide: brute force on small tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from progdf.llm import centroids, html, neighbours, periodic, tokencount


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string")


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(c)), key=lambda z: (far(v, c[z]), z))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for z in range(len(c)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == z]
            if own:
                c[z] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, near(v), far(v, c[near(v)]), v) for i, v in kept]
    total = sum(r[2] for r in out)
    return sorted((-1 if i is None else i, z, d, sum(r[2] for r in out if r[1] == z), total, hashlib.sha256(",".join(map(str, c[z])).encode()).hexdigest()) for i, z, d, _ in out)


def test_centroids_are_those_of_all_comparisons(spark):
    rng = np.random.default_rng(2)
    about = rng.normal(size=(6, 64))
    rows = [(i, [float(np.float32(x)) for x in about[i % 6] * 0.3 + rng.normal(size=64) * (0.01 if i % 3 else 0.2)]) for i in range(260)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies, and rows that repeat an id
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]), (905, [float("-inf")] * 64)]
    out = centroids.clustered(vectors(spark, rows).repartition(3))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out.collect()) == brute_clusters(rows)


def test_centroids_of_odd_tables(spark):
    d = vectors(spark, [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.001] * 64)])
    assert sorted(tuple(r) for r in centroids.clustered(d).collect()) == brute_clusters([(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.001] * 64)])
    assert centroids.clustered(d.where("false")).collect() == [] and centroids.clustered(vectors(spark, [(1, None)])).columns == out_columns()
    with pytest.raises(Exception, match="63 bits"):
        centroids.clustered(vectors(spark, [(1, [1e9] * 64)])).collect()


def out_columns():
    return [x.split()[0] for x in centroids.RESULT.split(", ")]


def test_trees_give_each_vector_to_its_nearest_and_whole_balls_without_looking():
    rng = np.random.default_rng(4)
    whole = 0
    for n in (1, 15, 16, 17, 300, 1024):
        about = rng.integers(-900, 900, (5, 64))
        points = about[rng.integers(0, 5, n)] + rng.integers(-20, 21, (n, 64))
        tree, order = centroids.Tree.grown(points)
        c = np.concatenate([about, points[:1], points[:1]])
        want = np.stack([centroids.squared(tree.points, x) for x in c], axis=1).argmin(axis=1)
        assert (tree.points == points[order]).all() and (tree.clusters(c) == want).all()
        count, sums = np.zeros(len(c), np.int64), np.zeros((len(c), 64), np.int64)
        tree.totals(c, count, sums)
        assert all(count[z] == (want == z).sum() and (sums[z] == tree.points[want == z].sum(axis=0)).all() for z in range(len(c)))
        whole += sum(int(x[1].sum()) for x in tree.assigned(about) if x[1] is not None)
    assert whole > 1000


def brute_runs(w, exponent=4, least=6):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(w[i + x] == w[i + x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(rng, most):
    w = []
    while len(w) < most:
        if rng.random() < 0.6:
            unit = [rng.randint(0, rng.choice([0, 1, 2, 30])) for _ in range(rng.choice([1, 2, 3, 5, 17, 20, 33]))]
            w += (unit * rng.randint(1, 7))[: rng.randint(1, 120)]
        else:
            w += [rng.randint(0, 40) for _ in range(rng.randint(1, 9))]
    return w[:most]


def test_runs_are_those_of_all_lags():
    rng, n = random.Random(5), 0
    for _ in range(400):
        w = repeating(rng, rng.randint(0, 400))
        want = brute_runs(w)
        n += len(want)
        assert [tuple(r) for r in periodic.find_runs(np.array(w, np.int64)).tolist()] == want
    assert n > 500
    assert [tuple(r) for r in periodic.find_runs(np.array([3, 3, 3, 3, 3, 3, 4] * 3)[:14], 3, 3).tolist()] == brute_runs(([3, 3, 3, 3, 3, 3, 4] * 3)[:14], 3, 3)


@pytest.mark.parametrize("words", [[0] * 300_000, list(range(60_000)) * 5, [i % 2 for i in range(200_001)]])
def test_runs_of_very_long_texts(words):
    p = next(q for q in (1, 2, 60_000) if words[q] == words[0] and words[: len(words) - q] == words[q:])
    assert periodic.find_runs(np.array(words, np.int64)).tolist() == [[0, len(words), p]]


def test_run_digests(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x\ta b a b a b a b\x0by", "é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é é\xa0é"]
    texts += [" ".join(f"w{x}" for x in repeating(rng, rng.randint(1, 200))) for _ in range(120)]
    rows = [(i, t, "en", 1, "z") for i, t in enumerate(texts)] + [(None, texts[5], "en", 1, "z"), (6, texts[6], "en", 1, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_runs int, start string")
    want = []
    for i, t, *_ in rows:
        w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in t or "").split(" ") if x]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = brute_runs(w)
        gone = {j for s, n, p in runs for j in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((-1 if i is None else i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in periodic.digests(d, periodic.planted).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.digests(d.where("false"), periodic.planted).count() == 0
    assert {r.text for r in periodic.collapsed(d).where("n_dropped > 0").collect()} >= {"a", "x a b y"} and periodic.collapsed(d).where("doc_id = 2").first().text == " \n"
    assert periodic.periodic_runs(d).where("doc_id = 6").distinct().collect()[0][1:] == (1, 8, 2)


ODD = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "▁", "é", "漢", "\x00", "<s>", "</s>", "<0x0A>", "the", "ing", "\r", "\xa0", "🙂", " the", "�", "   "]


def test_token_counts_are_the_library_s(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_path())
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "▁", "a ", "x" * 300_000, " " * 100_000, "word " * 250_000] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    rows = [(i, t, 9, "x") for i, t in enumerate(texts)] + [(None, "null id", 9, "x"), (5, "a ", 9, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string").repartition(23, "doc_id")
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in tokencount.token_counts(d).collect())
    count = lambda t: len(sp.encode(t or ""))
    assert got == sorted((-1 if i is None else i, len((t or "").encode()), count(t), count(t) > 4096) for i, t, *_ in rows)
    assert tokencount.token_counts(d.where("false")).count() == 0


def test_frequent_pre_tokens_are_counted_over_all_texts(spark):
    """Summaries of many partitions, merged in rounds, have every pre-token above the bound."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", f"r{rng.randint(0, 9999)}"]) for _ in range(200)) for _ in range(120)]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(40)
    found = tokencount.frequent(d, keep=20)
    assert {"▁the", "▁of"} <= set(found) and len(found) <= 20
    lengths = tokencount.Lengths(tokencount.Encoder(open(tokencount.default_path(), "rb").read()), {}, cached=50)
    assert lengths.counts(texts) == lengths.counts(texts) and len(lengths) < 50 + 120 * 200


@pytest.mark.parametrize("n", [60, 600, 3000])
def test_recall_with_more_than_one_part(spark, n):
    rng = np.random.default_rng(n)
    about = rng.normal(size=(12, 24))
    x = about[rng.integers(0, 12, n)] + rng.normal(size=(n, 24)) * 0.7
    d = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert neighbours.parts_for(n) > 4
    out = neighbours.nearest(d, d.where("vec_id % 10 = 0"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, n, 10):
        s = unit @ unit[q]
        s[q] = -9
        want = set(np.argsort(-s, kind="stable")[:5].tolist())
        assert len(got[q]) == 5
        hits, total = hits + len(want & got[q]), total + 5
    assert hits / total >= 0.9


def test_density_overcomes_a_hint_and_chooses_without_marks(monkeypatch):
    long = "This section explains at length how comments are written. " * 18
    story = "<h1>Title</h1><p>" + "A paragraph of the article, as prose has it. " * 8 + "</p>"
    page = f"<body><article>{story}<div class='comment-guide'><section><p>{long}</p></section></div><div class='comment-list'><p>{long}</p></div><div class='comment-guide'><p>Short</p></div></article></body>"
    assert long.strip() in html.main_text(page) and html.main_text(page).count("explains at length") == 18 and "Short" not in html.main_text(page)
    plain = f"<body><div><b>More</b> <a href=1>one of the other pages</a> <a href=2>another of them</a> <a href=3>a third</a> here</div><div>{story}</div></body>"
    text = html.main_text(plain)
    assert text.startswith("Title") and "other pages" not in text
    monkeypatch.setattr(html, "main_node", lambda nodes: (nodes[0], 0.0))
    assert html.main_text(plain) != text


