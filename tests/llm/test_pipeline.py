"""The pipeline's stages against brute force, and SQL where it can."""

import re
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from progdf.llm import bpe, common

from test_operators import brute_components, brute_repeats, prose

DATA = "/root/testdata/sf0.001"
COLUMNS = corpus_pipeline.COLUMNS


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "mixing", "bpe"]

    kept = common.saved(stages["quality"](spark, docs, DATA), "test")
    accepted = {r.doc_id for r in entry.queries()["op2_quality"](spark, DATA).where("predicted = 1").collect()}
    assert rows(kept) == Counter({r: n for r, n in rows(docs).items() if r[0] in accepted}) and 0 < kept.count() < docs.count()

    ordered = sorted(kept.collect(), key=lambda r: r.doc_id)
    part, _ = brute_components([r.text for r in ordered], 5, 80)
    one = common.saved(stages["near_dedup"](spark, kept, DATA), "test")
    assert rows(one) == Counter(tuple(r) for i, r in enumerate(ordered) if part[i] == i)

    ordered = sorted(one.collect(), key=lambda r: r.doc_id)
    plain = common.saved(stages["substring_dedup"](spark, one, DATA), "test")
    low = {c: c + 32 for c in range(65, 91)}
    want = brute_repeats([r.text or "" for r in ordered], 50)
    got = {r.doc_id: r for r in plain.collect()}
    assert [re.findall(common.WORD, (got[r.doc_id].text or "").translate(low)) for r in ordered] == want and len(got) == len(ordered)
    assert all(got[r.doc_id].n_chars == len(got[r.doc_id].text) and (got[r.doc_id].lang, got[r.doc_id].source) == (r.lang, r.source) for r in ordered if r.text is not None)

    mixed = common.saved(stages["mixing"](spark, plain, DATA), "test")
    times, there = rows(mixed), rows(plain)
    assert all(r in there and n <= 2 * there[r] for r, n in times.items())
    size = lambda r: len(re.findall(common.WORD, r[1] or ""))
    sources = sorted({r[3] for r in there}, key=lambda s: (s is None, s or ""))
    have = {s: sum(n * size(r) for r, n in there.items() if r[3] == s) for s in sources}
    took = {s: sum(n * size(r) for r, n in times.items() if r[3] == s) for s in sources}
    target, left, open_ = {}, 1.5 * sum(have.values()), list(sources)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    while full := [s for s in open_ if left * weight[s] >= 2 * have[s] * sum(weight[x] for x in open_)]:
        target |= {s: 2 * have[s] for s in full}
        left -= sum(2 * have[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    longest = {s: max(size(r) for r in there if r[3] == s) for s in sources}
    assert all(abs(took[s] - target[s]) <= longest[s] for s in sources) and abs(sum(took.values()) / sum(target.values()) - 1) < 0.02

    library = Tokenizer.from_file(bpe.default_path())
    ids = corpus_pipeline.bpe(spark, mixed, DATA).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in ids) == Counter({(r[0], len(x := tuple(library.encode(r[1] or "", add_special_tokens=False).ids)), x): n for r, n in times.items()})
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()) == Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in ids)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    long = prose(20_000)
    odd = [(None, "no id at all", None, None, None), (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n", None, "b", 2), (4, long, "en", "b", 9), (4, long, "en", "b", 9), (5, "same", "xx", "a", 4), (5, "other words", "xx", "a", 4)]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, size long, copies string, score double")
    out = f(spark, df, DATA)
    got = out.collect()
    ids = Counter(r.doc_id for r in got)
    if stage == "bpe":
        assert ids == Counter(r[0] for r in odd) and all(r.n_tokens == len(r.ids) for r in got) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    else:
        assert out.columns == list(COLUMNS)
    if stage == "near_dedup":
        assert ids == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2})
    if stage == "substring_dedup":
        assert ids == Counter(r[0] for r in odd) and {r.text for r in got if r.doc_id == 4} == {long}
    if stage == "mixing":
        assert all(ids[i] == 1 for i in (1, 2, 3)) and ids[None] >= 1 and all(n <= 4 for n in ids.values())
    assert f(spark, df.where("false"), DATA).count() == 0


def test_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for name in ("op6_substring_dedup", "op9_mix_sources", "op10_licence_scan"):
        got = entry.queries()[name](spark, DATA).collect()
        want = db.execute(entry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(str([r[c] for c in names]) for r in got) == sorted(str(list(r)) for r in want.fetchall())
