"""A pair of words that fills many texts costs each of them a few rows, and the same words go as before."""

import re

import pyarrow as pa
from test_operators import brute_repeats, docs

from progdf.llm import common, substring

SIZE = 8
TEXTS = ["a b " * 60, "x y z " + "a b " * 50 + "q", "a b " * 20 + "one two three " + "b a " * 30, "u v w", "c a b " * 40 + "a b " * 9]


def test_runs_of_a_text_with_the_same_words_are_one_row():
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([5, 6]), pa.array([TEXTS[0], TEXTS[1]])], ["doc_id", "version", "text"])
    marks = list(substring._marks(SIZE)([batch]))
    hot = sorted({m for b in marks for m in b.column(2).to_pylist()})
    assert sum(b.num_rows for b in marks) < 12 and sum(sum(b.column(3).to_pylist()) for b in marks) > 80
    found = list(substring._found(SIZE)([batch.append_column("marks", pa.array([hot, hot]))]))
    rows = [r for b in found for r in b.to_pylist()]
    assert len(rows) < 14
    for doc, text in ((0, TEXTS[0]), (1, TEXTS[1])):  # each window lies in one run
        at = sorted(p + o for r in rows if r["doc_id"] == doc for p in r["places"] for o in range(r["len"]))
        assert at == list(range(len(text.split()) - SIZE + 1))
    assert all(r["pos"] == r["places"][0] == min(r["places"]) and len(r["windows"]) == r["len"] for r in rows)


def test_what_repeats_within_and_between_texts_goes(spark):
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, TEXTS), passage=SIZE).collect()}
    assert [re.findall(common.WORD, got[i].text) for i in range(len(TEXTS))] == brute_repeats(TEXTS, SIZE)
