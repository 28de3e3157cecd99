"""Scores by blocks of numbered words: texts travel once, as numbers, and blocks are bounded whatever the rows are."""

import re
from collections import Counter

import numpy as np

from soundlake.llm import hmm
from soundlake.llm.common import WORDS


def test_words_are_those_of_the_contract():
    text = bytes(range(256)) + " A b C\x1c\x1d\x1e\x1f\x85d　É ".encode() * 2
    assert hmm.words_of(text) == re.findall(WORDS, text.lower())


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(i, f"some words {i % 7} of text {i}") for i in range(200)], "doc_id long, text string")
    plan = hmm.score(docs, passes=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "codes" in plan and "text" not in plan


def test_equal_rows_fill_several_blocks(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(5, text)] * 300 + [(6, "w1 w2 other")], "doc_id long, text string").repartition(2)
    made = hmm._blocks(docs.selectExpr("doc_id", "false AS held_out", "text"), 20 * len(text)).collect()
    per_block = Counter(r.block for r in made if r.codes is not None)
    assert sum(per_block.values()) == 301 and max(per_block.values()) <= 21
    total = Counter()
    for r in made:
        if r.word is not None:
            total[r.word] += r.n
    assert total == Counter(w for t in [text] * 300 + ["w1 w2 other"] for w in t.encode().split())
    rows = hmm.score(docs, passes=1, block_bytes=20 * len(text)).collect()
    one = hmm.score(docs, passes=1).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in one)
    assert np.allclose(sorted(r.score for r in rows), sorted(r.score for r in one), rtol=1e-4)


def test_ranks_of_full_classes(spark):
    words = [f"{i}same" for i in range(70_000)]  # one class: a rank takes one, two or four bytes
    rows = [(1, " ".join(words)), (2, words[5]), (3, words[300]), (4, words[-1] + " new " + words[-1])]
    got = {r.doc_id: r for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), passes=1).collect()}
    count = Counter(w for i, t in rows for w in [*t.split(), None] if not got[i].held_out)
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*t.split(), None]
        assert got[i].n_tokens == len(tokens) and got[i].n_known == sum(count[w] > 0 for w in tokens) and got[i].train_tokens == n
        assert np.isclose(got[i].base_score, sum(np.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in tokens))
