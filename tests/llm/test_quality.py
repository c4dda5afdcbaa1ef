from __future__ import annotations

import re
from collections import Counter

import numpy as np

from labelspark.llm.quality import FEATURES, filter_quality, fit_trees, repeated_words, score_quality, statistics, train_quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i:i + 3])] > 1}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_counts(odd):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in score_quality(odd, None).collect()}
    assert got == {(r.doc_id, *brute(r.text or "")) for r in odd.select("doc_id", "text").collect()}


def test_repeats():
    assert repeated_words(b"a b c a b c".split()) == 6
    assert repeated_words(b"a a a".split()) == 0
    assert repeated_words(b"a a a a".split()) == 4
    assert repeated_words([]) == 0


def test_trees_are_monotonic_and_flat():
    draw = np.random.default_rng(0)
    rows = draw.random((2_000, 3))
    good = (rows[:, 0] + 0.5 * rows[:, 1] + 0.2 * draw.random(2_000) < 0.9).astype(float)
    trees = fit_trees(rows, good, trees=20, directions=[-1, 0, 1])
    assert ((trees.probability(rows) >= 0.5) == good).mean() > 0.9
    line = np.tile(rows[:50, None, :], (1, 21, 1))
    for feature, sign in ((0, -1), (2, 1)):
        moved = line.copy()
        moved[:, :, feature] = np.linspace(0, 1, 21)
        steps = np.diff(trees.probability(moved.reshape(-1, 3)).reshape(50, 21), axis=1)
        assert (sign * steps >= -1e-12).all()

    def walk(row):  # one node at a time
        score = trees.start
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            score += trees.value[at]
        return 1 / (1 + np.exp(-score))

    assert np.allclose(trees.probability(rows[:40]), [walk(r) for r in rows[:40]])
    assert fit_trees(rows, np.ones(2_000)) is None


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    trees = train_quality(docs, labels.where("doc_id % 2 = 0"))
    scored = score_quality(docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in scored]) > 0.97


def test_filter_keeps_columns_and_agrees(odd, none):
    kept = filter_quality(odd, None)
    assert kept.columns == odd.columns
    want = sorted(str(r.doc_id) for r in odd.collect() if not brute(r.text or "")[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert filter_quality(none, None).count() == 0 and score_quality(none, None).count() == 0
    assert train_quality(none, none.selectExpr("doc_id", "1 as quality")) is None
    assert len(statistics(b"")[1]) == len(FEATURES)
