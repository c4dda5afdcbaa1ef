from __future__ import annotations

import math
import random
import re
from collections import Counter

from labelspark.plans.bayes import classify_bayes, train_bayes


def brute(train, test):
    counts, docs = {}, Counter()
    for _, label, text in train:
        if label is not None:
            docs[label] += 1
            counts.setdefault(label, Counter()).update(re.findall(r"[^\W\d_]+", (text or "").lower()))
    words = set().union(*counts.values()) if counts else set()
    found = {}
    for key, _, text in test:
        known = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if w in words]
        scores = {}
        for label, c in counts.items():
            prior = math.log(docs[label] / sum(docs.values()))
            scores[label] = round(prior + sum(math.log(c[w] + 1) for w in known) - len(known) * math.log(c.total() + max(len(words), 1)), 6)
        found[key] = min(scores, key=lambda k: (-scores[k], k)) if scores else None
    return found


def sample(seed, rows, classes):
    draw = random.Random(seed)
    words = ["cat", "Dog", "été", "x1y", "sat", "the", "of", *[f"w{c}" for c in "abcdefgh"]]
    out = []
    for i in range(rows):
        label = draw.choice([None, *[f"c{min(int(draw.expovariate(0.3)), classes - 1)}"] * 9])
        near = words[(sum(map(ord, label or "")) % 3):][: 6] if draw.random() < 0.7 else words
        out.append((i, label, draw.choice([None, "", " ".join(draw.choice(near) for _ in range(draw.randint(1, 30)))])
                    if draw.random() < 0.2 else " ".join(draw.choice(near) for _ in range(draw.randint(1, 30)))))
    return out


SCHEMA = "id int, label string, body string"


def test_predictions_equal_brute_force(spark):
    for seed, classes in ((1, 2), (2, 9), (3, 30)):
        rows = sample(seed, 300, classes)
        train, test = rows[:200], [*rows[200:], (900, None, "unseen words only zzz"), (901, None, "w" * 30_000 + " cat " * 2_000)]
        model = train_bayes(spark.createDataFrame(train, SCHEMA), "body", "label")
        scored = classify_bayes(model, spark.createDataFrame(test, SCHEMA), "body", "id", keep="id")
        assert {r.id: r.response.text for r in scored.collect()} == brute(train, test)


def test_a_class_without_a_shared_word_can_be_best(spark):
    # The large class has few words: a long text of words that only the small class knows once still fits it better.
    train = [(i, "big", "a") for i in range(50)] + [(99, "small", " ".join(f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"))]
    test = [(1, None, "wak"), (2, None, "a"), (3, None, " ".join(["wak"] * 40)), (4, None, None)]
    model = train_bayes(spark.createDataFrame(train, SCHEMA), "body", "label")
    scored = classify_bayes(model, spark.createDataFrame(test, SCHEMA), "body", "id", keep="id")
    assert {r.id: r.response.text for r in scored.collect()} == brute(train, test)


def test_no_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = train_bayes(empty, "body", "label")
    (row,) = classify_bayes(model, spark.createDataFrame([(1, None, "x")], SCHEMA), "body", "id", keep="id").collect()
    assert row.response.text is None
