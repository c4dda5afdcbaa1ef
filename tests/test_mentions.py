from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspark.functions import answers as A
from labelspark.functions import mentions as M


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


@pytest.mark.parametrize("window", [4, 16, 1 << 18])
def test_every_name_passes_and_few_others(spark, monkeypatch, window):
    monkeypatch.setattr(M, "WINDOW", window)
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcdé😀") for _ in range(n))
    names = list({word(n) for n in [1, 2, 7, 8, 9, 15, 16, 17, 31, 33, 70] * 3})
    found = M.name_filter(names_of(spark, names).repartition(3))
    texts = [word(draw.randint(0, 30)) + draw.choice(names) + word(draw.randint(0, 30)) for _ in range(300)]
    points = M._points("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    at, size = found.places(points, np.repeat(ends, [len(t) for t in texts]))
    got, expected, begin = set(zip(at.tolist(), size.tolist())), set(), 0
    for t in texts:
        expected |= {(begin + i, len(n)) for n in names for i in range(len(t)) if t.startswith(n, i)}
        begin += len(t)
    assert expected <= got and len(got) < 1.05 * len(expected) + 5


def test_only_what_may_be_names_is_sent_on(spark):
    # More names than are broadcast; a row per character of the texts would be 600,000.
    names = [f"class number {i} of many" for i in range(25_000)]
    vocab = spark.createDataFrame([("x", i, n) for i, n in enumerate(names)], "label_name string, class_id int, class_name string")
    filler = "the class of a number is one of many, " * 80
    texts = spark.createDataFrame([(i, f"{filler}class number{i} of  many {filler[:-2]}") for i in range(100)], "tid bigint, text string")
    found = M.name_filter(names_of(spark, [n.replace(" ", "") for n in names]))
    sent = M.candidates(texts, found).select("key", F.inline("places"))
    assert sent.count() <= 120
    got = A.last_mentions(texts, "text", vocab, "x", "c").select("tid", "c").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(100)]
