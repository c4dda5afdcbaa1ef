from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from labelspark.llm.queries import op11_spelling_variants
from labelspark.llm.variants import _Reduced, near_words, spelling_forms, vocabulary


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_vocabulary(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_forms(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows)


def test_neighbourhoods_equal_edits_of_reduced_words():
    words = ["abcdefg", "aaaaaaa", "éèêëàâä", "abababababab", "z" * 25, "qrstuvwxyzabcdefghijklmnop"]
    reduced = _Reduced(words, 4)
    word, near = reduced.neighbours()

    def number(symbols):
        return sum(int(s) * 5 ** i for i, s in enumerate(symbols)) % (1 << 64)

    for k, w in enumerate(words):
        symbols = reduced.digit[reduced.begin[k]:reduced.begin[k] + len(w)].tolist()
        edits = {tuple(symbols)}
        for i in range(len(symbols) + 1):
            edits |= {tuple(symbols[:i] + symbols[i + 1:])} if i < len(symbols) else set()
            for s in range(1, 5):
                edits.add(tuple(symbols[:i] + [s] + symbols[i:]))
                if i < len(symbols):
                    edits.add(tuple(symbols[:i] + [s] + symbols[i + 1:]))
        found = near[word == k].tolist()
        assert len(found) == len(set(found)) == len(edits)
        assert set(found) == {number(e) for e in edits}
    assert reduced.key.dtype == np.uint64


def test_query_equals_brute_force(spark, tmp_path, odd):
    draw = random.Random(5)
    stems = ["".join(draw.choice("abcé") for _ in range(draw.randint(7, 9))) for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = stems[min(int(draw.expovariate(0.5)), 11)]
            if draw.random() < 0.1:
                k = draw.randrange(len(w))
                w = draw.choice([w[:k] + w[k + 1:], w[:k] + draw.choice("abcéÀ") + w[k:], w[:k] + "Z" + w[k + 1:]])
            words.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i if i % 30 else None, draw.choice([" ", "_", "1"]).join(words)))
    rows += [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + rows[:3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("?"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_spelling_variants(spark, str(tmp_path)).collect()
    expected = brute_forms(brute_vocabulary(rows))
    assert sorted(map(tuple, got)) == expected
    assert len(expected) > 100 and sum(r[1] is not None for r in expected) > 20


def test_chains_ties_and_long_words(spark):
    long = "ab" * 4_000
    counts = {"aaaaaaa": 1_000_000, "aaaaaab": 50_000, "aaaaabb": 2_000, "aaaabbb": 20, "bbbbbbb": 10, "bbbbbbc": 100, "bbbbbbd": 100,
              long: 2, long + "x": 3, long[1:]: 30, "ÀÀÀÀÀÀÀ": 5, "àÀÀÀÀÀÀ": 49}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert sorted(map(tuple, spelling_forms(words).collect())) == brute_forms(counts)
    (row,) = spelling_forms(words).where("word = 'aaaabbb'").collect()
    assert (row.form, row.root) == ("aaaaabb", "aaaaaaa")


def test_a_crowded_reduced_word(spark):
    # With two symbols nearly all words meet; the comparison still finds the pairs that are there.
    draw = random.Random(9)
    words = {"".join(draw.choice("aeiou") for _ in range(7)) for _ in range(400)}
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    got = sorted((r.word, r.other) for r in near_words(table, symbols=2).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_empty_tables(spark, none, odd):
    assert spelling_forms(vocabulary(none)).count() == 0
    assert vocabulary(odd.where("text is null or text = ''")).count() == 0
