from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspark.llm.periods import Grammar, find_runs, runs_of
from labelspark.llm.queries import op13_periodic_runs


def brute_runs(words):
    """All runs by trying every period on every place."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(draw, symbols, n):
    """Random words with planted periods, some within others."""
    words = [draw.randrange(symbols) for _ in range(n)]
    for _ in range(draw.randint(0, 4)):
        if n > 30:
            a = draw.randrange(n - 24)
            p = draw.randint(1, max(1, (n - a) // 3))
            stop = draw.randint(a, n)
            for i in range(a, stop):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)
    lists = [periodic(draw, draw.choice([1, 2, 3, 50]), draw.choice([0, 1, 23, 24, 25, 60, 200, 400])) for _ in range(40)]
    doc, start, length, q = runs_of([np.array(w, np.int64) for w in lists])
    got = [[] for _ in lists]
    for d, *run in zip(doc.tolist(), start.tolist(), length.tolist(), q.tolist()):
        got[d].append(tuple(run))
    assert got == [brute_runs(w) for w in lists]


def test_extensions_equal_comparison():
    draw = random.Random(3)
    words = periodic(draw, 2, 300) + [0] * 40 + periodic(draw, 3, 200) + [1, 0] * 30
    sequence = np.array([0, *[w + 2 for w in words], 1])
    grammar = Grammar.of(sequence, 2)
    a = np.array([draw.randrange(1, len(words)) for _ in range(3000)])
    b = np.array([draw.randrange(i + 1, len(words) + 1) for i in a.tolist()])
    forward, back = grammar.agree(a, b), grammar.agree(a, b, back=True)
    for i, j, f, k in zip(a.tolist(), b.tolist(), forward.tolist(), back.tolist()):
        assert (sequence[i:i + f] == sequence[j:j + f]).all() and sequence[i + f] != sequence[j + f]
        assert (sequence[i - k + 1:i + 1] == sequence[j - k + 1:j + 1]).all() and sequence[i - k] != sequence[j - k]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def _key(row):
    return tuple((x is None, x) for x in row)


def test_query_equals_brute_force(spark, tmp_path, odd):
    tail = " ".join(f"w{i % 7}" for i in range(100))
    more = spark.createDataFrame([(1000 + i, f"start {i} {tail} end   x y", "?") for i in range(60)], "doc_id bigint, text string, runs string")
    docs = odd.select("doc_id", "text", F.lit("?").alias("runs")).union(more)
    docs.where("text is null or length(text) < 20000").write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.where("text is null or length(text) < 20000").collect()
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=_key) == sorted((expected(r.doc_id, r.text) for r in rows), key=_key)


def test_long_text_and_empty_table(spark, odd, none):
    found = {r.doc_id: r for r in find_runs(odd.where("length(text) > 20000")).collect()}
    (row,) = found.values()
    # Nine words repeated 3,000 times is one run, and one period of it stays.
    assert [tuple(r) for r in row.runs] == [(0, 27_000, 9)]
    assert row.collapsed == "a long text of plain words that goes on"
    assert find_runs(none).count() == 0


def test_operator_keeps_texts_without_runs(spark):
    docs = spark.createDataFrame([(1, " a  b\tc "), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in find_runs(docs).orderBy("doc_id").collect()] == [(1, 3, [], "a b c"), (2, 0, [], "")]
