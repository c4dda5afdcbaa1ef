from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from labelspark.llm import ngrams
from labelspark.llm.eliasfano import EliasFano
from labelspark.llm.ngrams import Level, fold_held_out, score_texts
from labelspark.llm.queries import op12_lm_scoring


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def code(p):
    return min(round(-math.log10(p) * 1024), 65_535)


def brute_scores(rows, orders=ngrams.ORDER, priors=ngrams.PRIORS):
    """Counts of all n-grams in dictionaries, and the same smoothing."""
    split = lambda t: [*lower(t or "").encode().split(), b""]
    texts = [(d, split(t)) for d, t in rows]
    counts, context = Counter(), Counter()
    for d, tokens in texts:
        if not held_out(d):
            padded = [b"", *tokens]
            counts.update((w,) for w in tokens)
            for n in range(2, orders + 1):
                for i in range(len(padded) - n + 1):
                    counts[tuple(padded[i:i + n])] += 1
                    context[tuple(padded[i:i + n - 1])] += 1
    total = sum(c for g, c in counts.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in counts)
    rows = []
    for d, tokens in texts:
        base = score = known = 0
        padded = [b"", *tokens]
        for i, w in enumerate(tokens):
            p = (counts[w,] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            known += counts[w,] > 0
            q = code(p)
            for n in range(2, orders + 1):
                if i + 2 >= n:
                    gram = tuple(padded[i + 2 - n:i + 2])
                    if context[gram[:-1]]:
                        prior = priors[min(n - 2, len(priors) - 1)]
                        q = code((counts[gram] + prior * 10 ** (-q / 1024)) / (context[gram[:-1]] + prior))
            score -= q / 1024
        rows.append((d, held_out(d), len(tokens), known, total, base, score))
    return rows


def same(got, expected):
    key = lambda r: tuple((x is None, x) for x in (r[0], r[2], round(r[5], 6), r[6]))
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [(*r[:5], r[6]) for r in got] == [(*r[:5], r[6]) for r in expected]
    assert np.allclose([r[5] for r in got], [r[5] for r in expected], rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0, 7, 7, 1000], list(range(400)), [1 << 50, (1 << 50) + 3]])
def test_sequence(values):
    sequence = EliasFano(np.array(values, np.int64))
    assert sequence.access(np.arange(len(values))).tolist() == values
    for x in {0, 1, 6, 7, 8, 1000, 1001, *values[:50], *[v + 1 for v in values[:50]]}:
        (place,), (equal,) = sequence.successor(np.array([x]))
        assert place == next((i for i, v in enumerate(values) if v >= x), len(values))
        assert equal == (x in values)


def test_sequence_of_many_numbers():
    draw = np.random.default_rng(3)
    values = np.sort(draw.integers(0, 1 << 40, 20_000))
    sequence = EliasFano(values)
    assert (sequence.access(np.arange(len(values))) == values).all()
    x = np.concatenate([values[::7], draw.integers(0, 1 << 40, 5_000)])
    place, equal = sequence.successor(x)
    assert (place == np.searchsorted(values, x)).all() and (equal == np.isin(x, values)).all()
    # Two bits and the lower part of each value, beside the counts of blocks.
    assert sum(a.nbytes for a in sequence.arrays) < len(values) * 6


def test_level_finds_its_pairs_only():
    draw = np.random.default_rng(4)
    pairs = np.unique(draw.integers(0, 60, (900, 2)), axis=0) * [7, 13]
    level = Level(pairs[:, 0], pairs[:, 1], *[np.arange(len(pairs))] * 3)
    asked = np.array([(a, b) for a in range(0, 430, 1) for b in range(0, 800, 13)])
    place = level.find(asked[:, 0], asked[:, 1])
    known = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    assert place.tolist() == [known.get(tuple(a), -1) for a in asked.tolist()]


def documents():
    draw = random.Random(11)
    words = ["the", "The", "of", *[f"w{i}" for i in range(40)], "déjà"]
    rows = []
    for i in range(200):
        text = " ".join(words[min(int(draw.expovariate(0.15)), len(words) - 1)] for _ in range(draw.randint(0, 60)))
        rows.append((i, text + draw.choice(["", "\n", " the of w1 w2 w3", f" rare{i}"])))
    return [*rows, *rows[:5], (None, "the of"), (None, None)]


@pytest.mark.parametrize("orders", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, monkeypatch, orders):
    # Small chunks and contexts dealt over several tasks.
    monkeypatch.setattr(ngrams, "CHUNK_WORDS", 500)
    monkeypatch.setattr(ngrams, "CONTEXT_WORDS", 10)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("?")).repartition(3)
    same(score_texts(docs, fold_held_out(), orders=orders).collect(), brute_scores(rows, orders))


def test_query_equals_brute_force(spark, odd, tmp_path):
    docs = odd.where("text is null or length(text) < 20000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = op12_lm_scoring(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), brute_scores(rows))


def test_held_out_texts_score_better_than_by_single_words(spark):
    got = op12_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out and n_tokens > 50")
    base, score, n = got.agg(F.sum("base_score"), F.sum("score"), F.count("*")).first()
    assert n > 100 and score > base


def test_empty_table_long_text_and_no_training_rows(spark, none, odd):
    assert score_texts(none, fold_held_out()).count() == 0
    (row,) = score_texts(odd.where("length(text) > 20000"), F.lit(False)).collect()
    assert row.n_tokens == 27_001 and row.score > row.base_score
    (row,) = score_texts(odd.where("doc_id = 4"), F.lit(True)).collect()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)


def test_a_word_depends_on_the_four_before_it(spark):
    rows = [(i, f"{'ab'[i % 2]} x y z {'pq'[i % 2]}", False) for i in range(40)]
    rows += [(100, "a x y z p", True), (101, "a x y z q", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, out boolean")
    score = {r.doc_id: r.score for r in score_texts(docs, F.col("out")).where("held_out").collect()}
    assert score[100] > score[101] + 0.5


def test_select_and_low_bits_of_wide_numbers():
    draw = np.random.default_rng(8)
    for top, size in ((1 << 61, 5), (1 << 60, 1), (1 << 57, 40), (4_000, 3_000), (1, 500)):
        values = np.sort(draw.integers(0, top, size))
        sequence = EliasFano(values)
        assert (sequence.access(np.arange(size)) == values).all()
        place, equal = sequence.successor(values)
        assert (place == np.searchsorted(values, values)).all() and equal.all()


def test_each_ngram_is_searched_once_for_all_chunks(monkeypatch):
    import pyarrow as pa

    asked = []
    find = Level.find
    monkeypatch.setattr(Level, "find", lambda self, context, word: asked.append(len(word)) or find(self, context, word))
    columns = [np.array(c, np.int64) for c in ([3, 3, 8], [1, 4, 4], [1, 0, 2], [0, 1, 0], [0, 0, 0], [0, 0, 0])]
    rows = [ngrams._row(c, ngrams.ASKED, 0, data=ngrams._question(columns, False)) for c in range(6)]
    table = pa.Table.from_batches([ngrams._batch(rows, pa.int64())])
    answers = ngrams._level(2, 3, ngrams.PRIORS)(table).to_pylist()
    assert asked == [3] and len(answers) == 6
    assert all(ngrams._unpacked(r["data"][0]).tolist() == [6, 0, 12] for r in answers)


def test_other_occurrences_are_told_where_they_matter(monkeypatch):
    monkeypatch.setattr(ngrams, "CONTEXT_WORDS", 10)
    count, other = np.array([1, 1, 1, 5, 5, 0]), np.array([0, 1, 4, 3, 6, 12])
    assert ngrams._others(count, other).tolist() == [0, 1, 1, 0, 6, 12]


def test_nothing_is_written_before_the_exchanges(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.createDataFrame([(i, "a b c d e f a b c") for i in range(9)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    scored = score_texts(spark.read.parquet(f"{tmp_path}/docs"), fold_held_out())
    # The plan reads the texts and no table that was written on the way.
    assert {f.rsplit("/", 2)[-2] for f in scored.inputFiles()} == {"docs"}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and scored.count() == 9


def test_tokens_after_a_single_one_need_no_logarithm(monkeypatch):
    """In a context that occurs once a probability depends on the lower one alone, so it is looked up."""
    monkeypatch.setattr(ngrams, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(20)), "text": texts, "held_out": [False] * 20})
    table = pa.Table.from_batches(ngrams._chunks(2)(iter([batch])))
    rows = pa.concat_tables([ngrams._word_level(2)(table.filter(pc.equal(table["part"], p))) for p in range(2)]).to_pylist()
    made, codes = [], ngrams._codes
    for _ in range(2):
        chunk = ngrams._Chunk(rows, 2, 2_020, 2_001)
        with monkeypatch.context() as m:
            m.setattr(ngrams, "_codes", lambda p: made.append(np.size(p)) or codes(p))
            del made[:]
            chunk.ask(2, ngrams.PRIORS, 2)
    assert sum(made) <= 40


def test_numbers_of_words():
    """Batches without words, blanks at the ends and non-ASCII words; the end of each text has number 0."""
    batches = [[None, ""], [" b a\tb ", "É é a"], ["  "], ["c b"]]
    found = [ngrams._split(pa.array(b, pa.string())) for b in batches]
    sizes = np.concatenate([n for n, _ in found])
    tokens, words = ngrams._numbered([w for _, w in found], sizes)
    assert sizes.tolist() == [1, 1, 4, 4, 1, 3]
    expected = [w for b in batches for t in b for w in [*(t or "").encode().lower().split(), ngrams.END]]
    assert [words[i] for i in tokens] == expected and len(set(words)) == len(words)
    tokens, words = ngrams._numbered([ngrams._split(pa.array([None], pa.string()))[1]], np.ones(1, np.int64))
    assert tokens.tolist() == [0] and words == [ngrams.END]


@pytest.mark.parametrize("kind", [np.int8, np.int16, np.int32, np.int64, np.uint16, np.uint32, np.float64])
def test_packed_numbers(kind):
    for values in ([], [0], [127, 5], [128], [32_768 % 2**15, 1], *([[-1, -129], [-(2**7)]] if np.dtype(kind).kind != "u" else [])):
        values = np.array(values).astype(kind)
        assert ngrams._unpacked(ngrams._packed(values), kind).tolist() == values.tolist()
    if np.dtype(kind).kind != "f":
        ends = np.array([np.iinfo(kind).min, np.iinfo(kind).max], kind)
        assert ngrams._unpacked(ngrams._packed(ends), kind).tolist() == ends.tolist()
