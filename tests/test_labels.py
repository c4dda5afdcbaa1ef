from __future__ import annotations

import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelspark import session
from labelspark.operators import labels as L

NATURE, PART = "NatureTitle", "Part of Body Title"


def stripped(df, label):
    return [r[label].strip() for r in df.collect() if r[label] is not None]


def top(counter, n):
    return [k for k, _ in sorted(counter.items(), key=lambda kv: (-kv[1], kv[0]))[:n]]


def test_labelled_dataset(injuries):
    whole = L.labelled_dataset(injuries, "Final Narrative", NATURE, drop_nulls=False)
    assert whole.columns == ["Final Narrative", NATURE] and whole.count() == 600
    several = L.labelled_dataset(injuries, ["Final Narrative", "Inspection"], [NATURE, PART])
    assert several.columns == ["Final Narrative", "Inspection", NATURE, PART]
    assert several.count() == injuries.dropna(subset=[NATURE, PART]).count()
    assert sorted(r[NATURE] for r in whole.dropna().collect()) == sorted(stripped(injuries, NATURE))


def test_missing_column_is_named(injuries):
    with pytest.raises(ValueError, match="no such column: Employer"):
        L.labelled_dataset(injuries, "Employer", NATURE)


def test_vocabulary_encode_decode(injuries):
    clean = L.strip_labels(injuries, [NATURE, PART])
    vocab = L.label_vocabulary(injuries, [NATURE, PART])
    lists = L.vocabulary_lists(vocab, [NATURE, PART])
    assert lists == {c: sorted(set(stripped(injuries, c))) for c in (NATURE, PART)}
    encoded = L.encode_classes(clean, [NATURE, PART], vocab)
    assert dict(encoded.dtypes)[NATURE] == "int"
    for r in encoded.join(clean.select("id", F.col(NATURE).alias("n")), "id").collect():
        assert (r[NATURE] is None and r.n is None) or lists[NATURE][r[NATURE]] == r.n
    back = L.decode_classes(encoded, [NATURE, PART], vocab)
    assert sorted(map(str, back.collect())) == sorted(map(str, clean.collect()))


def test_vocabulary_beyond_the_small_bounds(injuries, monkeypatch):
    small = sorted(L.label_vocabulary(injuries, [NATURE, PART]).collect())
    monkeypatch.setattr(session, "small_rows", lambda df, max_rows=0: None)
    assert sorted(L.label_vocabulary(injuries, [NATURE, PART]).collect()) == small
    clean = L.strip_labels(injuries, NATURE)
    assert L.encode_classes(clean, NATURE).where(F.col(NATURE).isNull()).count() == injuries.where(F.col(NATURE).isNull()).count()


def test_decode_strips_names(articles, article_classes):
    names = {r.label for r in L.decode_classes(articles, "label", article_classes).collect()}
    assert names == {f"Class{i:02d}" for i in range(14)}


@pytest.mark.parametrize("n", [1, 5, 10])
def test_top_n_classes(injuries, n):
    rows = L.labelled_dataset(injuries, "Final Narrative", [NATURE, PART])
    kept = L.top_n_classes(rows, n, NATURE)
    assert {r[NATURE] for r in kept.collect()} == set(top(Counter(stripped(rows, NATURE)), n))
    both = L.top_n_classes(rows, n, [NATURE, PART])
    natures, parts = (set(top(Counter(stripped(rows, c)), n)) for c in (NATURE, PART))
    want = [r for r in rows.collect() if r[NATURE] in natures and r[PART] in parts]
    assert both.count() == len(want)


def test_top_n_is_cut_to_the_shortest_label(spark):
    rows = spark.range(60).select(F.concat(F.lit("a"), F.col("id") % 6).alias("a"), F.concat(F.lit("b"), F.col("id") % 2).alias("b"))
    with pytest.warns(UserWarning):
        kept = L.top_n_classes(rows, 5, ["a", "b"])
    assert {r.a for r in kept.collect()} == {"a0", "a1"}


@pytest.mark.parametrize("in_list", [1000, 1])
def test_top_n_uses_the_main_split(spark, monkeypatch, in_list):
    monkeypatch.setattr(L, "IN_LIST", in_list)
    rows = spark.createDataFrame(
        [("x", "train")] * 5 + [("y", "train")] * 4 + [("z", "train")] * 3 + [("z", "test")] * 9 + [("y", "test")] * 2,
        "label string, split string")
    kept = L.top_n_classes(rows, 2, split_col="split")
    assert Counter((r.label, r.split) for r in kept.collect()) == {("x", "train"): 5, ("y", "train"): 4, ("y", "test"): 2}
    given = L.top_n_classes(rows, classes={"label": ["z", "x"]})
    assert Counter(r.label for r in given.collect()) == {"z": 12, "x": 5}


@pytest.mark.parametrize("many", [False, True])
def test_drop_rare_classes(spark, injuries, monkeypatch, many):
    if many:
        monkeypatch.setattr(session, "small_rows", lambda df, max_rows=0: None)
    rows = L.strip_labels(injuries, [NATURE, PART]).collect()
    want = rows
    for label in (NATURE, PART):
        counts = Counter(r[label] for r in want if r[label] is not None)
        want = [r for r in want if r[label] is None or counts[r[label]] > 40]
    got = L.drop_rare_classes(L.strip_labels(injuries, [NATURE, PART]), [NATURE, PART], 40)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want)
    assert any(r[NATURE] is None for r in want)


def test_counts(injuries):
    clean = L.strip_labels(injuries, [NATURE, PART])
    counter = Counter(stripped(injuries, NATURE))
    got = {r.class_name: r.n for r in L.class_counts(clean, NATURE).collect()}
    assert got == counter
    assert L.minority_class_size(clean, NATURE).first().n_rarest == min(counter.values())
    assert {r.label_name: r.n_classes for r in L.distinct_classes(clean, [NATURE, PART]).collect()}[NATURE] == len(counter)
    shown = L.total_vs_balanced(clean, NATURE, 3).collect()
    assert {r.class_name for r in shown} == set(top(counter, 3))
    assert {r.balanced for r in shown} == {sorted(counter.values())[-3]}


def test_settled_tables_are_measured(spark):
    assert session.settle(spark.range(10)).small
    assert not session.settle(spark.range(session.SMALL_ROWS + 1)).small
    long_text = spark.range(1).select(F.repeat(F.lit("x"), session.SMALL_CHARS + 1).alias("s"))
    settled = session.settle(long_text)
    assert not settled.small and len(settled.df.first().s) == session.SMALL_CHARS + 1


@pytest.mark.parametrize("n", [1, 7, 40, 60])
def test_top_n_by_a_threshold(spark, monkeypatch, n):
    monkeypatch.setattr(L, "IN_LIST", 0)
    rows = [(f"a{i * i % 61}", f"b{i % 47}") for i in range(500)] + [("only", None)] * 3
    df = spark.createDataFrame(rows, "a string, b string")
    counts = {c: Counter(r[k] for r in rows if r[k] is not None) for k, c in enumerate("ab")}
    n_cut = min(n, min(len(c) for c in counts.values()))
    kept = {c: set(top(counts[c], n_cut)) for c in "ab"}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = L.top_n_classes(df, n, ["a", "b"])
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r[0] in kept["a"] and r[1] in kept["b"])
    chosen = L._most_frequent(L.class_counts(df, ["a", "b"]), ["a", "b"], n).collect()
    assert {c: {r.class_name for r in chosen if r.label_name == c} for c in "ab"} == {c: set(top(counts[c], n)) for c in "ab"}
