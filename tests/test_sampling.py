from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelspark import session
from labelspark.operators import sampling as S


def sizes(df, *columns):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*columns).count().collect()}


def test_sample_rows(spark, articles):
    assert S.sample_rows(articles, ratio=0.25, keys="id").count() == 420
    assert S.sample_rows(articles, size=33, keys="id").count() == 33
    assert S.sample_rows(articles, size=9999, keys="id").count() == 1680
    assert S.sample_rows(articles.limit(3), ratio=0.01, keys="id").count() == 1
    by_split = S.sample_rows(articles, ratio=0.1, keys="id", split_col="split")
    assert sizes(by_split, "split") == {("train",): 140, ("test",): 28}
    assert 300 < S.sample_rows_approx(articles, 0.25).count() < 550


def test_sample_arguments():
    for ratio, size in [(None, None), (0.5, 3), (0, None), (1.5, None), (None, 0), (-1, None)]:
        with pytest.raises(ValueError):
            S.check_sample_size(ratio, size)


def test_samples_depend_on_the_seed_only(spark, articles):
    take = lambda df, seed: {r.id for r in S.sample_rows(df, size=50, keys="id", seed=seed).collect()}
    assert take(articles, 1) == take(articles.repartition(13), 1) != take(articles, 2)


def test_balance_sizes(articles):
    one = articles.where("split = 'train'")
    assert S.balance_classes(one, ratio=0.5, keys="id").count() == 700
    assert S.balance_classes(one, size=140, keys="id").count() == 140
    assert S.balance_classes(one, samples_per_class=10, keys="id").count() == 140
    assert S.balance_classes(one, ratio=0.5, samples_per_class=10, keys="id").count() == 140
    assert S.balance_classes(one, ratio=1.7, keys="id").count() == 1400
    both = S.balance_classes(articles, ratio=0.5, keys="id", split_col="split")
    assert sizes(both, "split") == {("train",): 700, ("test",): 140}
    assert set(sizes(both, "split", "label").values()) == {50, 10}


def test_balance_arguments(articles):
    with pytest.raises(ValueError):
        S.balance_classes(articles)
    with pytest.raises(ValueError):
        S.balance_classes(articles, ratio=0.5, size=10)
    with pytest.raises(ValueError):
        S.balance_classes(articles, ratio=0)
    with pytest.raises(ValueError, match="no such column: nothing"):
        S.balance_classes(articles, "nothing", ratio=0.5)
    with pytest.raises(ValueError):
        S.balance_classes(articles, ratio=0.5, shuffle=False)


def test_balance_cuts_to_the_rarest_class(spark):
    rows = spark.range(100).withColumn("label", F.expr("case when id < 90 then 'a' when id < 97 then 'b' when id < 99 then 'c' end"))
    with pytest.warns(UserWarning):
        assert sizes(S.balance_classes(rows, samples_per_class=5, keys="id"), "label") == {("a",): 2, ("b",): 2, ("c",): 2}
    with pytest.warns(UserWarning):
        assert sizes(S.balance_classes(rows, ratio=1, keys="id"), "label") == {("a",): 2, ("b",): 2, ("c",): 2}


def test_balance_of_one_class_and_of_single_rows(spark):
    assert S.balance_classes(spark.range(20).withColumn("label", F.lit("x")), ratio=0.5, keys="id").count() == 10
    each = spark.range(20).withColumn("label", F.col("id").cast("string"))
    assert S.balance_classes(each, ratio=0.1, keys="id").count() == 20


def test_balance_without_keys(spark):
    rows = spark.range(900).select(F.expr("case when id < 600 then 'a' else 'b' end").alias("label"), (F.col("id") % 3).alias("v"))
    assert sizes(S.balance_classes(rows, samples_per_class=100), "label") == {("a",): 100, ("b",): 100}


@pytest.mark.parametrize("wide_columns", [False, True])
def test_spread_over_an_order(spark, wide_columns):
    rows = spark.range(1000).withColumn("label", F.expr("if(id < 700, 'a', 'b')"))
    if wide_columns:
        rows = rows.withColumn("text", F.repeat(F.lit("x"), 20))
    got = S.balance_classes(rows, samples_per_class=4, shuffle=False, order_cols="id")
    assert got.columns == rows.columns
    assert sorted(r.id for r in got.collect()) == [0, 233, 466, 699, 700, 799, 899, 999]


def test_spread_with_equal_order_values(spark):
    rows = spark.range(100).select(F.lit("a").alias("label"), F.lit(1).alias("at"), F.col("id").alias("payload"))
    assert S.balance_classes(rows, samples_per_class=10, shuffle=False, order_cols="at").count() == 10


@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("labels", ["NatureTitle", ["NatureTitle", "Part of Body Title"]])
def test_results_do_not_depend_on_the_size_check(injuries, monkeypatch, labels):
    take = lambda: {r.id for r in S.balance_classes(injuries.dropna(), labels, ratio=0.5, keys="id").collect()}
    small = take()
    monkeypatch.setattr(session, "small_rows", lambda df, max_rows=0: None)
    assert take() == small


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_several_labels(spark, injuries):
    labels = ["NatureTitle", "Part of Body Title"]
    rows = injuries.dropna()
    got = S.balance_classes(rows, labels, ratio=1, keys="id")
    assert len(set(sizes(got, "NatureTitle").values())) == 1
    again = S.balance_classes(rows.repartition(9), labels, ratio=1, keys="id")
    assert {r.id for r in got.collect()} == {r.id for r in again.collect()}


def test_input_is_not_changed(articles):
    before = articles.columns
    S.balance_classes(articles, ratio=0.1, keys="id").count()
    assert articles.columns == before and articles.count() == 1680
