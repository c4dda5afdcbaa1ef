"""Physical plans that must hold at any size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelspark.operators import labels as L
from labelspark.operators import metrics as M
from labelspark.operators import sampling as S
from labelspark.operators import splits as P
from labelspark.functions.answers import with_class_ids


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "rows.parquet")
    rows = spark.range(4000).select(
        "id", F.expr("if(id % 3 = 0, 'hot', concat('c', id % 7))").alias("label"), F.repeat(F.lit("text "), 40).alias("text"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_and_splits_shuffle_no_rows(stored):
    for df in (
        S.sample_rows(stored, size=700, keys="id"),
        S.sample_rows(stored, ratio=0.3, keys="id", split_col="label"),
        S.balance_classes(stored, ratio=0.5, keys="id"),
        P.random_split(stored, 0.2, "id"),
        P.hash_split(stored, 0.2, "id"),
        P.positional_split(stored, 0.8, "id"),
        P.shard(stored, 5, 1, "id"),
    ):
        text = plan(df)
        assert "hashpartitioning" not in text and "rangepartitioning" not in text and "SinglePartition" not in text


def test_class_filters_reach_the_scan(stored):
    assert "PushedFilters: [In(label" in plan(L.top_n_classes(stored, 3))
    assert "PushedFilters: [In(label" in plan(L.filter_classes(stored, {"label": ["hot", "c1"]}))


def test_columns_are_pruned(stored):
    text = plan(L.class_counts(stored, "label"))
    assert "ReadSchema: struct<label:string>" in text and "partial_count" in text


def test_labels_are_looked_up_without_a_shuffle(stored):
    text = plan(L.encode_classes(stored, "label"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert "LeftAnti" in plan(L.drop_rare_classes(stored, "label", 500))


def test_the_parser_runs_once(stored):
    names = {"label": ["hot", "c1", "Unknown"]}
    rows = with_class_ids(stored, "label", names, "predicted").withColumn("actual", F.col("predicted"))
    wrong = rows.where("predicted.label != 1 and predicted.label < 2").select(F.col("predicted.label") + F.col("actual.label"))
    assert plan(wrong).count("regexp_extract_all") == 1
    assert plan(M.confusion_counts(rows, names)).count("regexp_extract_all") == 1


def test_few_shot_rows_are_cut_before_the_shuffle(spark, stored, monkeypatch):
    from labelspark.operators import errors as E

    seen = []
    settle = E.settle
    monkeypatch.setattr(E, "settle", lambda df: seen.append(plan(df)) or settle(df))
    ids = F.struct((F.col("id") % 3).cast("int").alias("label"))
    rows = stored.withColumns({"predicted": ids, "actual": F.struct(F.lit(0).alias("label"))})
    names = {"label": ["a", "b", "Unknown"]}
    assert E.few_shot_examples(rows, M.confusion_counts(rows, names), names, "id").count() == 1
    assert seen[1].count("WindowGroupLimit") == 2
