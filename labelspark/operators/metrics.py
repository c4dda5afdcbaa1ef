"""Counts, matrices and reports from predicted and true class ids.

Everything derives from ``confusion_counts``, the only pass over the rows: at most one row per
pair of classes that occurs, combined before the shuffle.

A predictions table has one row per sample with the columns ``predicted`` and ``actual``, structs
holding one class id per label, beside the sample's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark.functions.text import truncate_label
from labelspark.operators.ordering import group_quantile
from labelspark.session import as_list, join_groups, settle


def label_pairs(predictions: DataFrame, labels, by=()) -> DataFrame:
    """One row per sample and label: ``(by…, label_name, true_id, pred_id)``."""
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("label_name"),
            F.col("actual").getField(c).alias("true_id"),
            F.col("predicted").getField(c).alias("pred_id"),
        )
        for c in as_list(labels)
    ])
    return predictions.select(*as_list(by), F.inline(pairs))


def confusion_counts(predictions: DataFrame, labels, by=()) -> DataFrame:
    """Rows per pair of true and predicted class."""
    return label_pairs(predictions, labels, by).groupBy(
        *as_list(by), "label_name", "true_id", "pred_id").agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, by=()) -> DataFrame:
    """Counts with their share of the true class."""
    total = F.sum("n").over(Window.partitionBy(*as_list(by), "label_name", "true_id"))
    return counts.withColumn("ratio", F.col("n") / total)


def class_table(spark: SparkSession, vocab: dict[str, list[str]]) -> DataFrame:
    """One row per class of a vocabulary: ``(label_name, class_id, class_name)``."""
    rows = [(label, i, name) for label, names in vocab.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "label_name string, class_id int, class_name string")


def matrix_rows(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row per class of the vocabulary, ``(label_name, true_id, true_name, n, cells)``: how often it was
    true, and a map from each predicted id to its count.

    This holds a matrix of any number of classes in as many entries as there are pairs that occur.
    """
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("pred_id", "n"))))
    rows = counts.groupBy("label_name", F.col("true_id").alias("class_id")).agg(F.sum("n").alias("n"), entries.alias("cells"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>"))
    return vocab.join(rows, ["label_name", "class_id"], "left").select(
        "label_name", F.col("class_id").alias("true_id"), F.col("class_name").alias("true_name"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("cells", none).alias("cells"))


def dense_matrix(counts: DataFrame, vocab: dict[str, list[str]], char_limit: int = 15,
                 text_classes: int = 15) -> DataFrame:
    """Every pair of classes of the vocabulary with count, share and display names.

    Rows of :func:`matrix_rows` are spread first and widened in place, so a row of cells is made where
    its class lies. ``show_text`` is off for labels with more than ``text_classes`` classes.
    """
    spark = counts.sparkSession
    classes = class_table(spark, vocab)
    sizes = F.lit(0)
    for label, names in vocab.items():
        sizes = F.when(F.col("label_name") == label, F.lit(len(names))).otherwise(sizes)
    rows = matrix_rows(counts, classes).withColumn("_size", sizes).repartition("label_name", "true_id")
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)).alias("pred_id"))
    names = classes.select("label_name", F.col("class_id").alias("pred_id"), F.col("class_name").alias("pred_name"))
    cells = cells.withColumn("_n", F.coalesce(F.try_element_at("cells", F.col("pred_id")), F.lit(0))).drop("cells")
    return cells.join(names, ["label_name", "pred_id"]).select(
        "label_name", "true_id", "pred_id",
        truncate_label(F.col("true_name"), char_limit).alias("true_name"),
        truncate_label(F.col("pred_name"), char_limit).alias("pred_name"),
        F.col("_n").alias("n"),
        F.when(F.col("n") > 0, F.col("_n") / F.col("n")).otherwise(F.lit(0.0)).alias("ratio"),
        (F.col("_size") <= text_classes).alias("show_text"),
    )


def matrix_blocks(counts: DataFrame, side: int = 64) -> DataFrame:
    """A matrix cut into squares of ``side`` classes: ``(label_name, true_from, pred_from, n, cells)``, the squares in
    which a pair occurs.

    ``cells`` are the ``(true_id, pred_id, n)`` of the pairs that occur, in order, at most ``side`` squared. A writer of
    a matrix of any number of classes gets one square after the other; :func:`block_values` fills a square up.
    """
    corner = lambda c: (F.floor(F.col(c) / side) * side).cast("int")
    squares = counts.groupBy("label_name", corner("true_id").alias("true_from"), corner("pred_id").alias("pred_from"))
    return squares.agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("true_id", "pred_id", "n"))).alias("cells"))


def block_values(side: int = 64) -> Column:
    """The rows of a square of :func:`matrix_blocks` as arrays of counts, zeros included."""
    places = F.map_from_entries(F.transform("cells", lambda c: F.struct(
        ((c["true_id"] - F.col("true_from")) * side + c["pred_id"] - F.col("pred_from")).alias("at"), c["n"].alias("n"))))
    count = lambda i, j: F.coalesce(F.try_element_at(places, (i * side + j).cast("int")), F.lit(0).cast("long"))
    along = F.sequence(F.lit(0), F.lit(side - 1))
    return F.transform(along, lambda i: F.transform(along, lambda j: count(i, j)))


def matrix_pivot(counts: DataFrame, label: str, names: list[str]) -> DataFrame:
    """One row per true class that occurs, one count column per predicted class.

    A column per class suits small vocabularies; :func:`matrix_rows` has the same counts for any.
    """
    own = counts.where(F.col("label_name") == label)
    wide = own.groupBy("true_id").pivot("pred_id", list(range(len(names)))).agg(F.sum("n"))
    columns = [F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(name) for i, name in enumerate(names)]
    return wide.select(F.get(F.lit(names), F.col("true_id")).alias("true_name"), *columns)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(counts: DataFrame, by=()) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    Rows are keyed by class id as text, for all classes on either side. As in the established
    report files, the accuracy row repeats its value in all four columns.
    """
    keys = [*as_list(by), "label_name"]
    hit = F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("true_id").alias("class_id"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.cast("long").alias("hits")),
        F.struct(F.col("pred_id").alias("class_id"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("hits")),
    )
    marginals = counts.select(*keys, F.inline(sides)).groupBy(*keys, "class_id").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    # One row per class, used twice below.
    classes = settle(marginals).df.select(
        *keys, "class_id", "hits", F.col("support").cast("double").alias("support"),
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
    )
    metrics = ("precision", "recall", "f1")
    total = F.sum("support")
    averages = classes.groupBy(*keys).agg(
        total.alias("total"),
        (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in metrics],
    )

    def row(key: str, values: list[str]) -> Column:
        return F.struct(F.lit(key).alias("row_key"),
                        *[F.col(v).cast("double").alias(m) for v, m in zip(values, (*metrics, "support"))])

    summary = averages.select(*keys, F.inline(F.array(
        row("accuracy", ["accuracy"] * 4),
        row("macro avg", [*[f"macro_{m}" for m in metrics], "total"]),
        row("weighted avg", [*[f"weighted_{m}" for m in metrics], "total"]),
    )))
    per_class = classes.select(*keys, F.col("class_id").cast("string").alias("row_key"), *metrics, "support")
    return per_class.unionByName(summary)


def token_usage(predictions: DataFrame, by=()) -> DataFrame:
    """Token totals of all responses."""
    fields = ("prompt_tokens", "completion_tokens", "total_tokens")
    return predictions.groupBy(*as_list(by)).agg(
        *[F.sum(F.col("response").getField(f).cast("long")).alias(f) for f in fields])


def response_latency(predictions: DataFrame, by=()) -> DataFrame:
    """Rows, mean and median of the response latency in seconds; the median is exact, the lower one of two."""
    latency = F.col("response").getField("latency")
    medians = group_quantile(predictions, latency, 0.5, by, "median_latency")
    means = predictions.groupBy(*as_list(by)).agg(F.count("*").alias("samples"), F.avg(latency).alias("mean_latency"))
    return join_groups(means, medians, by, "left")


def latency_per_sample(headers: DataFrame, predictions: DataFrame, run: str = "run_id") -> DataFrame:
    """Elapsed time of a run divided by its samples."""
    samples = predictions.groupBy(run).agg(F.count("*").alias("samples"))
    return headers.join(samples, run).select(
        run, "samples", (F.col("total_time_elapsed") / F.col("samples")).alias("latency"))


def elapsed_interval(seconds: Column) -> Column:
    """Seconds as a day-time interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
