"""Human-readable answers, error statistics and few-shot examples from predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.functions.json_text import quoted_ascii
from labelspark.operators.metrics import label_pairs
from labelspark.operators.ordering import order_hash
from labelspark.session import as_list, join_groups, settle

# What ends a text of examples: the text to classify follows.
OPEN_QUESTION = "\n\nYour turn - text: "


def class_name(vocab: dict[str, list[str]], label: str, class_id: Column) -> Column:
    """Name of a class id."""
    return F.get(F.lit(vocab[label]), class_id)


def _labels_of(vocab: dict[str, list[str]] | DataFrame, labels) -> list[str]:
    return as_list(labels) if isinstance(vocab, DataFrame) else list(vocab)


def with_names(df: DataFrame, vocab: dict[str, list[str]] | DataFrame, names: dict[str, tuple[str | Column, Column]]) -> DataFrame:
    """Add class names: ``names`` gives for each new column its label, or the column that holds it, and the class id.

    Lists of names become literals of the plan; a vocabulary table is joined, broadcast only if it is small.
    """
    if isinstance(vocab, DataFrame):
        classes = settle(vocab.select(F.col("label_name").alias("_label"), F.col("class_id").alias("_id"), F.col("class_name").alias("_name")))
        for into, (label, class_id) in names.items():
            own = F.lit(label) if isinstance(label, str) else label
            same = (F.col("_label") == own) & (F.col("_id") == class_id)
            df = df.join(classes.side(), same, "left").withColumn(into, F.col("_name")).drop("_label", "_id", "_name")
        return df
    found = {}
    for into, (label, class_id) in names.items():
        if isinstance(label, str):
            found[into] = class_name(vocab, label, class_id)
            continue
        name = F.lit(None).cast("string")
        for c in vocab:
            name = F.when(label == c, class_name(vocab, c, class_id)).otherwise(name)
        found[into] = name
    return df.withColumns(found)


def answers(predictions: DataFrame, vocab: dict[str, list[str]] | DataFrame, keep=(), wrong_only: bool = False, labels=None) -> DataFrame:
    """Text, response, cost and, for every label, predicted and true class names.

    The column titles are fixed values: existing answer files have them. ``vocab`` gives the names of each label, or is a
    table of them, for which ``labels`` states the labels.
    """
    labels = _labels_of(vocab, labels)
    rows = wrong_rows(predictions, labels) if wrong_only else predictions
    response = F.col("response")
    names = {}
    for label in labels:
        for side, title in (("predicted", "Predicted"), ("actual", "True")):
            names[f"{title} {label}"] = (label, F.col(side).getField(label))
    return with_names(rows, vocab, names).select(
        *as_list(keep), F.col("text").alias("Text"),
        response.getField("text").alias("LLM Response"),
        response.getField("reasoning").alias("LLM Reasoning"),
        response.getField("latency").alias("Prediction Time"),
        response.getField("total_tokens").alias("Total Tokens"), *[F.col(f"`{n}`") for n in names])


def wrong_rows(predictions: DataFrame, labels) -> DataFrame:
    """Rows with a wrong prediction for any label."""
    wrong = F.lit(False)
    for label in labels:
        wrong = wrong | ~F.col("predicted").getField(label).eqNullSafe(F.col("actual").getField(label))
    return predictions.where(wrong)


def error_pairs(counts: DataFrame) -> DataFrame:
    """Wrong (true, predicted) pairs with their counts and the errors of the true class."""
    wrong = counts.where(F.col("true_id") != F.col("pred_id"))
    of_class = F.sum("n").over(Window.partitionBy("label_name", "true_id"))
    return wrong.withColumn("class_errors", of_class)


def true_vs_predicted(counts: DataFrame, vocab: dict[str, list[str]] | DataFrame, top: int = 15) -> DataFrame:
    """The most frequent true and the most frequent predicted classes of every label."""
    sides = F.array(
        F.struct(F.lit("true").alias("side"), F.col("true_id").alias("class_id")),
        F.struct(F.lit("predicted").alias("side"), F.col("pred_id").alias("class_id")),
    )
    sizes = counts.select("label_name", "n", F.inline(sides)).groupBy("label_name", "side", "class_id").agg(
        F.sum("n").alias("n"))
    w = Window.partitionBy("label_name", "side").orderBy(F.desc("n"), F.asc("class_name"))
    named = with_names(sizes, vocab, {"class_name": (F.col("label_name"), F.col("class_id"))}).select("label_name", "side", "class_name", "n")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def few_shot_pairs(counts: DataFrame, vocab: dict[str, list[str]] | DataFrame, per_class: int, per_true: int) -> DataFrame:
    """The classes most often mistaken and, for each, what they are mistaken for (ties by name)."""
    label = F.col("label_name")
    pairs = with_names(error_pairs(counts), vocab, {"true_name": (label, F.col("true_id")), "pred_name": (label, F.col("pred_id"))})
    by_true = Window.partitionBy("label_name").orderBy(F.desc("class_errors"), F.asc("true_name"))
    by_pred = Window.partitionBy("label_name", "true_id").orderBy(F.desc("n"), F.asc("pred_name"))
    ranked = pairs.withColumns({"true_rank": F.dense_rank().over(by_true), "pred_rank": F.row_number().over(by_pred)})
    return ranked.where((F.col("true_rank") <= per_class) & (F.col("pred_rank") <= per_true)).select(
        "label_name", "true_id", "pred_id", "true_name", "pred_name", "true_rank", "pred_rank")


def few_shot_examples(
    predictions: DataFrame,
    counts: DataFrame,
    vocab: dict[str, list[str]] | DataFrame,
    keys,
    per_class: int = 1,
    per_true: int = 1,
    per_pred: int = 1,
    seed: int = 0,
    labels=None,
) -> DataFrame:
    """Wrongly answered rows that show a model its commonest mistakes.

    For every label: the ``per_class`` true classes with most errors, for each the ``per_true``
    commonest wrong predictions, for each ``per_pred`` random rows or as many as there are.
    Every task passes on at most ``per_pred`` keys per pair; texts are fetched for the
    chosen rows only.
    """
    keys, labels = as_list(keys), _labels_of(vocab, labels)
    pairs = settle(few_shot_pairs(counts, vocab, per_class, per_true))
    wrong = label_pairs(wrong_rows(predictions, labels), labels, by=keys)
    hits = join_groups(wrong, pairs, ["label_name", "true_id", "pred_id"])
    h = order_hash(keys, seed)
    w = Window.partitionBy("label_name", "true_id", "pred_id").orderBy(h, *keys)
    chosen = settle(hits.withColumn("row_rank", F.row_number().over(w)).where(F.col("row_rank") <= per_pred).select(
        *keys, "label_name", "true_name", "pred_name", "true_rank", "pred_rank", "row_rank"))
    return join_groups(predictions.select(*keys, "text", "actual"), chosen, keys)


def few_shot_text(examples: DataFrame, vocab: dict[str, list[str]] | DataFrame, labels=None) -> DataFrame:
    """The examples as one numbered text for a prompt, which ends with an open question; without examples it is empty.

    With one label the answer is its class name, with several a JSON object of all of them. The text
    has ``labels * per_class * per_true * per_pred`` examples at most, as asked for when mining.
    """
    labels = _labels_of(vocab, labels)
    examples = with_names(examples, vocab, {f"_n{i}": (c, F.col("actual").getField(c)) for i, c in enumerate(labels)})
    if len(labels) == 1:
        answer = F.col("_n0")
    else:
        parts = []
        for i, label in enumerate(labels):
            parts += [F.lit(", " if i else "{"), quoted_ascii(F.lit(label)), F.lit(": "), quoted_ascii(F.col(f"_n{i}"))]
        answer = F.concat(*parts, F.lit("}"))
    block = F.concat(F.lit("text: "), F.col("text"), F.lit("\ncorrect result: "), answer)
    position = F.array_position(F.lit(labels), F.col("label_name"))
    entry = F.struct(position.alias("label"), "true_rank", "pred_rank", "row_rank", block.alias("block"))
    number = lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(" - "), e["block"])
    blocks = F.transform(F.array_sort(F.collect_list(entry)), number)
    text = F.array_join(blocks, "\n\n")
    return examples.agg(F.when(text != "", F.concat(text, F.lit(OPEN_QUESTION))).otherwise("").alias("examples"))
