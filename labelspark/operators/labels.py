"""Class labels: cleaning, vocabularies, counts, selection, encoding."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.functions.answers import UNKNOWN
from labelspark.functions.text import strip
from labelspark.operators.ordering import find_cuts, global_rank
from labelspark.session import Settled, as_list, checkpointed, require_columns, settle, settle_if_small, small_rows

# Class lists up to this length become an IN predicate, which reaches the file scan.
IN_LIST = 1_000


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def strip_labels(df: DataFrame, label_cols) -> DataFrame:
    """Strip Unicode whitespace from string labels; other types stay as they are."""
    text = [c for c in as_list(label_cols) if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: strip(_c(c)) for c in text})


def drop_null_rows(df: DataFrame, text_cols, label_cols) -> DataFrame:
    """Keep rows with a value in every text and label column."""
    return df.dropna(how="any", subset=[*as_list(text_cols), *as_list(label_cols)])


def select_text_labels(df: DataFrame, text_cols, label_cols, extra=()) -> DataFrame:
    """Text columns first, then labels; a missing column is named before any job starts."""
    columns = [*as_list(text_cols), *as_list(label_cols), *as_list(extra)]
    require_columns(df, columns)
    return df.select(*[_c(c) for c in columns])


def class_counts(df: DataFrame, label_cols, by=()) -> DataFrame:
    """Rows per class of every label in one scan: ``(by…, label_name, class_name, n)``.

    Null is no class. Counts are combined before the shuffle, so a frequent class costs one row
    per task.
    """
    labels, by = as_list(label_cols), as_list(by)
    if len(labels) == 1:
        rows = df.select(*[_c(c) for c in by], F.lit(labels[0]).alias("label_name"),
                         _c(labels[0]).cast("string").alias("class_name"))
    else:
        pairs = F.array(*[
            F.struct(F.lit(c).alias("label_name"), _c(c).cast("string").alias("class_name")) for c in labels
        ])
        rows = df.select(*[_c(c) for c in by], F.inline(pairs))
    keys = [*[_c(c) for c in by], F.col("label_name"), F.col("class_name")]
    return rows.where(F.col("class_name").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_classes(df: DataFrame, label_cols) -> DataFrame:
    """Number of classes of every label."""
    return class_counts(df, label_cols).groupBy("label_name").agg(F.count("*").alias("n_classes"))


def minority_class_size(df: DataFrame, label_cols) -> DataFrame:
    """Rows of the rarest class of every label."""
    return class_counts(df, label_cols).groupBy("label_name").agg(F.min("n").alias("n_rarest"))


def split_sizes(df: DataFrame, split_col: str) -> DataFrame:
    """Rows per split."""
    return df.groupBy(_c(split_col)).agg(F.count("*").alias("n"))


def label_histogram(df: DataFrame, label_col: str, more_than: int = 0, top: int | None = None) -> DataFrame:
    """Class counts above a threshold, optionally the ``top`` largest (ties by name)."""
    counts = class_counts(df, label_col).where(F.col("n") > more_than).select("class_name", "n")
    if top is None:
        return counts
    return counts.orderBy(F.desc("n"), F.asc("class_name")).limit(top)


def total_vs_balanced(df: DataFrame, label_col: str, top: int = 10) -> DataFrame:
    """The largest classes, each with the size it would have after balancing."""
    largest = label_histogram(df, label_col, top=top)
    return largest.withColumn("balanced", F.min("n").over(Window.partitionBy()))


def label_vocabulary(df: DataFrame, label_cols, strip_names: bool = True) -> DataFrame:
    """Sorted distinct class names with dense ids: ``(label_name, class_id, class_name)``.

    One vocabulary serves all splits of a dataset.
    """
    labels = as_list(label_cols)
    names = class_counts(strip_labels(df, labels) if strip_names else df, labels).select(
        "label_name", "class_name")
    settled = settle(names)
    if settled.small:
        w = Window.partitionBy("label_name").orderBy("class_name")
        numbered = settled.df.withColumn("class_id", F.row_number().over(w) - 1)
    else:
        ranked = global_rank(settled.df, ["label_name", "class_name"], "_rank")
        first = settle(ranked.groupBy("label_name").agg(F.min("_rank").alias("_first")))
        numbered = ranked.join(first.side(), "label_name").withColumn(
            "class_id", (F.col("_rank") - F.col("_first")).cast("int"))
    return numbered.select("label_name", "class_id", "class_name")


def add_unknown(vocab: DataFrame, name: str = UNKNOWN) -> DataFrame:
    """The vocabulary with one more class at the end of every label, for answers that name none."""
    last = vocab.groupBy("label_name").agg((F.max("class_id") + 1).alias("class_id"), F.lit(name).alias("class_name"))
    return vocab.unionByName(last)


def vocabulary_lists(vocab: DataFrame, label_cols) -> dict[str, list[str]]:
    """A vocabulary as driver-side lists, for prompts and answer parsing; size-checked."""
    table = small_rows(vocab, max_rows=100_000)
    if table is None:
        raise ValueError("the vocabulary is too large for a prompt or an answer parser")
    rows = sorted((r["label_name"], r["class_id"], r["class_name"]) for r in table.to_pylist())
    return {label: [n for name, _, n in rows if name == label] for label in as_list(label_cols)}


def encode_classes(df: DataFrame, label_cols, vocab: DataFrame | None = None) -> DataFrame:
    """Replace class names by ids; null stays null."""
    labels = as_list(label_cols)
    classes = settle(label_vocabulary(df, labels, strip_names=False) if vocab is None else vocab)
    out = df
    for label in labels:
        own = classes.df.where(F.col("label_name") == label).select(
            F.col("class_name").alias("_name"), F.col("class_id").alias("_id"))
        out = out.join(classes.side(own), _c(label).cast("string") == F.col("_name"), "left")
        out = out.withColumn(label, F.col("_id")).drop("_name", "_id")
    return out


def decode_classes(df: DataFrame, label_cols, vocab: DataFrame, strip_names: bool = True) -> DataFrame:
    """Replace class ids by names; null stays null."""
    classes = settle(vocab)
    out = df
    for label in as_list(label_cols):
        name = strip(F.col("class_name")) if strip_names else F.col("class_name")
        own = classes.df.where(F.col("label_name") == label).select(
            name.alias("_name"), F.col("class_id").alias("_id"))
        out = out.join(classes.side(own), _c(label) == F.col("_id"), "left")
        out = out.withColumn(label, F.col("_name")).drop("_name", "_id")
    return out


def labelled_dataset(df: DataFrame, text_cols, label_cols, drop_nulls: bool = True, extra=()) -> DataFrame:
    """Table to labelled dataset: strip labels, drop incomplete rows, keep text and labels."""
    out = strip_labels(select_text_labels(df, text_cols, label_cols, extra), label_cols)
    return drop_null_rows(out, text_cols, label_cols) if drop_nulls else out


def filter_classes(df: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """Rows whose class is listed, for every label given."""
    out = df
    for label, names in classes.items():
        if len(names) <= IN_LIST:
            out = out.where(_c(label).isin(names))
        else:
            listed = settle(df.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "_name string"))
            out = out.join(listed.side(), _c(label) == F.col("_name"), "left_semi")
    return out


def _most_frequent(counts: DataFrame, labels: list[str], n: int) -> DataFrame:
    """The ``n`` largest classes of every label (ties by name).

    Up to the planner's limit on group sizes a window is cut before its shuffle. Beyond it, the smallest count that is
    still among the largest is found in a histogram of the counts, and of the classes with that count the last name.
    """
    if n <= IN_LIST:
        w = Window.partitionBy("label_name").orderBy(F.desc("n"), F.asc("class_name"))
        return counts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
    counts = checkpointed(counts)
    # As many rows as counts differ: at most the square root of twice the rows.
    histogram = counts.groupBy("label_name", F.col("n").alias("_cut")).agg(F.count("*").alias("_ties"))
    upto = F.sum("_ties").over(Window.partitionBy("label_name").orderBy(F.desc("_cut")))
    cuts = histogram.withColumn("_need", F.lit(n) - upto + F.col("_ties")).where("_need > 0 and _need <= _ties").collect()
    at = {r["label_name"]: r for r in cuts}
    kept = F.lit(False)
    for label in labels:
        own, found = F.col("label_name") == label, at.get(label)
        if found is None:
            kept = kept | own
            continue
        last = F.lit(True)
        if found["_need"] < found["_ties"]:
            names = counts.where(own & (F.col("n") == found["_cut"])).select("class_name")
            (cut,) = find_cuts(names, "class_name", [found["_need"]])
            last = F.struct("class_name") < cut.literal(names.schema)
        kept = kept | (own & ((F.col("n") > found["_cut"]) | ((F.col("n") == found["_cut"]) & last)))
    return counts.where(kept)


def _keep_ranked(df: DataFrame, chosen: Settled, label: str) -> DataFrame:
    own = chosen.df.where(F.col("label_name") == label).select(F.col("class_name").alias("_name"))
    return df.join(chosen.side(own), _c(label).cast("string") == F.col("_name"), "left_semi")


def top_n_classes(
    df: DataFrame,
    n: int = 10,
    label_cols="label",
    classes: dict[str, list[str]] | None = None,
    split_col: str | None = None,
    main_split: str = "train",
) -> DataFrame:
    """Rows of the ``n`` most frequent classes of every label (ties by name).

    Classes are ranked on the main split, on all its rows, for each label alone; a row stays if
    it is in the chosen classes of all labels. ``n`` is cut to the label with fewest classes.
    """
    labels = as_list(label_cols)
    require_columns(df, [*labels, *as_list(split_col)])
    if classes is not None:
        return filter_classes(df, {c: classes[c] for c in labels})
    main = df.where(_c(split_col) == main_split) if split_col else df
    n = max(n, 1)
    # The first n of every label also tell how many classes the shortest label has.
    chosen = settle(_most_frequent(class_counts(main, labels), labels, n))
    fewest = chosen.df.groupBy("label_name").count().agg(F.min("count").alias("least")).first().least
    if fewest is not None and fewest < n:
        warnings.warn(f"only {fewest} classes in some label, using {fewest} instead of {n}")
        n = fewest
        kept = _most_frequent(chosen.df, labels, n)
    else:
        kept = chosen.df
    if chosen.small and n <= IN_LIST:
        rows = kept.select("label_name", "class_name").collect()
        lists = {c: [r.class_name for r in rows if r.label_name == c] for c in labels}
        out = df
        for label, names in lists.items():
            out = out.where(_c(label).cast("string").isin(names))
        return out
    out = df
    for label in labels:
        out = _keep_ranked(out, Settled(kept, chosen.table), label)
    return out


def drop_rare_classes(df: DataFrame, label_cols, max_rare: int = 50) -> DataFrame:
    """Drop classes of at most ``max_rare`` rows, label after label; rows without a class stay.

    Removing whole classes leaves the other classes of that label as they were, so one pass per
    label is enough.
    """
    out = df
    for label in as_list(label_cols):
        counts = class_counts(out, label)
        name = F.col("class_name").alias("_name")
        same = _c(label).cast("string") == F.col("_name")
        rare = settle_if_small(counts.where(F.col("n") <= max_rare).select(name))
        if rare is not None:
            out = out.join(rare.side(), same, "left_anti")
        else:
            # A long tail of rare classes: look up the frequent ones instead.
            kept = settle(counts.where(F.col("n") > max_rare).select(name))
            out = out.join(kept.side(), same, "left").where(_c(label).isNull() | F.col("_name").isNotNull()).drop("_name")
    return out


def head_rows(df: DataFrame, columns, order, n: int = 5) -> DataFrame:
    """The first rows of a few columns in a stated order."""
    return df.select(*[_c(c) for c in as_list(columns)]).orderBy(*[_c(c) for c in as_list(order)]).limit(n)


def sort_by_labels(df: DataFrame, label_cols, keys=()) -> DataFrame:
    """Rows in label order, for output."""
    return df.orderBy(*[_c(c) for c in [*as_list(label_cols), *as_list(keys)]])
