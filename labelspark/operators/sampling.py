"""Random samples and class balancing."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.operators.labels import class_counts
from labelspark.operators.ordering import global_rank, order_hash, take_first
from labelspark.session import Settled, as_list, join_groups, require_columns, settle


def check_sample_size(ratio: float | None, size: int | None) -> None:
    """Exactly one of ratio in (0, 1] and size > 0."""
    if (ratio is None) == (size is None):
        raise ValueError("a sample needs a ratio or a size, and not both")
    if ratio is not None and not 0 < ratio <= 1:
        raise ValueError(f"a ratio lies above 0 and at most at 1, not at {ratio}")
    if size is not None and size <= 0:
        raise ValueError(f"a sample has at least one row, not {size}")


def sample_rows(
    df: DataFrame,
    ratio: float | None = None,
    size: int | None = None,
    keys=None,
    seed: int = 42,
    split_col: str | None = None,
) -> DataFrame:
    """Random rows, a fraction or a number of them; on split data, of every split.

    A fraction gives ``max(floor(rows * ratio), 1)`` rows. A size beyond the table gives all.
    """
    check_sample_size(ratio, size)

    def quota(rows: Column) -> Column:
        if size is not None:
            return F.lit(size)
        return F.greatest(F.floor(rows * F.lit(float(ratio))), F.lit(1))

    return take_first(df, quota, keys, seed, as_list(split_col))


def sample_rows_approx(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """One-pass sample whose size is only expected to be ``rows * ratio``."""
    check_sample_size(ratio, None)
    return df.sample(fraction=ratio, seed=seed)


def shuffle_rank(df: DataFrame, keys, seed: int = 42, rank: str = "rank") -> DataFrame:
    """Seeded permutation: every row with its position in it."""
    ranked = global_rank(df.withColumn("_h", order_hash(keys, seed)), ["_h", *as_list(keys)], rank)
    return ranked.drop("_h")


def spread_pick(rank: Column, rows: Column, picks: Column) -> Column:
    """True at ``picks`` positions spread evenly from the first to the last of ``rows``.

    Position r is picked iff r = floor(k * (rows - 1) / (picks - 1)) for a whole k. Products of two
    row counts pass 64 bits, so they are decimals, divided as integers.
    """
    kind = "decimal(19,0)"
    r, span, steps = (c.cast(kind) for c in (rank, rows - 1, picks - 1))
    whole = lambda a, b: F.call_function("div", a, F.nullif(b, F.lit(0).cast(kind)))
    k = whole(r * steps + span - 1, span)
    hit = whole(k.cast(kind) * span, steps) == r
    return F.when(picks >= rows, True).when(picks <= 1, rank == 0).otherwise(hit)


def balance_classes(
    df: DataFrame,
    label_cols="label",
    ratio: float | None = None,
    size: int | None = None,
    samples_per_class: int | None = None,
    keys=None,
    seed: int = 0,
    split_col: str | None = None,
    shuffle: bool = True,
    order_cols=None,
) -> DataFrame:
    """The same number of rows for every class of the first label.

    The number is given directly, or follows from a fraction or a total size divided by the
    classes of all labels, and is cut to the rarest class. ``shuffle`` picks rows at random;
    otherwise rows are picked evenly spread over the order of ``order_cols``. With several
    labels, rows of one class are spread over the order of the further labels. On split data
    every split is balanced on its own.
    """
    labels, splits = as_list(label_cols), as_list(split_col)
    require_columns(df, [*labels, *splits, *as_list(keys), *as_list(order_cols)])
    if ratio is not None and size is not None:
        raise ValueError("give only one of ratio and size")
    if samples_per_class is None:
        if ratio is None and size is None:
            raise ValueError("give ratio, size or samples_per_class")
        if ratio is not None and ratio <= 0:
            raise ValueError("ratio must be > 0")
        if size is not None and size <= 0:
            raise ValueError("size must be > 0")
    if not shuffle and not as_list(order_cols):
        raise ValueError("without shuffle, order_cols must give the row order")

    known = df.where(F.col(f"`{labels[0]}`").isNotNull())
    plan = _picks_per_class(known, labels, splits, ratio, size, samples_per_class)
    within = [*splits, labels[0]]
    if shuffle and len(labels) == 1:
        return take_first(known, plan, keys, seed, within)

    names = as_list(keys) if shuffle else as_list(order_cols)
    columns = list(dict.fromkeys([*within, *labels[1:], *(names or df.columns)]))
    if set(df.columns) - set(columns):
        # Rank the keys alone and fetch the picked rows, provided their keys tell rows apart.
        narrow = known.select(*_cols(columns))
        picked, ranked = _spread_picks(narrow, plan, within, splits, labels, names, shuffle, seed)
        picked = settle(picked)
        twins = _matching(ranked, picked, columns).groupBy(*_cols(columns)).count().where("count > 1")
        if twins.isEmpty():
            return _matching(known, picked, columns)
    picked, _ = _spread_picks(known, plan, within, splits, labels, names, shuffle, seed)
    return picked


def _cols(names) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _spread_picks(rows, plan, within, splits, labels, names, shuffle, seed) -> tuple[DataFrame, DataFrame]:
    """Rows spread evenly over the order within their class, and all rows with their ranks."""
    order = [*within, *labels[1:], *names]
    ordered = rows
    if shuffle:
        ordered = rows.withColumn("_order", order_hash(names or rows.columns, seed))
        order = [*within, *labels[1:], "_order", *names]
    ranked = global_rank(ordered, order, "_rank")
    classes = ranked.groupBy(*_cols(within)).agg(F.min("_rank").alias("_first"), F.count("*").alias("_rows"))
    classes = settle(join_groups(classes, plan, splits))
    hit = spread_pick(F.col("_rank") - F.col("_first"), F.col("_rows"), F.col("_picks"))
    return join_groups(ranked, classes, within).where(hit).select(*_cols(rows.columns)), ranked


def _matching(rows: DataFrame, picked: Settled, columns: list[str]) -> DataFrame:
    """The rows with a picked combination of the given columns, nulls included."""
    renamed = picked.df.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(columns)])
    condition = F.lit(True)
    for i, c in enumerate(columns):
        condition = condition & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    return rows.join(picked.side(renamed), condition, "left_semi")


def _picks_per_class(known, labels, splits, ratio, size, samples_per_class) -> Settled:
    """One row per split: the number of rows to pick from every class."""
    counts = class_counts(known, labels, by=splits)
    main = F.when(F.col("label_name") == labels[0], F.col("n"))
    plan = counts.groupBy(*splits).agg(
        F.sum(main).alias("_rows"), F.min(main).alias("_rarest"), F.count("*").alias("_classes")
    ).where(F.col("_rarest").isNotNull())
    if samples_per_class is not None:
        wanted = F.lit(samples_per_class)
    else:
        share = F.lit(float(size)) / F.col("_rows") if size is not None else F.lit(float(ratio))
        wanted = F.floor(F.col("_rows") / F.col("_classes") * F.least(share, F.lit(1.0)))
    wanted = F.greatest(wanted.cast("long"), F.lit(1))
    picks = settle(plan.select(*splits, F.least(wanted, "_rarest").alias("_picks"), (wanted > F.col("_rarest")).cast("int").alias("_over")))
    if picks.biggest("_over")[0]:
        warnings.warn(f"some class of {labels[0]} has fewer rows than asked for; every class is cut to the rarest")
    return Settled(picks.df.drop("_over"), picks.table)
