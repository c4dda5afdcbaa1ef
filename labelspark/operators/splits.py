"""Train/test splits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.operators.ordering import between_ranks, mark_first, order_hash
from labelspark.session import as_list

TRAIN, TEST = "train", "test"


def _named(df: DataFrame, flag: str, yes: str, no: str, into: str) -> DataFrame:
    return df.withColumn(into, F.when(F.col(flag), yes).otherwise(no)).drop(flag)


def random_split(df: DataFrame, test_size: float, keys=None, seed: int = 42, into: str = "split") -> DataFrame:
    """Exact random split: ``ceil(rows * test_size)`` rows go to the test split.

    A test size above 1 is a number of rows.
    """
    if test_size <= 0:
        raise ValueError("test_size must be > 0")

    def quota(rows):
        return F.lit(int(test_size)) if test_size > 1 else F.ceil(rows * F.lit(float(test_size)))

    return _named(mark_first(df, quota, keys, seed, (), "_test"), "_test", TEST, TRAIN, into)


def hash_split(df: DataFrame, test_size: float, keys, seed: int = 42, into: str = "split") -> DataFrame:
    """One-pass split of expected size: rows never change side when others are added."""
    # "g" lies beyond every hex digit.
    threshold = "g" if test_size >= 1 else format(int(test_size * 16**8), "08x")
    flag = F.substring(order_hash(as_list(keys), seed), 1, 8) < F.lit(threshold)
    return df.withColumn(into, F.when(flag, TEST).otherwise(TRAIN))


def positional_split(df: DataFrame, train_size: float, order, into: str = "split") -> DataFrame:
    """The first ``floor(rows * train_size)`` rows in the given order train, the rest test."""
    first = int(df.count() * train_size)
    return _named(between_ranks(df, order, 0, first, "_train"), "_train", TRAIN, TEST, into)


def shard(df: DataFrame, parts: int, index: int, order) -> DataFrame:
    """Contiguous part ``index`` of ``parts`` in the given order; the first parts may hold one more row."""
    if not 0 <= index < parts:
        raise ValueError("index must be in [0, parts)")
    each, extra = divmod(df.count(), parts)
    low = each * index + min(index, extra)
    high = low + each + (1 if index < extra else 0)
    return between_ranks(df, order, low, high, "_in").where("_in").drop("_in")


def one_split(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """The rows of a named split; on a table partitioned by it, only its files are read."""
    return df.where(F.col(f"`{split_col}`") == split)
