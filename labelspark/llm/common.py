"""Helpers that several operators of this folder share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.session import checkpointed

# A word of the contracts: a run of anything but a blank and 0x09 to 0x0D. On bytes, split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of every text; a null text is empty."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Every text; a null text is empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def seeded_share(df: DataFrame, draw: str, rows: int) -> DataFrame:
    """All rows, or of a larger table those with the smallest draws, ``rows`` of them on average.

    The share is taken where the rows lie; nothing is sorted or sent to the driver for it.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.col(draw), F.lit(1 << 40)) < int((1 << 40) * rows / total))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its smallest node.

    Nodes are not null. Stars are contracted in turns: every node hands its larger neighbours, then
    its smaller ones, over to the smallest. Both are joins on a pre-aggregated minimum, so no list of
    neighbours is ever gathered, and a node with very many links is a skewed join side that adaptive
    execution splits. Each round is written, so it survives lost executors. The number of rounds
    grows with the logarithm of the longest chain. An empty input gives an empty result.
    """
    links = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select("v", "v").distinct()
            )
        before = tuple(state)
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        links = checkpointed(small)
