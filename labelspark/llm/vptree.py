"""Nearest neighbours by vantage-point trees, one tree per shard of the vectors.

A node splits its vectors at the median distance from a vantage point and remembers how far its two
halves reach. A query skips a half when the triangle inequality says that nothing in it can be nearer
than the neighbours found so far: the least possible distance, times ``factor``, exceeds the worst of
them. With ``factor`` one that is exact; above one more is skipped and neighbours may be missed.
Queries walk a tree together, in arrays. Shards and blocks of queries have bounded sizes, and only a
shard's nearest ``k`` for each query leave it.

Vectors that are null, empty, zero, or that hold null or non-finite components take no part, nor do
rows without an id. Vectors meet only vectors of the same length. Of rows that repeat a query's id the
smallest vector is the query, and none of them is a candidate for it; other repeated rows are all
candidates. Ties go to the smaller id. Empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FACTOR = 1.0
# Vectors in a shard and queries in a block, on average; vectors in a leaf; queries compared at once.
SHARD_ROWS = 16_384
BLOCK_ROWS = 16_384
LEAF = 64
TOGETHER = 512
SEED = 5


class Tree:
    """A vantage-point tree over the rows of ``points``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = SEED):
        self.points, self.leaf = points, leaf
        draw = np.random.default_rng(seed)
        self.nodes: list[tuple] = []

        def build(rows: np.ndarray) -> int:
            own = len(self.nodes)
            self.nodes.append((rows,))
            if len(rows) > leaf:
                vantage = int(rows[draw.integers(len(rows))])
                away = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(axis=1))
                half = len(rows) // 2
                order = np.argpartition(away, half)
                inner, outer = order[:half], order[half:]
                reach = (away[inner].max(), away[outer].min(), away[outer].max())
                self.nodes[own] = (vantage, reach, build(rows[inner]), build(rows[outer]))
            return own

        if len(points):
            build(np.arange(len(points)))

    def nearest(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float = FACTOR):
        """Distances and row numbers of the ``k`` nearest of each query but those with its own id; -1: none."""
        best = np.full((len(queries), k), np.inf)
        rows = np.full((len(queries), k), -1)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)

        def visit(node: int, active: np.ndarray) -> None:
            if len(self.nodes[node]) == 1:
                members = self.nodes[node][0]
                for first in range(0, len(active), TOGETHER):
                    part = active[first:first + TOGETHER]
                    far = np.sqrt(((queries[part, None, :] - self.points[None, members, :]) ** 2).sum(axis=2))
                    far = np.where(ids[members][None, :] == own[part, None], np.inf, far)
                    every = np.concatenate([best[part], far], axis=1)
                    named = np.concatenate([names[part], np.broadcast_to(ids[members], far.shape)], axis=1)
                    which = np.concatenate([rows[part], np.broadcast_to(members, far.shape)], axis=1)
                    order = np.lexsort((named, every), axis=-1)[:, :k]
                    line = np.arange(len(part))[:, None]
                    best[part], names[part], rows[part] = every[line, order], named[line, order], which[line, order]
                return
            vantage, (inner_to, outer_from, outer_to), inner, outer = self.nodes[node]
            away = np.sqrt(((queries[active] - self.points[vantage]) ** 2).sum(axis=1))
            to_inner = away - inner_to
            to_outer = np.maximum(outer_from - away, away - outer_to)
            first_inner = to_inner <= to_outer
            # each half is visited by those it is nearer to, then by the others as far as they must
            for half, least, first in ((inner, to_inner, first_inner), (outer, to_outer, ~first_inner),
                                       (outer, to_outer, first_inner), (inner, to_inner, ~first_inner)):
                slack = 1e-9 * (1 + away)
                needed = first & ((least - slack) * factor <= best[active, k - 1])
                if needed.any():
                    visit(half, active[needed])

        if len(queries) and len(self.points):
            visit(0, np.arange(len(queries)))
        return np.where(np.isinf(best), np.inf, best), np.where(np.isinf(best), -1, rows)


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(values or [np.empty(0)]).astype(np.float64).reshape(-1, width)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id",
           vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest of all ``vectors`` for each of ``queries``,
    by Euclidean distance in double precision."""

    def prepared(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))

    rows = prepared(vectors)
    asked = prepared(queries).groupBy("id").agg(F.min("v").alias("v"))
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    draw = F.xxhash64(F.lit(SEED), "id", "v")
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = rows.select(
        F.size("v").alias("width"), F.pmod(draw, F.lit(shards)).alias("shard"),
        F.explode(numbers(blocks)).alias("block"), "id", "v")
    right = asked.select(
        F.size("v").alias("width"), F.explode(numbers(shards)).alias("shard"),
        F.pmod(draw, F.lit(blocks)).alias("block"), "id", "v")

    def meet(key, mine, asking):
        width = key[0].as_py()
        mine = mine.sort_by("id")
        points, ids = _matrix(mine["v"], width), mine["id"].to_numpy()
        wanted, own = _matrix(asking["v"], width), asking["id"].to_numpy()
        _, found = Tree(points).nearest(wanted, own, ids, k, factor)
        query, place = np.nonzero(found >= 0)
        row = found[query, place]
        # added up in order of the components, so the value doesn't depend on the tree
        score = np.sqrt(np.cumsum((wanted[query] - points[row]) ** 2, axis=1)[:, -1]) if len(row) else np.empty(0)
        return pa.table({"query_id": own[query], "id": ids[row], "score": score})

    keys = ["width", "shard", "block"]
    near = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(meet, "query_id bigint, id bigint, score double")
    order = W.partitionBy("query_id").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")
