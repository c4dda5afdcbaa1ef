"""Mixing sources to target weights: a min-cost flow from documents to the quotas of their sources.

Documents may belong to several sources. They are aggregated by membership pattern (one row per
pattern reaches the driver, never one per document). A pattern can give each of its words up to
``REPEATS`` times, and each repetition costs more than the one before. The flow that fills the quotas
at least cost says how many words a pattern gives to each source. Within a pattern every document is
then taken equally often, and a seeded part of them once more: those whose hash is up to a cut, which
is found by counting the hash space in cells that get finer, so no group is ever sorted in one task.
What the document at the cut would overfill goes to later, smaller ones, in ``ROUNDS`` rounds.

Defined results: a null or empty text has size 0 and is never taken; a null source, or an empty or
null list of sources, is a source of its own, last in order; repeated rows (also rows without
an id that share a text) are numbered, each with a hash of its own, so a mix may take some of them;
a very long text is one document and is taken whole or not at all; an empty table gives an empty one. Only the id and the named results are returned by
:func:`mix_plan`; :func:`mixed` returns all columns, whatever their names.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from labelspark.llm.common import WORD
from labelspark.session import Settled, checkpointed, settle

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 11
ROUNDS = 3
# Patterns reach the driver, which finds the flow; a corpus with more is not mixed by named sources. Spark
# measures their tables and broadcasts only small ones.
MAX_PATTERNS = 100_000

_LONGS = pa.list_(pa.int64())
_PATTERN = ("pattern", pa.list_(pa.string()))
_FOUND = [_PATTERN, ("times", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("cuts", _LONGS), ("limits", _LONGS)]
_OPEN = [_PATTERN, *[(c, pa.int64()) for c in ("p", "limit", "rest", "last", "within")]]


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = REPEATS, total: int | None = None) -> list[float]:
    """Shares of all sizes by repeating weights; what exceeds ``most`` times a size is reshared by weight."""
    total = sum(sizes) if total is None else total
    found: list[float] = [0.0] * len(sizes)
    open_ = {i: weights[i % len(weights)] for i in range(len(sizes))}
    left = float(total)
    while open_:
        all_weights = sum(open_.values())
        full = [i for i, w in open_.items() if left * w / all_weights > most * sizes[i]]
        if not full:
            for i, w in open_.items():
                found[i] = left * w / all_weights
            return found
        for i in full:
            found[i] = float(most * sizes[i])
        for i in full:
            del open_[i]
        left = total - sum(found[i] for i in range(len(sizes)) if i not in open_)
    return found


def cheapest_flow(patterns: list[tuple[list[int], int]], quotas: list[int], most: int = REPEATS) -> list[dict[int, int]]:
    """Words that every pattern ``(sources, size)`` gives to its sources.

    Only the arcs into the patterns cost: the k-th repetition k - 1. A cheapest augmenting path starts
    with the cheapest arc that still reaches a quota, so the repetitions are opened one after another
    and each is filled by a maximum flow (Dinic's, with explicit stacks) before the next.
    """
    n, m = len(patterns), len(quotas)
    given: list[dict[int, int]] = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    arcs_p = [list(g) for g in given]
    of_source: list[list[int]] = [[] for _ in range(m)]
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            of_source[s].append(p)
    room = list(quotas)
    for _ in range(most):
        supply = [size for _, size in patterns]
        while True:
            # Levels from the patterns with supply; a source hands on to patterns that gave it words.
            level_p = [0 if x > 0 else -1 for x in supply]
            level_s = [-1] * m
            queue = deque(("p", p) for p in range(n) if level_p[p] == 0)
            reached = None
            while queue:
                kind, x = queue.popleft()
                if kind == "p":
                    for s in given[x]:
                        if level_s[s] < 0:
                            level_s[s] = level_p[x] + 1
                            if room[s] > 0 and reached is None:
                                reached = level_s[s]
                            queue.append(("s", s))
                elif reached is None or level_s[x] < reached:
                    for p in of_source[x]:
                        if level_p[p] < 0 and given[p][x] > 0:
                            level_p[p] = level_s[x] + 1
                            queue.append(("p", p))
            if reached is None:
                break
            # Where each one's arcs go on: an arc that led nowhere does so until the next levels.
            at_p, at_s = [0] * n, [0] * m
            for first in range(n):
                while supply[first] > 0:
                    path: list[int] = [first]  # patterns and sources in turns
                    while path:
                        at = path[-1]
                        if len(path) % 2:
                            arcs, i = arcs_p[at], at_p[at]
                            while i < len(arcs) and level_s[arcs[i]] != level_p[at] + 1:
                                i += 1
                            at_p[at] = i
                            if i == len(arcs):
                                path.pop()
                                if path:
                                    at_s[path[-1]] += 1
                                continue
                            step = arcs[i]
                            path.append(step)
                            if room[step] > 0:
                                break
                        else:
                            arcs, i = of_source[at], at_s[at]
                            while i < len(arcs) and (level_p[arcs[i]] != level_s[at] + 1 or given[arcs[i]][at] <= 0):
                                i += 1
                            at_s[at] = i
                            if i == len(arcs):
                                path.pop()
                                at_p[path[-1]] += 1
                                continue
                            path.append(arcs[i])
                    if not path:
                        break
                    amount = min(supply[first], room[path[-1]])
                    for i in range(2, len(path), 2):
                        amount = min(amount, given[path[i]][path[i - 1]])
                    supply[first] -= amount
                    room[path[-1]] -= amount
                    for i in range(0, len(path), 2):
                        given[path[i]][path[i + 1]] += amount
                        if i:
                            given[path[i]][path[i - 1]] -= amount
    return given


@dataclass(frozen=True)
class Plan:
    """What the flow decided; ``patterns`` has ``(pattern, times, source_size, target, cuts, limits)``."""

    patterns: DataFrame
    sized: DataFrame
    repeats: Settled
    sizes: list[int]
    targets: list[float]
    taken: list[int]


def _pattern(docs: DataFrame, sources_col: str) -> Column:
    column = F.col(sources_col)
    if isinstance(docs.schema[sources_col].dataType, T.ArrayType):
        named = F.array_distinct(F.coalesce(column, F.array().cast("array<string>")))
        return F.when(F.size(named) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(named))
    return F.array(column.cast("string"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(id_col: str, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), text)


def _numbered(rows: DataFrame, repeats: Settled) -> DataFrame:
    """``rows`` with draws of their own: those that share a ``_mix_draw`` are numbered from 0.

    They are numbered within the parts that they are read in, and the parts after one another, so rows that
    occur very often are never gathered in one task; rows that occur once are not moved for it.
    """
    if repeats.small and not repeats.table.num_rows:
        return rows
    alone = rows.join(repeats.side(), "_mix_draw", "left_anti")
    many = checkpointed(rows.join(repeats.side(), "_mix_draw", "left_semi").withColumn("_mix_part", F.spark_partition_id()))
    parts = many.groupBy("_mix_draw", "_mix_part").agg(F.count("*").alias("_mix_n"))
    before = F.sum("_mix_n").over(W.partitionBy("_mix_draw").orderBy("_mix_part").rowsBetween(W.unboundedPreceding, -1))
    parts = settle(parts.select("_mix_draw", "_mix_part", F.coalesce(before, F.lit(0)).alias("_mix_before")))
    place = F.row_number().over(W.partitionBy("_mix_draw", "_mix_part").orderBy(F.lit(0)))
    placed = many.withColumn("_mix_place", place).join(parts.side(), ["_mix_draw", "_mix_part"])
    own = F.xxhash64("_mix_draw", F.col("_mix_before") + F.col("_mix_place"))
    return alone.unionByName(placed.withColumn("_mix_draw", own).select(*[F.col(f"`{c}`") for c in rows.columns]))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> Plan:
    """The flow and the seeded selection for all documents."""
    text = F.col(text_col)
    sized = checkpointed(docs.select(
        F.col(id_col).alias("id"), _pattern(docs, sources_col).alias("pattern"), _size(text).alias("size"),
        _draw(id_col, text, seed).alias("_mix_draw"),
    ))
    repeats = settle(sized.groupBy("_mix_draw").count().where("count > 1").select("_mix_draw"))
    again = _numbered(sized, repeats)
    sized = (sized if again is sized else checkpointed(again)).withColumnRenamed("_mix_draw", "draw")
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows.sort(key=lambda r: [(s is None, s or "") for s in r.pattern])
    names = sorted({s for r in rows for s in r.pattern}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    members = [([number[s] for s in r.pattern], r.size) for r in rows]
    sizes = [0] * len(names)
    for sources, size in members:
        for s in sources:
            sizes[s] += size
    wanted = targets(sizes, weights, REPEATS, sum(size for _, size in members))
    given = cheapest_flow(members, [round(t) for t in wanted])
    taken = [sum(g.values()) for g in given]
    rest = [t % size if size else 0 for t, (_, size) in zip(taken, members, strict=True)]
    patterns, room = [list(r.pattern) for r in rows], rest
    cuts: list[list] = [[] for _ in rows]
    limits: list[list[int]] = [[] for _ in rows]
    for _ in range(ROUNDS):
        ends, used = _next_cut(sized, patterns, room, [c[-1] if c else None for c in cuts])
        for p, end in enumerate(ends):
            cuts[p].append(end)
            limits[p].append(room[p])
        room = [r - u for r, u in zip(room, used, strict=True)]
    data = [
        (pattern, t // size if size else 0, sizes[sources[0]], wanted[sources[0]], c, most)
        for pattern, (sources, size), t, c, most in zip(patterns, members, taken, cuts, limits, strict=True)
    ]
    found = _table(docs.sparkSession, _FOUND, data)
    return Plan(found, sized, repeats, sizes, wanted, taken)


def _table(spark: SparkSession, fields: list, rows: list[tuple]) -> DataFrame:
    """Rows of the driver, one a pattern, as a table whose size Spark knows."""
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields]))


def _next_cut(sized: DataFrame, patterns: list[list], room: list[int], last: list) -> tuple[list, list[int]]:
    """One more cut of every pattern, and the words it takes: documents beyond the ``last`` cut that fit into the
    ``room`` are taken in order of their draws while they fit. The first that doesn't ends the round.

    Each pass counts the cells within the one that holds the cut. What it finds is one row a pattern; the driver keeps it
    and hands it to the next pass as one table, so a pass is one scan and one join.
    """
    in_order = W.partitionBy("p").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    ends, used = list(last), [0] * len(patterns)
    within: dict[int, int | None] = {p: None for p, r in enumerate(room) if r > 0}
    before = None
    for shift in (56, 48, 40, 0):
        if not within:
            break
        state = _table(sized.sparkSession, _OPEN, [(patterns[p], p, room[p], room[p] - used[p], last[p], c) for p, c in within.items()])
        open_ = sized.where("size > 0").join(state, "pattern").where("size <= limit and (last is null or draw > last)")
        if before is not None:
            open_ = open_.where(F.shiftright("draw", before) == F.col("within"))
        cells = open_.groupBy("p", F.shiftright("draw", shift).alias("cell")).agg(
            F.sum("size").alias("words"), F.max("draw").alias("end"), F.max("rest").alias("rest"))
        cells = cells.withColumn("upto", F.coalesce(F.sum("words").over(in_order), F.lit(0)) + F.col("words"))
        # of a pattern: where its whole cells end, what they take, and the cell that holds the cut
        whole = F.col("upto") <= F.col("rest")
        found = cells.groupBy("p").agg(
            F.max(F.when(whole, F.col("end"))).alias("end"), F.coalesce(F.max(F.when(whole, F.col("upto"))), F.lit(0)).alias("used"),
            F.min(F.when(~whole, F.col("cell"))).alias("cell")).collect()
        for r in found:
            ends[r.p] = ends[r.p] if r.end is None else r.end
            used[r.p] += r.used
        within, before = {r.p: r.cell for r in found if r.cell is not None}, shift
    return ends, used


def _taken(times: Column, cuts: Column, limits: Column, draw: Column, size: Column) -> Column:
    """How often a document is taken: as often as its pattern as a whole, and once more within a cut."""
    again = F.lit(False)
    for i in range(ROUNDS):
        beyond = F.lit(True) if i == 0 else F.coalesce(draw > cuts[i - 1], F.lit(True))
        again = again | (beyond & F.coalesce(draw <= cuts[i], F.lit(False)) & (size <= limits[i]))
    return F.when(size > 0, times + F.when(again, 1).otherwise(0)).otherwise(0)


def mix_counts(plan: Plan) -> DataFrame:
    """``(id, size, source_size, target, taken)`` of every row; size and target are those of the first
    source of the row's pattern, ``taken`` counts words with their repeats."""
    rows = plan.sized.join(plan.patterns, "pattern")
    times = _taken(F.col("times"), F.col("cuts"), F.col("limits"), F.col("draw"), F.col("size"))
    return rows.select("id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source",
          seed: int = SEED) -> DataFrame:
    """The mix: every document as often as it is taken, with all its columns."""
    names = {c: f"_mix_{c}" for c in ("pattern", "times", "cuts", "limits")}
    chosen = plan.patterns.select(*[F.col(c).alias(n) for c, n in names.items()])
    text = F.col(text_col)
    rows = _numbered(docs.withColumn("_mix_draw", _draw(id_col, text, seed)), plan.repeats)
    rows = rows.withColumn("_mix_docs_pattern", _pattern(docs, sources_col)).join(
        chosen, F.col("_mix_docs_pattern") == F.col("_mix_pattern")
    )
    times = _taken(F.col("_mix_times"), F.col("_mix_cuts"), F.col("_mix_limits"), F.col("_mix_draw"), _size(text)).cast("int")
    return rows.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
