"""Reproducible random order, exact "first n" and exact ranks without a one-task sort.

Spark rows have no position, so every operator here takes key columns. A random order is the
order of ``md5(seed:keys)``: the same for every partitioning, file layout and engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.session import Settled, as_list, checkpointed, join_groups, settle

HASH_DIGITS = 32
# First split of the hash space: 16**3 cells per group.
CELL_DIGITS = 3
# A boundary cell up to this size is resolved hash by hash, a larger one is split again.
CELL_ROWS = 200_000
# Identical copies are spread out again in blocks of this many rows.
COPY_BLOCK = 100_000

# Keys sampled for the bounds of a round, bounds, and rows of a range whose keys are listed.
SAMPLED_KEYS = 1_008
BOUNDS = 63
COUNTED_ROWS = 4_096
# Steps of the sketch that proposes bounds around a quantile.
QUANTILE_STEPS = 128

_POSITION_BITS = 33


def order_hash(keys, seed: int = 0) -> Column:
    """Hex digest that puts rows in a seeded random order."""
    parts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in as_list(keys)]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def mark_first(
    df: DataFrame,
    quota: Callable[[Column], Column] | Settled,
    keys=None,
    seed: int = 0,
    within=(),
    flag: str = "is_first",
) -> DataFrame:
    """Flag the first rows of each group ``within`` in seeded hash order, exactly.

    ``quota`` turns the size of a group into the number of rows to flag, or is a table of some
    of the group columns and ``_picks``. Instead of sorting the
    rows, the hash value of the last flagged row is found by counting: the hash space is cut into
    cells, the cells are counted (pre-aggregated before the shuffle), and only the cell holding
    the boundary is looked into. These passes read the group and key columns alone; the rows
    themselves are then filtered in place with no shuffle, so a group holding most rows costs
    no more than any other.

    Without ``keys`` the whole row is hashed. Equal keys are told apart by the whole row, and
    identical rows by number, so the quota is met exactly in every case.
    """
    within = as_list(within)
    names = as_list(keys) or df.columns
    hashed = df.withColumn("_h", order_hash(names, seed))
    cells = _cells(hashed.select(*_cols(within), "_h"), within, CELL_DIGITS)
    cells = cells.withColumn("_size", F.sum("_n").over(Window.partitionBy(*_cols(within))))
    if isinstance(quota, Settled):
        cells = join_groups(cells, quota, [c for c in quota.df.columns if c != "_picks"])
        picks = F.col("_picks")
    else:
        picks = quota(F.col("_size"))
    cells = cells.withColumn("_quota", F.least(picks.cast("long"), "_size"))
    start = settle(_boundary(cells, within))
    return _flag(hashed, df.columns, start, within, seed, flag, level=0 if as_list(keys) else 1)


def take_first(df: DataFrame, quota, keys=None, seed: int = 0, within=()) -> DataFrame:
    """Only the rows that ``mark_first`` flags."""
    return mark_first(df, quota, keys, seed, within, "_first").where("_first").drop("_first")


def _cols(names) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _cells(narrow: DataFrame, within: list[str], digits: int) -> DataFrame:
    cell = F.substring("_h", 1, digits).alias("_cell")
    return narrow.groupBy(*_cols(within), cell).agg(F.count("*").alias("_n"))


def _boundary(cells: DataFrame, within: list[str]) -> DataFrame:
    """Per group the cell in which the quota is met, and how many of its rows are needed.

    A group whose quota is zero has no such cell.
    """
    w = Window.partitionBy(*_cols(within)).orderBy("_cell")
    before = F.sum("_n").over(w) - F.col("_n")
    return (
        cells.withColumn("_before", before)
        .where((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_n")))
        .select(*_cols(within), F.col("_cell").alias("_cut"), F.col("_n").alias("_held"),
                (F.col("_quota") - F.col("_before")).alias("_need"))
        .withColumn("_spare", F.col("_held") - F.col("_need"))
    )


def _flag(hashed, columns, cut: Settled, within, seed, flag, level) -> DataFrame:
    digits = CELL_DIGITS
    narrow = hashed.select(*_cols(within), "_h")
    while True:
        held, spare = cut.biggest("_held", "_spare")
        if not spare or digits == HASH_DIGITS:
            break
        finer = HASH_DIGITS if held <= CELL_ROWS else digits + CELL_DIGITS
        finer = min(finer, HASH_DIGITS)
        inside = join_groups(narrow, cut, within).where(F.substring("_h", 1, digits) == F.col("_cut"))
        cells = inside.groupBy(*_cols(within), F.substring("_h", 1, finer).alias("_cell")).agg(
            F.count("*").alias("_n"), F.first("_need").alias("_quota"))
        cut, digits = settle(_boundary(cells, within)), finer
    marked = join_groups(hashed, cut, within, "left")
    prefix = F.substring("_h", 1, digits)
    at_or_before = F.coalesce(prefix <= F.col("_cut"), F.lit(False))
    if not spare:
        return marked.select(*_cols(columns), at_or_before.alias(flag))

    # Rows with the same hash as the last flagged one, of which only some are wanted.
    tied = F.coalesce((prefix == F.col("_cut")) & (F.col("_spare") > 0), F.lit(False))
    clear = marked.where(~tied).select(*_cols(columns), at_or_before.alias(flag))
    ties = marked.where(tied)
    if level == 0:
        again = ties.withColumn("_h", order_hash(columns, seed))
        cells = again.groupBy(*_cols(within), F.substring("_h", 1, CELL_DIGITS).alias("_cell")).agg(
            F.count("*").alias("_n"), F.first("_need").alias("_quota"))
        start = settle(_boundary(cells, within))
        again = again.select(*_cols(columns), "_h")
        resolved = _flag(again, columns, start, within, seed, flag, level=1)
    else:
        resolved = _number_copies(ties, columns, flag)
    return clear.unionByName(resolved)


def _number_copies(ties: DataFrame, columns, flag: str) -> DataFrame:
    """Flag ``_need`` of each set of identical rows.

    Copies collapse to one counted row before the shuffle and are written out again in blocks,
    so no task holds them all.
    """
    counted = ties.groupBy(*_cols(columns), "_need").agg(F.count("*").alias("_copies"))
    blocks = counted.withColumn(
        "_from", F.explode(F.sequence(F.lit(1), F.col("_copies"), F.lit(COPY_BLOCK)))
    ).withColumn("_row", F.xxhash64(*_cols(columns)))
    # By group and block, and in a stated number of parts: counted rows look small to the planner.
    parts = int(ties.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, "_row", "_from")
    last = F.least(F.col("_from") + COPY_BLOCK - 1, F.col("_copies"))
    numbered = blocks.withColumn("_i", F.explode(F.sequence(F.col("_from"), last)))
    return numbered.select(*_cols(columns), (F.col("_i") <= F.col("_need")).alias(flag))


def global_rank(df: DataFrame, order, rank: str = "rank") -> DataFrame:
    """Add the exact 0-based position of every row in the order of the given columns.

    The rows are range-partitioned and sorted once; each row keeps its place inside its
    partition, and the sizes of the partitions (one number each) give the offsets. Ties are
    spread by a hash of the row and then by number, so a key shared by many rows does not end
    in one partition. The sorted rows are checkpointed: both passes must see the same places.
    """
    order = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in as_list(order)]
    tie = [F.col("_row"), F.col("_copy")]
    spread = df.withColumn("_row", F.xxhash64(*_cols(df.columns))).withColumn(
        "_copy", F.monotonically_increasing_id()
    )
    placed = checkpointed(
        spread.repartitionByRange(*order, *tie)
        .sortWithinPartitions(*order, *tie)
        .drop("_row", "_copy")
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", _POSITION_BITS))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = settle(sizes.select("_part", before.alias("_offset")))
    place = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return placed.join(offsets.side(), "_part").select(*_cols(df.columns), (F.col("_offset") + place).alias(rank))


def _portable(name: str, kind: T.DataType) -> Column:
    """A value in a form that the driver holds and :func:`_restored` gives back unchanged.

    The text of an instant depends on the session's zone and is not unique when clocks go back, so
    instants travel as microseconds; bytes travel as digits.
    """
    c = F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    return F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _restored(text: str | None, kind: T.DataType) -> str:
    """The value as an SQL expression of constants."""
    if text is None:
        return f"cast(null as {kind.simpleString()})"
    value = f"cast(unhex('{text.encode().hex()}') as string)"
    if isinstance(kind, T.TimestampType):
        return f"timestamp_micros(cast({value} as bigint))"
    return f"unhex({value})" if isinstance(kind, T.BinaryType) else f"cast({value} as {kind.simpleString()})"


@dataclass(frozen=True)
class Cut:
    """A position in an order: the key of the row there, and how many of the ``ties`` with that key lie before it.

    Without a key all rows lie before the position.
    """

    key: dict[str, str | None] | None
    need: int = 0
    ties: int = 0

    def literal(self, schema: T.StructType) -> Column:
        return _literal(self.key, schema)


def _literal_sql(key: dict[str, str | None], schema: T.StructType) -> str:
    return f"struct({', '.join(_restored(v, schema[c].dataType) for c, v in key.items())})"


def _literal(key: dict[str, str | None], schema: T.StructType) -> Column:
    return F.expr(_literal_sql(key, schema))


def _listed_keys(keys: DataFrame, order: list[str], rows: int, *more: str) -> list:
    """The first keys in order, in portable form; ``rows`` at most reach the driver."""
    shown = [_portable(c, keys.schema[c].dataType).alias(c) for c in order]
    return keys.orderBy(*_cols(order)).limit(rows).select(*shown, *more).collect()


def _range_cells(inside: DataFrame, order: list[str]) -> list[tuple]:
    """``(lower, upper, rows)`` in order: keys from a sample, and the open ranges between them.

    A sampled key is a cell of its own (``lower`` is ``upper``), so a key that many rows share ends the search. Each
    task keeps a sample of bounded size and counts its rows per cell.
    """
    sample = inside.orderBy(F.rand(1)).limit(SAMPLED_KEYS).distinct()
    keys = [{c: r[c] for c in order} for r in _listed_keys(sample, order, SAMPLED_KEYS)]
    if not keys:
        return []
    step = -(-len(keys) // BOUNDS)
    bounds = keys[step // 2::step]
    # One text for the parser: a tree of comparisons built column by column would take seconds.
    literals = [_literal_sql(k, inside.schema) for k in bounds]
    key = f"struct({', '.join('`' + c.replace('`', '``') + '`' for c in order)})"

    def cell(low: int, high: int) -> str:
        """Twice the place of the last bound that is not above the key, and one more if it is below."""
        if low == high:
            return "-1" if low == 0 else f"if({key} = {literals[low - 1]}, {2 * low - 2}, {2 * low - 1})"
        middle = (low + high) // 2
        return f"if({key} < {literals[middle]}, {cell(low, middle)}, {cell(middle + 1, high)})"

    counted = inside.groupBy(F.expr(cell(0, len(bounds))).alias("cell")).agg(F.count("*").alias("n"))
    sizes = dict(counted.collect())  # twice the bounds, and one
    cells = [(None, bounds[0], sizes.get(-1, 0))]
    for i, bound in enumerate(bounds):
        cells.append((bound, bound, sizes.get(2 * i, 0)))
        cells.append((bound, bounds[i + 1] if i + 1 < len(bounds) else None, sizes.get(2 * i + 1, 0)))
    return cells


def find_cuts(df: DataFrame, order, positions) -> list[Cut]:
    """The cut at each 0-based position in the order of the given columns, found by counting.

    Nothing is sorted or written: the rows are counted per range of keys, and the range that holds the position is
    divided again, until it is one key or its few keys are listed. Passes read the order columns only; their number
    grows with the logarithm of the rows.
    """
    order = as_list(order)
    narrow = df.select(*_cols(order))
    key = F.struct(*_cols(order))
    seen: dict[str, list[tuple]] = {}

    def within(lower, upper) -> DataFrame:
        rows = narrow
        if lower is not None:
            rows = rows.where(key > _literal(lower, narrow.schema))
        return rows if upper is None else rows.where(key < _literal(upper, narrow.schema))

    def cells(lower, upper) -> list[tuple]:
        at = repr((lower, upper))
        if at not in seen:
            seen[at] = _range_cells(within(lower, upper), order)
        return seen[at]

    def find(position: int) -> Cut:
        lower = upper = None
        before = 0
        while True:
            for first, last, rows in cells(lower, upper):
                if before + rows > position:
                    break
                before += rows
            else:
                return Cut(None)
            if first is last:
                return Cut(first, position - before, rows)
            lower, upper = first if first is not None else lower, last if last is not None else upper
            if rows <= COUNTED_ROWS:
                keys = within(lower, upper).groupBy(*_cols(order)).agg(F.count("*").alias("_n"))
                for r in _listed_keys(keys, order, COUNTED_ROWS, "_n"):
                    if before + r["_n"] > position:
                        return Cut({c: r[c] for c in order}, position - before, r["_n"])
                    before += r["_n"]

    return [find(p) for p in positions]


def _mark_before(df: DataFrame, order: list[str], cut: Cut, flag: str) -> DataFrame:
    """Flag the rows before a cut in place; only where rows of one key lie on both sides are those told apart."""
    if cut.key is None:
        return df.withColumn(flag, F.lit(True))
    key, at = F.struct(*_cols(order)), cut.literal(df.schema)
    if not cut.need:
        return df.withColumn(flag, key < at)
    tied = mark_first(df.where(key == at), lambda size: F.lit(cut.need), flag=flag)
    return df.where(key != at).withColumn(flag, key < at).unionByName(tied)


def between_ranks(df: DataFrame, order, low: int, high: int, flag: str) -> DataFrame:
    """Flag the rows whose position in the given order is in ``[low, high)``.

    The keys at either end are found by counting and the rows compared with them, without a shuffle. Of equal keys the
    first in the hash order of the whole rows count.
    """
    order = as_list(order)
    if high <= low:
        return df.withColumn(flag, F.lit(False))
    if low <= 0:
        return _mark_before(df, order, *find_cuts(df, order, [high]), flag)
    start, end = find_cuts(df, order, [low, high])
    below = _mark_before(df, order, end, flag)
    if start.key is None:
        return df.withColumn(flag, F.lit(False))
    if not start.need:
        return below.withColumn(flag, F.col(f"`{flag}`") & (F.struct(*_cols(order)) >= start.literal(df.schema)))
    inside = _mark_before(below.where(F.col(f"`{flag}`")).drop(flag), order, start, flag)
    return inside.withColumn(flag, ~F.col(f"`{flag}`")).unionByName(below.where(~F.col(f"`{flag}`")))


def group_quantile(df: DataFrame, value: Column, q: float = 0.5, by=(), into: str = "quantile") -> Settled:
    """``(by…, into)``: the smallest value of each group that at least the share ``q`` of its values does not exceed.

    Exact at any size, by counting: two values on either side of the place, taken from a sketch, cut a group's values
    into five cells (the two values themselves are cells); the cells are counted and the one in question is cut again,
    until it is one value or holds few. The sketch decides only how fast that goes: each cell lacks a value at least.
    Every pass combines before the shuffle, and no group is sorted or gathered. Nulls and NaN do not count; a group
    without values is left out.
    """
    by = as_list(by)
    rows = df.select(*_cols(by), value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    steps = F.percentile_approx("_v", [i / QUANTILE_STEPS for i in range(QUANTILE_STEPS + 1)]).alias("_steps")
    held = [F.count("*").alias("_held"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), steps]

    def bounds(cells: DataFrame) -> DataFrame:
        at = F.col("_need") / F.col("_held") * QUANTILE_STEPS
        low, high = F.greatest(F.floor(at) - 1, F.lit(0)), F.least(F.ceil(at) + 1, F.lit(QUANTILE_STEPS))
        return cells.select(*_cols(by), "_held", "_need", "_lo", "_hi", F.get("_steps", low.cast("int")).alias("_a"),
                            F.get("_steps", high.cast("int")).alias("_b"))

    need = F.greatest(F.ceil(F.col("_held") * q), F.lit(1)).cast("long")
    state = settle(bounds(rows.groupBy(*_cols(by)).agg(*held).where("_held > 0").withColumn("_need", need)))
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    wide, between = F.col("_lo") < F.col("_hi"), v.between(F.col("_lo"), F.col("_hi"))
    many = wide & (F.col("_held") > COUNTED_ROWS)
    while not state.df.where(many).isEmpty():
        inside = join_groups(rows, Settled(state.df.where(many), state.table), by).where(between)
        cell = F.when(v < a, 0).when(v == a, 1).when(v < b, 2).when(v == b, 3).otherwise(4).alias("_cell")
        cells = inside.groupBy(*_cols(by), cell).agg(*held, F.first("_need").alias("_need"))
        before = F.sum("_held").over(Window.partitionBy(*_cols(by)).orderBy("_cell")) - F.col("_held")
        hit = cells.withColumn("_need", F.col("_need") - before).where(F.col("_need").between(F.lit(1), F.col("_held")))
        state = settle(state.df.where(~many).unionByName(bounds(hit)))
    few = join_groups(rows, Settled(state.df.where(wide), state.table), by).where(between)
    listed = few.groupBy(*_cols(by)).agg(F.sort_array(F.collect_list("_v")).alias("_l"), F.first("_need").alias("_need"))
    picked = listed.select(*_cols(by), F.get("_l", (F.col("_need") - 1).cast("int")).alias(into)).where(F.col(f"`{into}`").isNotNull())
    return settle(state.df.where(~wide).select(*_cols(by), F.col("_lo").alias(into)).unionByName(picked))
