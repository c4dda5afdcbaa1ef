from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelspark import session
from labelspark.operators import ordering as O
from labelspark.operators import sampling as S
from labelspark.operators import splits as P


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def numbers(spark, n, partitions):
    return spark.range(0, n, 1, partitions).withColumn("g", F.expr("case when id % 3 > 0 then 'hot' else concat('c', id % 5) end"))


@pytest.mark.parametrize("partitions", [1, 4, 50])
@pytest.mark.parametrize("n,quota", [(1000, 1), (1000, 137), (1000, 1000), (1000, 5000), (1000, 0), (0, 3)])
def test_first_n_is_exact_for_any_partitioning(spark, partitions, n, quota):
    got = {r.id for r in O.take_first(numbers(spark, n, partitions), lambda size: F.lit(quota), "id", 9).collect()}
    assert got == set(sorted(range(n), key=lambda i: digest(9, i))[:quota])


@pytest.mark.parametrize("cell_rows", [200_000, 1])
@pytest.mark.parametrize("small", [True, False])
def test_first_n_per_group(spark, monkeypatch, cell_rows, small):
    monkeypatch.setattr(O, "CELL_ROWS", cell_rows)  # 1 forces every refinement level
    if not small:
        monkeypatch.setattr(session, "small_rows", lambda df, max_rows=0: None)
    rows = numbers(spark, 3000, 6)
    got = O.take_first(rows, lambda size: F.floor(size / 4), "id", 3, ["g"])
    groups = {}
    for i in range(3000):
        groups.setdefault("hot" if i % 3 else f"c{i % 5}", []).append(i)
    want = set()
    for members in groups.values():
        want |= set(sorted(members, key=lambda i: digest(3, i))[: len(members) // 4])
    assert {r.id for r in got.collect()} == want


def test_null_group_is_a_group(spark):
    rows = spark.range(40).withColumn("g", F.expr("case when id % 2 = 0 then 'a' end"))
    got = O.take_first(rows, lambda size: F.lit(3), "id", 0, ["g"]).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 3, None: 3}


def test_copies_are_counted(spark, monkeypatch):
    monkeypatch.setattr(O, "COPY_BLOCK", 7)
    rows = spark.range(600).select(F.expr("case when id < 400 then 'hot' else concat('x', id % 4) end").alias("v"))
    flagged = O.mark_first(rows, lambda size: F.lit(450), None, 1)
    assert flagged.count() == 600
    assert flagged.where("is_first").count() == 450
    whole = Counter(r.v for r in flagged.collect())
    assert whole == Counter(r.v for r in rows.collect())


def test_equal_keys_are_told_apart(spark):
    rows = spark.range(500).select(F.lit("one key").alias("k"), (F.col("id") % 100).alias("v"))
    flagged = O.mark_first(rows, lambda size: F.lit(123), "k", 1)
    assert flagged.where("is_first").count() == 123
    assert Counter(r.v for r in flagged.collect()) == Counter({v: 5 for v in range(100)})


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_global_rank(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "é"]), rng.randint(0, 30), i) for i in range(700)]
    df = spark.createDataFrame(rows, "s string, n int, i int").repartition(partitions)
    got = {r.i: r.rank for r in O.global_rank(df, ["s", "n", "i"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert got == {r[2]: k for k, r in enumerate(order)}


def test_global_rank_of_equal_rows(spark):
    ranks = sorted(r.rank for r in O.global_rank(spark.range(300).select(F.lit(1).alias("k")), "k").collect())
    assert ranks == list(range(300))


def test_shuffle_rank(spark):
    got = {r.id: r.rank for r in S.shuffle_rank(spark.range(200), "id", 5).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(200), key=lambda i: digest(5, i)))}


def test_spread_pick(spark):
    """Integer form of evenly spaced positions, both ends included."""
    cases = [(m, n, r) for m in range(1, 25) for n in range(1, m + 3) for r in range(m)]
    df = spark.createDataFrame(cases, "m long, n long, r long")
    hits = df.where(S.spread_pick(F.col("r"), F.col("m"), F.col("n")))
    got = {}
    for row in hits.collect():
        got.setdefault((row.m, row.n), set()).add(row.r)
    for m in range(1, 25):
        for n in range(1, m + 3):
            want = {0} if n == 1 else set(range(m)) if n >= m else {k * (m - 1) // (n - 1) for k in range(n)}
            assert got[(m, n)] == (want if m > 1 else {0}), (m, n)


@pytest.mark.parametrize("n,size", [(10, 0.1), (101, 0.2), (7, 0.5), (50, 3)])
def test_random_split(spark, n, size):
    parts = P.random_split(spark.range(n), size, "id")
    test = {r.id for r in parts.where("split = 'test'").collect()}
    train = {r.id for r in parts.where("split = 'train'").collect()}
    assert test | train == set(range(n)) and not test & train
    assert len(test) == (size if size > 1 else math.ceil(n * size))


def test_hash_split_is_stable_under_appends(spark):
    few = {r.id: r.split for r in P.hash_split(spark.range(100), 0.3, "id").collect()}
    many = {r.id: r.split for r in P.hash_split(spark.range(1000), 0.3, "id").collect()}
    assert all(many[i] == s for i, s in few.items())
    assert 200 < sum(s == "test" for s in many.values()) < 400
    for size, tests in ((1, 100), (0, 0)):
        assert P.hash_split(spark.range(100), size, "id").where("split = 'test'").count() == tests


@pytest.mark.parametrize("partitions", [1, 7])
def test_positional_split_and_shards(spark, partitions):
    df = spark.range(0, 103, 1, partitions).withColumn("at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,(id * 37) % 103)"))
    order = [r.id for r in df.orderBy("at").collect()]
    parts = P.positional_split(df, 0.8, "at")
    assert {r.id for r in parts.where("split = 'train'").collect()} == set(order[:82])
    shards = [[r.id for r in P.shard(df, 4, i, "at").collect()] for i in range(4)]
    assert [len(s) for s in shards] == [26, 26, 26, 25]
    assert set(shards[1]) == set(order[26:52])
    assert sorted(i for s in shards for i in s) == list(range(103))


def test_positional_split_with_equal_keys(spark):
    df = spark.range(100).select(F.lit("same").alias("k"), "id")
    parts = P.positional_split(df, 0.33, "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 33, "test": 67}


def test_spread_pick_beyond_64_bits(spark):
    """3,000,000,001 rows and 2,000,000,001 picks: two of every three, and both ends."""
    rows, picks = 3_000_000_001, 2_000_000_001
    at = [*range(12), *range(rows - 12, rows)]
    df = spark.createDataFrame([(r,) for r in at], "r long")
    hits = {x.r for x in df.where(S.spread_pick(F.col("r"), F.lit(rows), F.lit(picks))).collect()}
    wanted = {k * (rows - 1) // (picks - 1) for k in [*range(12), *range(picks - 12, picks)]}
    assert hits == {r for r in at if r in wanted}


@pytest.mark.parametrize("share", [0.25, 0.5, 0.75])
def test_cut_at_a_clock_change(spark, share):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        first = 1_792_886_400  # 2026-10-25 00:00 UTC; the hour after it is shown twice
        rows = spark.range(8).select("id", F.timestamp_seconds(F.lit(first) + F.col("id") * 900).alias("at"),
                                     F.unhex(F.concat(F.lit("FF"), F.lpad(F.hex("id"), 2, "0"))).alias("raw"))
        for order in ("at", "raw"):
            split = {r.id: r.split for r in P.positional_split(rows, share, order).collect()}
            assert split == {i: "train" if i < 8 * share else "test" for i in range(8)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_many_groups_of_copies_are_spread(spark):
    rows = spark.range(40_000).select((F.col("id") % 2_000).alias("g"), F.lit("x").alias("x"))
    ties = rows.withColumn("_need", F.lit(3))
    numbered = O._number_copies(ties, ["g", "x"], "flag").withColumn("p", F.spark_partition_id())
    assert numbered.where("flag").count() == 6_000
    sizes = [r["count"] for r in numbered.groupBy("p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 20_000


@pytest.mark.parametrize("rows, bounds, counted", [(0, 127, 4096), (1, 127, 4096), (700, 3, 1), (700, 5, 20), (9_000, 127, 64)])
def test_cuts_equal_sorting(spark, monkeypatch, rows, bounds, counted):
    monkeypatch.setattr(O, "BOUNDS", bounds)
    monkeypatch.setattr(O, "COUNTED_ROWS", counted)
    draw = random.Random(rows)
    values = [(draw.choice([None, "a", "é", "b" * 9]), draw.choice([None, float("nan"), -1.5, 2.0, 3.25]) if i % 3 else float(i), i % 2) for i in range(rows)]
    df = spark.createDataFrame(values, "s string, x double, extra int").repartition(4)
    expected = [tuple(r) for r in df.select("s", "x").orderBy("s", "x").collect()]
    positions = sorted({0, 1, rows // 3, rows // 2, max(rows - 1, 0), rows, rows + 5})
    for position, cut in zip(positions, O.find_cuts(df, ["s", "x"], positions)):
        if position >= rows:
            assert cut.key is None
            continue
        at = expected[position]
        before = next(i for i, k in enumerate(expected) if repr(k) == repr(at))
        (found,) = spark.range(1).select(cut.literal(df.schema).alias("k")).collect()
        assert repr(tuple(found.k)) == repr(at)
        assert (cut.need, cut.ties) == (position - before, sum(repr(k) == repr(at) for k in expected))


def test_shards_of_a_hot_key_take_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(O, "COUNTED_ROWS", 5)
    df = spark.range(4_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 10).alias("v")).repartition(6)
    parts = [P.shard(df, 9, i, "k").collect() for i in range(9)]
    assert [len(p) for p in parts] == [445] * 4 + [444] * 5
    assert Counter(map(tuple, df.collect())) == sum((Counter(map(tuple, p)) for p in parts), Counter())
    assert all(max(r.k for r in a) <= min(r.k for r in b) for a, b in zip(parts, parts[1:]))


def test_cuts_need_no_sort_and_no_write(spark):
    df = spark.range(50_000).select(F.xxhash64("id").alias("k"), "id")
    plan = P.positional_split(df, 0.5, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Scan parquet" not in plan


@pytest.mark.parametrize("q", [0.25, 1.0])
def test_group_quantile(spark, monkeypatch, q):
    monkeypatch.setattr(O, "COUNTED_ROWS", 20)
    monkeypatch.setattr(O, "QUANTILE_STEPS", 8)
    groups = {
        "even": [float(i) for i in range(500)],
        "far": [(-1.0) ** i * 10.0 ** (i % 300) for i in range(500)],
        "tied": [7.0] * 300 + [7.0 + i / 64 for i in range(100)],
        "few": [2.0, 1.0],
        None: [5.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("few", float("nan")), ("lost", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = lambda of: sorted(of)[max(math.ceil(len(of) * q), 1) - 1]
    got = {r.g: r.quantile for r in O.group_quantile(df, F.col("v"), q, "g").df.collect()}
    assert got == {g: at(values) for g, values in groups.items()}
    whole = O.group_quantile(df, F.col("v"), q).df.collect()
    assert [r.quantile for r in whole] == [at([v for values in groups.values() for v in values])]
    assert O.group_quantile(df.where("false"), F.col("v"), q).df.count() == 0
