from __future__ import annotations

import numpy as np
import pytest

from labelspark.llm import vptree


def brute(rows, asked, k):
    found = {}
    for q, v in asked:
        near = sorted((float(np.sqrt(sum((np.array(v) - np.array(c)) ** 2))), i) for i, c in rows if i != q and len(c) == len(v))
        found[q] = near[:k]
    return found


@pytest.mark.parametrize("shard_rows", [40, 100_000])
def test_exact_with_copies_and_clusters(spark, shard_rows):
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(8, 6)) * 5
    points = [(centres[i % 8] + draw.normal(size=6)).tolist() for i in range(600)]
    points += [points[0]] * 200 + [[0.5] * 3, [0.25] * 3]
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    odd = [(1_000, None), (1_001, []), (1_002, [0.0] * 6), (1_003, [1.0] * 5 + [None]), (1_004, [1.0] * 5 + [float("nan")]),
           (1_005, [1.0] * 5 + [float("inf")]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id bigint, embedding array<float>, rank string, score int").repartition(4)
    asked = df.where("vec_id % 50 = 0")
    got: dict = {}
    for r in vptree.search(df, asked, k=7, shard_rows=shard_rows, block_rows=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12, atol=0)


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 3.0]), (1, [9.0, 9.0])], "vec_id bigint, embedding array<double>")
    rows = vptree.search(df, df.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert vptree.search(df.limit(0), df).count() == 0 and vptree.search(df, df.limit(0)).count() == 0


def test_factor_prunes_and_recalls():
    draw = np.random.default_rng(10)
    points = draw.normal(size=(4_000, 5))
    ids = np.arange(4_000)
    tree = vptree.Tree(points)
    queries, own = points[:80], ids[:80]
    exact, rows = tree.nearest(queries, own, ids, 10)
    want = np.argsort(np.linalg.norm(points[None] - queries[:, None], axis=2) + (ids[None] == own[:, None]) * 1e9, axis=1)[:, :10]
    assert (np.sort(rows, axis=1) == np.sort(want, axis=1)).all()
    _, relaxed = tree.nearest(queries, own, ids, 10, factor=1.5)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(relaxed, want)])
    assert 0.9 <= recall < 1.0
