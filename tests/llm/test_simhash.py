from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from labelspark.llm import simhash
from labelspark.llm.common import connected_components


def brute_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    """{id: smallest id reachable} by comparing everything with everything."""
    least = dict.fromkeys(fps)
    for start in sorted(fps):
        if least[start] is None:
            todo = [start]
            while todo:
                at = todo.pop()
                if least[at] is None:
                    least[at] = start
                    todo += [x for x in fps if least[x] is None and (fps[at] ^ fps[x]).bit_count() <= radius]
    return least


def test_fingerprints_and_components(odd):
    rows = simhash.near_groups(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in texts if r.doc_id is not None}
    least = components(fps, 2)
    for r in rows:
        if r.doc_id is not None:
            assert r.fp % 2**64 == fps[r.doc_id]
            assert r.component == least[r.doc_id]
    assert len(rows) == len(texts)


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_tiles(spark, radius):
    draw = np.random.default_rng(radius)
    fps = draw.integers(0, 2**64, 300, dtype=np.uint64)
    near = [f ^ sum((np.uint64(1) << np.uint64(b) for b in draw.integers(0, 64, k)), np.uint64(0)) for f in fps[:60] for k in (1, 2, 3)]
    dense = [fps[0] ^ (np.uint64(1) << np.uint64(b)) for b in range(64)]
    every = {int(x): int(x) for x in [*fps, *near, *dense, 0, 2**64 - 1]}
    signed = {int(np.uint64(x).view(np.int64)): x for x in every}
    nodes = spark.createDataFrame([(k, k) for k in signed], "node bigint, fp bigint")
    for tile_rows in (7, 65_536):
        links = simhash.tile_links(nodes, radius, tile_rows)
        found = {r.node: r.component for r in connected_components(links).collect()}
        assert {k: found.get(k, k) for k in signed} == components(signed, radius)


def test_forest_is_bounded():
    same = np.zeros(3_000, np.uint64)
    a, b = simhash.compare(same, same, 2)
    assert len(a) == 2_999 and (b == 0).all()


def test_best_forest():
    draw = np.random.default_rng(4)
    for _ in range(100):
        n, m = int(draw.integers(2, 12)), int(draw.integers(0, 40))
        a, b, score = draw.integers(0, n, m), draw.integers(0, n, m), draw.integers(0, 5, m)
        best = simhash.best_forest(n, a, b, score)
        label, total, links = list(range(n)), 0, 0
        for i in np.argsort(-score, kind="stable"):
            if label[a[i]] != label[b[i]]:
                label = [label[a[i]] if x == label[b[i]] else x for x in label]
                total, links = total + score[i], links + 1
        assert len(best) == links and score[best].sum() == total


def test_dense_group_below_the_similarity(spark):
    """Some 80,000 candidate pairs, none similar: each pass writes fewer links than nodes, and all rows stay."""
    draw = random.Random(12)
    some = lambda n: ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    base = some(300)
    docs = [(i, " ".join(base[:265] + some(35))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    prints = simhash.fingerprints(df, shingle=5, signatures=True, distinct=True)
    nodes = prints.withColumnRenamed("doc_id", "node")
    assert 0 < simhash.candidates(nodes, 21, 84, 1_000).count() < 400
    assert simhash.drop_near_copies(df).count() == 400


def test_drop_near_copies(spark, odd, none):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4_000)]
    texts = [[draw.choice(words) for _ in range(300)] for _ in range(40)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(10):
        edited = list(texts[i])
        edited[draw.randrange(300)] = "edited"
        docs += [(100 + i, " ".join(edited)), (200 + i, " ".join(texts[i])), (300 + i, " ".join(texts[i]).upper())]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    kept = simhash.drop_near_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    twice = simhash.drop_near_copies(df.union(df))
    assert sorted(r.doc_id for r in twice.collect()) == list(range(40))
    found = simhash.drop_near_copies(odd)
    assert found.columns == odd.columns
    assert 0 < found.count() < odd.count()
    assert simhash.drop_near_copies(none).count() == 0 and simhash.near_groups(none).count() == 0


def test_near_copies_with_repeated_lines(spark):
    draw = random.Random(8)
    some = lambda n: ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    docs = []
    for i in range(60):
        words, line, times = some(300), some(12), (5, 20, 50)[i % 3]
        docs += [(i, " ".join(words + line)), (100 + i, " ".join(words + line * times))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == list(range(60))


@pytest.mark.parametrize("tile_rows", [40, 65_536])
def test_similarity_is_exact(spark, tile_rows):
    draw = random.Random(9)
    some = lambda n: ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    shingles = lambda words: {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    texts = {}
    for i in range(150):  # pairs of 0.74 to 0.85
        words, cut = some(204), 16 + i % 14
        texts[2 * i], texts[2 * i + 1] = words, words[:-cut] + some(cut)
    base = some(204)  # groups of many, alike in pairs and in chains
    for i in range(60):
        texts[1_000 + i] = base[:3 * i] + ["changed" + str(i)] + base[3 * i + 1:]
        texts[2_000 + i] = base[100:] + some(4 * i % 90)
    sets = {i: shingles(t) for i, t in texts.items()}
    left, want = dict.fromkeys(sorted(sets)), set()
    while left:
        todo = [min(left)]
        want.add(todo[0])
        del left[todo[0]]
        while todo:
            at = sets[todo.pop()]
            near = [k for k in left if 5 * len(at & sets[k]) >= 4 * len(at | sets[k])]
            todo += near
            for k in near:
                del left[k]
    assert 200 < len([i for i in want if i < 1_000]) < 280
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string").repartition(4)
    assert {r.doc_id for r in simhash.drop_near_copies(df, tile_rows=tile_rows).collect()} == want
