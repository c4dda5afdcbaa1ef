from __future__ import annotations

import random

from labelspark.llm.common import connected_components


def test_components(spark):
    draw = random.Random(4)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1_000, 1_001 + i) for i in range(300)]
    some = [(draw.randint(2_000, 2_200), draw.randint(2_000, 2_200)) for _ in range(120)]
    edges = chain + star + some + [(5, 4), (7, 7)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    rows = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in rows} == label and len(rows) == len(label)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
