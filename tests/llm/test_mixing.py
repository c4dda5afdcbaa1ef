from __future__ import annotations

import itertools
import random
import time

import pytest

from labelspark.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [pytest.approx(300 * 5 / 8), pytest.approx(75.0), pytest.approx(37.5)]
    # the first is full at 30; what exceeds it goes to the others by weight
    assert mixing.targets([10, 100, 100]) == [30.0, pytest.approx(120.0), pytest.approx(60.0)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    draw = random.Random(1)
    for _ in range(300):
        sizes = [draw.choice([0, 1, 5, 100, 10_000]) for _ in range(draw.randint(1, 12))]
        found = mixing.targets(sizes)
        assert sum(found) == pytest.approx(sum(sizes))
        assert all(t <= 3 * s + 1e-9 for t, s in zip(found, sizes))


def test_flow_is_cheapest():
    """Against minimum cuts: with one, two and three repetitions open, as much as can be is used."""
    draw = random.Random(2)
    for _ in range(300):
        sources = draw.randint(1, 4)
        patterns = [(draw.sample(range(sources), draw.randint(1, sources)), draw.randint(0, 6)) for _ in range(draw.randint(0, 5))]
        quotas = [draw.randint(0, 12) for _ in range(sources)]
        given = mixing.cheapest_flow(patterns, quotas)
        taken = [sum(g.values()) for g in given]
        assert all(sum(g.get(s, 0) for g in given) <= quotas[s] for s in range(sources))
        assert all(t <= 3 * size for t, (_, size) in zip(taken, patterns))
        for times in (1, 2, 3):
            cut = min(
                sum(quotas[s] for s in chosen)
                + sum(times * size for members, size in patterns if any(s not in chosen for s in members))
                for n in range(sources + 1) for chosen in itertools.combinations(range(sources), n)
            )
            assert sum(min(t, times * size) for t, (_, size) in zip(taken, patterns)) == cut


def test_near_targets_and_same_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_counts(mixing.mix_plan(docs)).join(docs.selectExpr("doc_id as id", "source"), "id").collect()
    again = mixing.mix_counts(mixing.mix_plan(docs.repartition(5)))
    assert {r.id: r.taken for r in rows} == {r.id: r.taken for r in again.collect()}
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.03 * own[0].target, 10)
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in rows)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert all(words[r.id] == r["size"] for r in rows)


def test_overlapping_sources(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randint(1, 40)), draw.choice([["a"], ["a", "b"], ["b", "c"], ["c", "c"], [], None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>")
    plan = mixing.mix_plan(docs, sources_col="sources")
    assert len(plan.sizes) == 4  # a, b, c and none
    total = sum(len(t.split()) for _, t, _ in rows)
    assert sum(plan.taken) == pytest.approx(total, abs=4)
    taken = mixing.mixed(docs, plan, sources_col="sources").collect()
    assert sum(len(r.text.split()) for r in taken) == pytest.approx(total, rel=0.02)


def test_flow_of_many_patterns():
    draw = random.Random(5)
    patterns = [(draw.sample(range(60), draw.randint(1, 5)), draw.randint(1, 900)) for _ in range(50_000)]
    total = sum(size for _, size in patterns)
    quotas = [total // 60 if s % 3 else total // 40 for s in range(60)]
    began = time.process_time()
    given = mixing.cheapest_flow(patterns, quotas)
    assert time.process_time() - began < 60
    assert all(sum(g.values()) <= 3 * size for g, (_, size) in zip(given, patterns))
    filled = [0] * 60
    for g in given:
        for s, amount in g.items():
            filled[s] += amount
    assert filled == quotas


@pytest.mark.parametrize("ids", [True, False])
def test_repeated_rows_reach_the_target(spark, ids):
    """A source of one row 600 times, among sources of different documents; more columns tell its rows apart."""
    rows = [(7 if ids else None, "a", "word " * 50, i) for i in range(600)]
    rows += [(1_000 + i, "b" if i % 2 else "c", f"{i} " * 50, i) for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, draw int").repartition(7)
    plan = mixing.mix_plan(docs)
    count = lambda p: sorted((r.id or 0, r.taken) for r in mixing.mix_counts(p).collect())
    counts = count(plan)
    copies = [t for i, t in counts if i in (0, 7)]
    assert len(copies) == 600 and len(set(copies)) == 2 and max(copies) <= 150
    assert abs(sum(copies) - plan.targets[0]) <= 50
    assert count(mixing.mix_plan(docs.repartition(3))) == counts
    taken = [r.draw for r in mixing.mixed(docs, plan).collect() if r.source == "a"]
    assert 50 * len(taken) == sum(copies) and len(set(taken)) == 600


def test_odd_tables(odd, none):
    plan = mixing.mix_plan(odd)
    counts = mixing.mix_counts(plan).collect()
    assert len(counts) == odd.count()
    taken = mixing.mixed(odd, plan)
    assert taken.columns == odd.columns
    got = sum(len((r.text or "").encode().split()) for r in taken.collect())
    assert got == sum(r.taken for r in counts)
    assert mixing.mix_counts(mixing.mix_plan(none)).count() == 0


def test_cuts_against_lists(spark, monkeypatch):
    """Every round takes documents in order of their draws; what the rounds find is written to no table."""
    draw = random.Random(8)
    kinds = [["a"], ["a", "b"], ["b"], None]
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 7, 60, 400])), draw.choice(kinds)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>")
    written, write = [], mixing.checkpointed
    monkeypatch.setattr(mixing, "checkpointed", lambda df: written.append(df) or write(df))
    plan = mixing.mix_plan(docs, sources_col="sources")
    assert len(written) <= 2
    of = {tuple(r.pattern): r for r in plan.patterns.collect()}
    sized = [(tuple(r.pattern), r["size"], r.draw) for r in plan.sized.collect()]
    members = sorted(of, key=lambda p: [(s is None, s or "") for s in p])
    names = sorted({s for p in members for s in p}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size for q, size, _ in sized if q == p) for p in members]
    given = mixing.cheapest_flow([([names.index(s) for s in p], n) for p, n in zip(members, sizes)], [round(t) for t in plan.targets])
    for p, n, g in zip(members, sizes, given):
        rest, last, cuts, limits = sum(g.values()) % n, None, [], []
        for _ in range(mixing.ROUNDS):
            limit = rest
            for at, size in sorted((at, size) for q, size, at in sized if q == p and 0 < size <= limit and (last is None or at > last)):
                if size > rest:
                    break
                last, rest = at, rest - size
            cuts.append(last)
            limits.append(limit)
        assert of[p].times == sum(g.values()) // n and (of[p].cuts, of[p].limits) == (cuts, limits)
