from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelspark.operators import errors as E
from labelspark.operators import metrics as M

VOCAB = {"kind": ["a", "b", "a class with a long name", "never", "Unknown"], "part": ["x", "y", "Unknown"]}


def sample_rows():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        t = rng.choice([0, 0, 0, 1, 2])
        p = t if rng.random() < 0.6 else rng.choice([0, 1, 2, 4])
        s = rng.randrange(2)
        rows.append((i, f"text {i}", (t, s), (p, s if rng.random() < 0.9 else 2)))
    return rows


ROWS = sample_rows()


@pytest.fixture(scope="module")
def predicted(spark):
    ids = "struct<kind:int,part:int>"
    rows = [(i, text, true, pred, (f"answer {i}", 2, 1, 3, 0.5, None, None)) for i, text, true, pred in ROWS]
    response = "struct<text:string,prompt_tokens:int,completion_tokens:int,total_tokens:int,latency:double,reasoning:string,error:string>"
    return spark.createDataFrame(rows, f"id int, text string, actual {ids}, predicted {ids}, response {response}")


@pytest.fixture(scope="module")
def counts(predicted):
    return M.confusion_counts(predicted, VOCAB)


def pairs(label):
    return Counter((t[label], p[label]) for _, _, t, p in ROWS)


def expected_report(label):
    cells = pairs(label)
    total = sum(cells.values())
    out = {}
    for c in {k for pair in cells for k in pair}:
        hits = cells[(c, c)]
        support = sum(n for (t, _), n in cells.items() if t == c)
        predicted = sum(n for (_, p), n in cells.items() if p == c)
        out[str(c)] = (hits / predicted if predicted else 0, hits / support if support else 0,
                       2 * hits / (support + predicted), support)
    classes = list(out.values())
    accuracy = sum(n for (t, p), n in cells.items() if t == p) / total
    out["macro avg"] = (*[sum(c[i] for c in classes) / len(classes) for i in range(3)], total)
    out["weighted avg"] = (*[sum(c[i] * c[3] for c in classes) / total for i in range(3)], total)
    out["accuracy"] = (accuracy,) * 4
    return out


def test_report(counts):
    rows = M.classification_report(counts).collect()
    for i, label in enumerate(VOCAB):
        got = {r.row_key: (r.precision, r.recall, r.f1, r.support) for r in rows if r.label_name == label}
        want = expected_report(i)
        assert got.keys() == want.keys()
        for key in want:
            assert got[key] == pytest.approx(want[key]), key


def test_counts_and_ratios(counts):
    got = {(r.true_id, r.pred_id): r.n for r in counts.where("label_name = 'kind'").collect()}
    assert got == pairs(0)
    ratios = M.confusion_matrix(counts).groupBy("label_name", "true_id").agg(F.sum("ratio").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in ratios)


def test_dense_matrix(counts):
    rows = M.dense_matrix(counts, VOCAB, char_limit=7, text_classes=3).collect()
    assert len(rows) == 25 + 9
    kind = [r for r in rows if r.label_name == "kind"]
    assert {r.true_name for r in kind} == {"a", "b", "a class...", "never", "Unknown"}
    assert {r.show_text for r in kind} == {False} and {r.show_text for r in rows if r.label_name == "part"} == {True}
    assert all(r.n == 0 and r.ratio == 0 for r in kind if r.true_id == 3)
    assert sum(r.n for r in kind) == 300


def test_matrix_rows(spark, counts):
    rows = M.matrix_rows(counts, M.class_table(spark, VOCAB)).where("label_name = 'kind'").collect()
    assert [r.true_name for r in sorted(rows, key=lambda r: r.true_id)] == VOCAB["kind"]
    assert {(r.true_id, p): n for r in rows for p, n in r.cells.items()} == pairs(0)
    assert all(r.n == sum(r.cells.values()) for r in rows)


def test_pivot(counts):
    rows = M.matrix_pivot(counts, "kind", VOCAB["kind"]).collect()
    assert rows[0].asDict().keys() == {"true_name", *VOCAB["kind"]}
    assert {(r.true_name, r["b"]) for r in rows} == {(VOCAB["kind"][t], pairs(0)[(t, 1)]) for t in range(3)}


def test_usage_latency_and_elapsed(spark, predicted):
    usage = M.token_usage(predicted).first()
    assert (usage.prompt_tokens, usage.completion_tokens, usage.total_tokens) == (600, 300, 900)
    latency = M.response_latency(predicted).first()
    assert (latency.samples, latency.mean_latency, latency.median_latency) == (300, 0.5, 0.5)
    header = spark.createDataFrame([("r", 150.0)], "run_id string, total_time_elapsed double")
    assert M.latency_per_sample(header, predicted.withColumn("run_id", F.lit("r"))).first().latency == 0.5
    assert str(spark.range(1).select(M.elapsed_interval(F.lit(3661.5))).first()[0]) == "1:01:01.500000"


def test_answers(predicted):
    rows = E.answers(predicted, VOCAB, "id")
    assert rows.columns == ["id", "Text", "LLM Response", "LLM Reasoning", "Prediction Time", "Total Tokens",
                            "Predicted kind", "True kind", "Predicted part", "True part"]
    wrong = {i for i, _, t, p in ROWS if t != p}
    assert {r.id for r in E.answers(predicted, VOCAB, "id", wrong_only=True).collect()} == wrong


def test_error_pairs_and_sides(counts):
    wrong = {(r.true_id, r.pred_id): (r.n, r.class_errors) for r in E.error_pairs(counts).collect() if r.label_name == "kind"}
    for (t, p), (n, of_class) in wrong.items():
        assert n == pairs(0)[(t, p)] and of_class == sum(m for (a, b), m in pairs(0).items() if a == t and b != t)
    sides = E.true_vs_predicted(counts, VOCAB, top=2).where("label_name = 'kind' and side = 'true'").orderBy("rank").collect()
    assert [(r.class_name, r.n) for r in sides][0] == ("a", sum(n for (t, _), n in pairs(0).items() if t == 0))


def few(predicted, counts, **sizes):
    return E.few_shot_examples(predicted, counts, VOCAB, "id", **sizes)


def test_few_shot_examples(predicted, counts):
    rows = few(predicted, counts, per_class=2, per_true=2, per_pred=3).collect()
    truth = {i: (t, p) for i, _, t, p in ROWS}
    kind = [r for r in rows if r.label_name == "kind"]
    errors = Counter()
    for (t, p), n in pairs(0).items():
        errors[t] += n if t != p else 0
    best = [VOCAB["kind"][t] for t, _ in sorted(errors.items(), key=lambda e: (-e[1], VOCAB["kind"][e[0]]))[:2]]
    assert {r.true_name for r in kind} == set(best)
    for r in kind:
        t, p = truth[r.id]
        assert VOCAB["kind"][t[0]] == r.true_name and VOCAB["kind"][p[0]] == r.pred_name
    assert len(kind) == sum(min(3, pairs(0)[(VOCAB["kind"].index(a), VOCAB["kind"].index(b))])
                            for a, b in {(r.true_name, r.pred_name) for r in kind})


def test_few_shot_text(predicted, counts):
    text = E.few_shot_text(few(predicted, counts), VOCAB).first().examples
    assert text.startswith("Example 1 - text: text ") and text.count("\n\nExample 2 - text: ") == 1
    assert text.count("correct result: {") == 2 and '"part": ' in text
    single = {"kind": VOCAB["kind"]}
    one = E.few_shot_text(E.few_shot_examples(predicted, M.confusion_counts(predicted, single), single, "id"), single).first().examples
    assert one.endswith("correct result: a" + E.OPEN_QUESTION) and text.endswith("}" + E.OPEN_QUESTION)


def test_perfect_predictions_have_no_examples(predicted):
    right = predicted.withColumn("predicted", F.col("actual"))
    counts = M.confusion_counts(right, VOCAB)
    assert E.error_pairs(counts).isEmpty()
    assert E.few_shot_text(few(right, counts), VOCAB).first().examples == ""


def test_names_from_a_table(spark, predicted, counts):
    rows = [(label, i, name) for label, names in VOCAB.items() for i, name in enumerate(names)]
    vocab = spark.createDataFrame(rows, "label_name string, class_id int, class_name string")
    labels = list(VOCAB)

    def same(a, b):
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))

    same(E.answers(predicted, vocab, "id", True, labels), E.answers(predicted, VOCAB, "id", True))
    same(E.true_vs_predicted(counts, vocab), E.true_vs_predicted(counts, VOCAB))
    mined = E.few_shot_examples(predicted, counts, vocab, "id", per_class=2, per_pred=3, labels=labels)
    same(mined, few(predicted, counts, per_class=2, per_pred=3))
    same(E.few_shot_text(mined, vocab, labels), E.few_shot_text(mined, VOCAB))


def test_matrix_blocks(counts):
    rows = M.matrix_blocks(counts, 2).withColumn("values", M.block_values(2)).where("label_name = 'kind'").collect()
    assert {(c.true_id, c.pred_id): c.n for r in rows for c in r.cells} == pairs(0)
    for r in rows:
        assert r.n == sum(c.n for c in r.cells) and r.true_from % 2 == 0 and r.pred_from % 2 == 0
        assert [list(v) for v in r["values"]] == [[pairs(0)[(r.true_from + i, r.pred_from + j)] for j in range(2)] for i in range(2)]
    assert len(rows) == len({(t // 2, p // 2) for t, p in pairs(0)})


def test_latency_by_run_and_without_rows(spark, predicted):
    rng = random.Random(1)
    rows = [("many", rng.expovariate(1.0)) for _ in range(9000)] + [("one", 3.0), ("none", None), (None, 1.0), (None, 2.0), (None, 9.0)]
    made = spark.createDataFrame(rows, "run string, latency double").select("run", F.struct("latency").alias("response"))
    got = {r.run: (r.samples, r.median_latency) for r in M.response_latency(made, "run").collect()}
    assert got == {"many": (9000, sorted(v for k, v in rows if k == "many")[4499]), "one": (1, 3.0), "none": (1, None), None: (3, 2.0)}
    empty = M.response_latency(made.where("false")).first()
    assert (empty.samples, empty.mean_latency, empty.median_latency) == (0, None, None)
