from __future__ import annotations

import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from labelspark.operators.chat import to_messages
from labelspark.operators.metrics import confusion_counts
from labelspark.plans import inference as I
from labelspark.plans.baseline import classify, train_classifier
from labelspark.plans.config import RunConfig
from labelspark.plans.evaluate import evaluate, predictions
from labelspark.plans.prompts import assemble_requests
from labelspark.operators.labels import label_vocabulary

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPTIONS = {"max_tokens": 4, "temperature": 0.0, "top_p": None, "reasoning_effort": None, "thinking_tokens": None}


def echo():
    def respond(messages, options):
        return {"text": messages[-1]["content"], "prompt_tokens": 3, "completion_tokens": options["max_tokens"], "reasoning": "r"}

    return respond


def broken():
    def respond(messages, options):
        if "7" in messages[-1]["content"]:
            raise RuntimeError("no seven")
        return {"text": messages[-1]["content"]}

    return respond


def refuse():
    def respond(messages, options):
        raise AssertionError("asked again")

    return respond


def test_retries():
    calls = []

    def flaky(messages, options):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("busy")
        return {"text": "ok", "prompt_tokens": 2, "completion_tokens": 1}

    got = I.ask(flaky, [], {}, retries=3, delay=0)
    assert (got["text"], got["total_tokens"], got["error"], len(calls)) == ("ok", 3, None, 3)
    calls.clear()
    got = I.ask(flaky, [], {}, retries=2, delay=0)
    assert (got["text"], got["total_tokens"], got["error"]) == ("", 0, "ValueError: busy")


def test_options_reach_the_model():
    assert I.model_options(OPTIONS) == {"max_tokens": 4, "temperature": 0.0, "top_p": None}
    full = I.model_options({**OPTIONS, "reasoning_effort": "low", "thinking_tokens": 2048})
    assert full["reasoning_effort"] == "low" and full["thinking"] == {"type": "enabled", "budget_tokens": 2048}


def requests(spark, n=20):
    texts = spark.range(n).select("id", F.concat(F.lit("text "), "id").alias("text"))
    return assemble_requests(texts, RunConfig("run", 4, "prompt"))


def test_infer(spark):
    rows = I.infer(requests(spark), echo, partitions=3).collect()
    assert len(rows) == 20
    assert all(r.response.text == f"text {r.id}" and r.response.total_tokens == 7 for r in rows)
    assert rows[0].response.reasoning == "r" and rows[0].response.error is None


def test_failures_are_recorded(spark):
    rows = I.infer(requests(spark), broken, retries=1)
    assert sorted(r.id for r in I.failed(rows).collect()) == [7, 17]


def test_a_broken_run_is_taken_up(spark, tmp_path):
    path = str(tmp_path / "responses")
    assert I.infer_to(requests(spark, 10), echo, path, ["id", "run_id"]).count() == 10
    assert I.infer_to(requests(spark, 10), refuse, path, ["id", "run_id"], retries=1).where("response.text = ''").count() == 0
    assert I.infer_to(requests(spark, 15), echo, path, ["id", "run_id"]).count() == 15


def test_steps_are_kept_when_a_later_one_breaks(spark, tmp_path):
    path, calls = str(tmp_path / "steps"), []
    infer = I.infer

    def breaking(rows, *args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return infer(rows, *args, **options)

    I.infer = breaking
    try:
        with pytest.raises(RuntimeError):
            I.infer_to(requests(spark, 40), echo, path, ["id", "run_id"], steps=4)
    finally:
        I.infer = infer
    kept = spark.read.parquet(path).count()
    assert 0 < kept < 40
    again = I.infer_to(requests(spark, 40), echo, path, ["id", "run_id"], steps=4)
    assert again.count() == 40 and spark.read.parquet(path).count() == 40


def test_failed_rows_are_asked_again(spark, tmp_path):
    path = str(tmp_path / "failed")
    first = I.infer_to(requests(spark), broken, path, ["id", "run_id"], retries=1)
    assert I.failed(first).count() == 2
    second = I.infer_to(requests(spark), echo, path, ["id", "run_id"], retries=1)
    assert I.failed(second).count() == 0 and second.count() == 20
    assert spark.read.parquet(path).count() == 22


def test_another_prompt_is_another_request(spark, tmp_path):
    path = str(tmp_path / "prompts")
    I.infer_to(requests(spark), echo, path, ["id", "run_id"])
    texts = spark.range(5).select("id", F.concat(F.lit("text "), "id").alias("text"))
    other = I.infer_to(assemble_requests(texts, RunConfig("run", 4, "another prompt")), echo, path, ["id", "run_id"])
    assert sorted(r.id for r in other.collect()) == list(range(5))
    assert spark.read.parquet(path).count() == 25


def test_requests_are_read_once(spark, tmp_path):
    path, read = str(tmp_path / "once"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = requests(spark, 40)
    watched = rows.mapInPandas(counted, rows.schema)
    assert I.infer_to(watched, echo, path, ["id", "run_id"], steps=8).count() == 40
    assert read.value == 40
    assert I.infer_to(watched, refuse, path, ["id", "run_id"], steps=5).where("response.text = ''").count() == 0
    assert read.value == 80


def test_an_unreadable_store_is_no_empty_one(spark, tmp_path):
    path = tmp_path / "spoilt"
    path.mkdir()
    (path / "part-00000.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        I.infer_to(requests(spark), echo, str(path), ["id", "run_id"])
    assert [f.name for f in path.iterdir()] == ["part-00000.parquet"]


def test_no_requests(spark, tmp_path):
    got = I.infer_to(requests(spark, 0), echo, str(tmp_path / "none"), ["id", "run_id"])
    assert got.count() == 0 and "response" in got.columns


def slow():
    state = {"now": 0, "most": 0}
    lock = threading.Lock()

    def respond(messages, options):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.02)
        with lock:
            state["now"] -= 1
        return {"text": messages[-1]["content"], "total_tokens": state["most"]}

    return respond


@pytest.mark.parametrize("calls", [1, 4])
def test_calls_in_flight(spark, calls):
    rows = I.infer(requests(spark, 40), slow, partitions=1, calls=calls).collect()
    assert all(r.response.text == f"text {r.id}" for r in rows) and len(rows) == 40
    assert max(r.response.total_tokens for r in rows) == calls


@pytest.mark.parametrize("written", [False, True])
def test_evaluate(spark, tmp_path, written):
    rows = spark.range(30).select("id", F.concat(F.lit(" class "), F.col("id") % 3).alias("text"),
                                  F.concat(F.lit("class "), (F.col("id") / 15).cast("int")).alias("label"))
    chat = to_messages(rows, "text", "label", keep="id")
    path = str(tmp_path / "r") if written else None
    vocab = {"label": ["class 0", "class 1"]}
    result, names = evaluate(chat, vocab, [RunConfig("a", 4), RunConfig("b", 4)], echo, "id", path)
    assert names == {"label": ["class 0", "class 1", "Unknown"]} and vocab["label"][-1] == "class 1"
    counts = {(r.run_id, r.true_id, r.pred_id): r.n for r in confusion_counts(result, names, by="run_id").collect()}
    assert counts == {(run, t, p): 5 for run in "ab" for t in (0, 1) for p in (0, 1, 2)}


@pytest.mark.parametrize("method", ["bayes", "logistic"])
def test_baseline(spark, method):
    rows = spark.range(200).select("id", F.expr("if(id % 2 = 0, 'the cat sat', 'le chat dort')").alias("text"),
                                   F.expr("if(id % 2 = 0, 'en', 'fr')").alias("lang"))
    vocab = label_vocabulary(rows, "lang")
    model = train_classifier(rows.where("id < 100"), "text", "lang", vocab, features=256, method=method)
    scored = classify(model, rows.where("id >= 100").withColumn("truth", F.col("lang")), "text", ["en", "fr"], keep=["id", "truth"])
    result = predictions(scored, {"lang": ["en", "fr", "Unknown"]})
    assert result.where("predicted.lang = actual.lang").count() == 100
