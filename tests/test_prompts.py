from __future__ import annotations

import pytest

from labelspark.operators.labels import label_vocabulary
from labelspark.plans import prompts as P
from labelspark.plans.config import RunConfig


@pytest.fixture(scope="module")
def vocab(spark):
    rows = spark.createDataFrame([("b", "y z"), ("a", "x"), ("a", "y z")], "`Kind of thing` string, part string")
    return label_vocabulary(rows, ["Kind of thing", "part"])


def test_single_label(vocab):
    text = P.build_prompt(vocab, "Kind of thing", "report")
    assert "\n(1) a\n(2) b\n" in text and "(say, a)" in text and text.endswith("Now the item:")
    slow = P.build_prompt(vocab, "Kind of thing", "report", step_by_step=True)
    assert slow.endswith("one step after the other.") and slow != text
    shown = P.build_prompt(vocab, "Kind of thing", "report", examples="text: q")
    assert shown.endswith("\n\ntext: q") and "Now the item:" not in shown
    assert P.build_prompt(vocab, "Kind of thing", "report", examples="") == text


def test_several_labels(vocab):
    text = P.build_prompt(vocab, ["Kind of thing", "part"], "report")
    assert '\n"Kind of thing" = "a" or "b"\n"part" = "x" or "y z"' in text and "of two fields" in text


def test_count_words():
    assert [P.count_word(n) for n in (1, 9, 10, 25)] == ["one", "nine", "10", "25"]


def test_requests(spark):
    texts = spark.createDataFrame([(1, "t")], "id int, text string")
    configs = [
        RunConfig("Few Shot!", 5, "p", temperature=0.5, top_p=0.9, reasoning_effort="high", thinking_tokens=1024),
        RunConfig("none", 5), RunConfig("empty", 5, ""), RunConfig("user", 5, "p", prompt_role="user"),
    ]
    plan = P.assemble_requests(texts, configs)
    assert plan.columns == ["id", "text", "run_id", "request", "options"]
    got = {r.run_id: ([(m.role, m.content) for m in r.request], r.options) for r in plan.collect()}
    assert got["few_shot"][0] == [("system", "p"), ("user", "t")]
    assert got["none"][0] == got["empty"][0] == [("user", "t")]
    assert got["user"][0] == [("user", "p"), ("user", "t")]
    options = got["few_shot"][1]
    assert (options.max_tokens, options.temperature, options.top_p) == (5, 0.5, 0.9)
    assert (options.reasoning_effort, options.thinking_tokens) == ("high", 1024)


def test_config():
    config = RunConfig.from_dict({"technique_name": "Zero-shot CoT", "max_tokens": 3, "other": 1})
    assert config.run_id == "zero-shot_cot" and RunConfig.from_dict(config.to_dict()) == config
    assert RunConfig.from_json(config.to_json()) == config
    old = RunConfig.from_dict({"name": "é", "max_tokens": 3, "claude_thinking_tokens": 1024})
    assert (old.technique_name, old.thinking_tokens) == ("é", 1024)
    with pytest.raises(ValueError):
        RunConfig("x", 1, reasoning_effort="extreme")
